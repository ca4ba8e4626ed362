"""Reciprocal rank fusion, package roles and weights, seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RRF_K = 60
BOOST = 0.6
SEEDS = 8

# Words of a query that point at a layer of the code.
LAYER_TERMS = {
    "backend": ("route", "router", "controller", "service", "endpoint", "api", "handler", "transaction", "atomic", "schema", "migration", "drizzle", "sql", "query", "db", "database", "table", "column", "index", "constraint", "unique", "presign", "bucket", "storage", "upload", "cdn", "webhook", "cron", "queue", "worker", "middleware", "auth", "token", "credit", "billing", "payment", "deduct", "balance", "ledger", "invoice", "server"),
    "frontend": ("page", "css", "dom", "browser", "spa", "ssr", "hydrate", "vite", "webpack", "router", "route", "fetch", "form"),
    "mobile": ("screen", "layout", "component", "tap", "press", "gesture", "scroll", "navigation", "navigator", "navigate", "view", "render", "style", "stylesheet", "expo", "native", "tab", "modal", "sheet", "drawer", "safearea", "keyboard", "animation", "animated", "flatlist", "touchable", "pressable"),
    "shared": ("type", "interface", "enum", "constant", "shared", "util", "helper", "dto"),
    "docs": ("readme", "documentation", "guide", "changelog"),
}

# Dependency name prefixes that tell a role, the first role first.
DEPENDENCIES = {
    "mobile": ("react-native", "expo", "@expo/", "@react-navigation/", "@react-native", "nativewind"),
    "frontend": ("next", "nuxt", "vite", "@vitejs/", "vue", "svelte", "@sveltejs/", "@angular/", "react-dom", "react-router-dom", "gatsby", "@remix-run/", "astro"),
    "backend": ("express", "fastify", "elysia", "hono", "koa", "@nestjs/", "@hapi/", "drizzle-orm", "drizzle-kit", "prisma", "@prisma/", "mongoose", "typeorm", "sequelize", "knex", "pg", "postgres", "mysql", "mysql2", "@aws-sdk/", "firebase-admin", "ioredis", "bullmq", "kafkajs", "@trpc/server", "apollo-server", "graphql-yoga"),
}

# Parts of a package's name or directory that tell a role, the first role first.
NAME_PARTS = {
    "mobile": ["mobile", "expo", "react-native", "native", "/app"],
    "backend": ["backend", "server", "/api", "worker", "lambda", "functions"],
    "frontend": ["frontend", "web", "client", "www", "dashboard", "admin", "site"],
    "docs": ["docs", "documentation"],
    "shared": ["shared", "common", "core", "types", "schema", "lib", "util", "packages/"],
}
ROLES = ["backend", "frontend", "mobile", "shared", "docs"]


def rrf(lists: list[DataFrame]) -> DataFrame:
    """Fuses ranked lists (file, rank): (file, score, list, rank), the last two of a file's first place."""
    tagged = [x.select("file", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("list")) for i, x in enumerate(lists)]
    united = reduce(DataFrame.unionByName, tagged)
    first = F.min(F.struct("list", "rank"))
    return united.groupBy("file").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"), first.alias("f")).select("file", "score", F.col("f.list").cast("long").alias("list"), F.col("f.rank").alias("rank"))


def layer_hits(spark: SparkSession, terms: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """(role, hits): different layer words that a query token equals or, from four letters on, begins with."""
    extra = extra or {}
    rows = sorted({(r, t) for r in ROLES for t in [*LAYER_TERMS[r], *extra.get(r, [])]})
    words = F.broadcast(spark.createDataFrame(rows, "role string, word string"))
    hit = (F.col("term") == F.col("word")) | ((F.length("word") >= 4) & F.col("term").startswith(F.col("word")))
    hits = terms.select("term").distinct().join(words, hit).groupBy("role").agg(F.countDistinct("word").alias("hits"))
    roles = spark.createDataFrame([(r,) for r in ROLES], "role string")
    return roles.join(F.broadcast(hits), "role", "left").select("role", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def role_by_name(name: Column, where: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", name, where))
    found = None
    for role, parts in NAME_PARTS.items():
        test = reduce(lambda a, b: a | b, [F.contains(hay, F.lit(p)) for p in parts])
        found = F.when(test, role) if found is None else found.when(test, role)
    return found.otherwise("unknown")


def infer_roles(packages: DataFrame, deps: DataFrame | None = None, options: DataFrame | None = None) -> DataFrame:
    """(name, dir, role): the given role if it is one; else by dependencies (name, dep), by compiler options (name, option, value), by name and directory.

    Types of a server's runtime tell a backend, the browser's library a frontend.
    """
    given = F.when(F.col("role").isin(*ROLES), F.col("role"))
    signs = [given]
    rows = packages
    if deps is not None:
        prints = [(p, i, r) for i, (r, ps) in enumerate(DEPENDENCIES.items()) for p in ps]
        marks = F.broadcast(packages.sparkSession.createDataFrame(prints, "prefix string, priority int, dep_role string"))
        found = deps.join(marks, F.lower("dep").startswith(F.col("prefix"))).groupBy("name").agg(F.min_by("dep_role", "priority").alias("dep_role"))
        rows = rows.join(found, "name", "left")
        signs.append(F.col("dep_role"))
    if options is not None:
        value = F.lower("value")
        server = F.max((F.col("option") == "types") & value.isin("bun-types", "node"))
        browser = F.max((F.col("option") == "lib") & value.startswith("dom"))
        found = options.groupBy("name").agg(F.when(server, "backend").when(browser, "frontend").alias("option_role"))
        rows = rows.join(found, "name", "left")
        signs.append(F.col("option_role"))
    return rows.select("name", "dir", F.coalesce(*signs, role_by_name(F.col("name"), F.col("dir"))).alias("role"))


def package_weights(roles: DataFrame, hits: DataFrame, static: dict[str, float] | None = None, boost: float = BOOST, enabled: bool = True) -> DataFrame:
    """(name, role, hits, weight): static weight of the package or role, raised by the query's share of layer words."""
    most = hits.agg(F.max("hits").alias("most"))
    w = roles.join(F.broadcast(hits), "role", "left").crossJoin(F.broadcast(most)).withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    base = F.lit(1.0)
    if static:
        given = F.create_map(*[F.lit(x) for kv in static.items() for x in kv])
        base = F.coalesce(given[F.col("name")], given[F.col("role")], F.lit(1.0))
    raised = F.when((F.col("hits") > 0) & F.lit(enabled), 1 + F.lit(boost) * F.col("hits") / F.col("most")).otherwise(F.lit(1.0))
    return w.select("name", "role", "hits", F.round(base * raised, 9).alias("weight"))


def weigh(fused: DataFrame, files: DataFrame, weights: DataFrame) -> DataFrame:
    """(file, pkg, score, list, rank): fused scores times the weight of the file's package; 1 where there is none."""
    w = weights.select(F.col("name").alias("pkg"), "weight")
    joined = fused.join(files.select("file", "pkg"), "file", "left").join(w, "pkg", "left")
    return joined.select("file", "pkg", F.round(F.col("score") * F.coalesce("weight", F.lit(1.0)), 9).alias("score"), "list", "rank")


def seeds(weighted: DataFrame, n: int = SEEDS) -> DataFrame:
    """(pos, file, pkg, score): the best n, ties by first place in the lists."""
    from pyspark.sql import Window

    best = weighted.orderBy(F.desc("score"), "list", "rank").limit(n)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "list", "rank")).cast("long").alias("pos"), "file", "pkg", "score")
