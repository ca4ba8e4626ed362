"""The import graph: adjacency, expansion from seeds, resolution of imports and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import dirname, normalised
from lodestone.operators.ranking import global_rank
from lodestone.tables import cut

HOPS, ADJACENCY_BONUS, ALIAS_STEPS = 2, 0.4, 6


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degree_lists(edges: DataFrame, key: str, other: str) -> DataFrame:
    """(key, n, first, last): neighbours counted, with the first and last by name; lists of hot files stay out of any one task."""
    return edges.groupBy(key).agg(F.countDistinct(other).alias("n"), F.min(other).alias("first"), F.max(other).alias("last"))


def neighbours(edges: DataFrame, key: str, other: str) -> DataFrame:
    """(file, position, neighbour): the distinct neighbours of each file by name, counted from 1.

    Positions come from a rank over all edges, less that of the file's first: the list of a
    file that a third of all edges touch is in no one task.
    """
    ranked = global_rank(edges.select(F.col(key).alias("file"), F.col(other).alias("neighbour")).distinct(), F.asc("file"), F.asc("neighbour"))
    first = ranked.groupBy("file").agg(F.min("rank").alias("first"))
    return ranked.join(first, "file").select("file", (F.col("rank") - F.col("first") + 1).alias("position"), "neighbour")


def symbol_index(symbols: DataFrame) -> DataFrame:
    """(pkg, name, position, file): the files that declare a name in a package, methods and sections left out."""
    own = symbols.where("kind not in ('method', 'doc') and pkg is not null and name is not null")
    ranked = global_rank(own.select("pkg", "name", "file").distinct(), F.asc("pkg"), F.asc("name"), F.asc("file"))
    first = ranked.groupBy("pkg", "name").agg(F.min("rank").alias("first"))
    return ranked.join(first, ["pkg", "name"]).select("pkg", "name", (F.col("rank") - F.col("first") + 1).alias("position"), "file")


def expand(seeds: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """(hop, pos, file, reason): files within `hops` edges of the seeds (pos, file), each at its first visit.

    A visit's order is that of its frontier file, then forward before reverse edges, then
    the neighbour's name; the reason names the last edge. Only edges that touch the frontier
    are joined; a hop's result is checkpointed, so that lineage does not grow with the hops.
    """
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("file"), F.lit(0).alias("dir")).unionByName(edges.select(F.col("dst").alias("at"), F.col("src").alias("file"), F.lit(1).alias("dir")))
    frontier = seeds.select("file", F.col("pos").cast("long").alias("pos"))
    visited, found = seeds.select("file"), None
    for hop in range(1, hops + 1):
        step = both.join(frontier.select(F.col("file").alias("at"), "pos"), "at").join(visited, "file", "left_anti")
        # min() is combined before the shuffle: a file that many frontier files touch is no hot group.
        first = step.groupBy("file").agg(F.min(F.struct("pos", "dir")).alias("v"))
        new = cut(first.select(F.lit(hop).cast("long").alias("hop"), F.col("v.pos").alias("parent"), F.col("v.dir").alias("dir"), "file"))
        ranked = global_rank(new, F.asc("parent"), F.asc("dir"), F.asc("file"), name="pos")
        out = ranked.select("hop", "pos", "file", F.when(F.col("dir") == 0, "imported-by-seed").otherwise("imports-seed").alias("reason"))
        found = out if found is None else found.unionByName(out)
        frontier = ranked.select("file", "pos")
        visited = visited.unionByName(frontier.select("file"))
    if found is None:
        return seeds.sparkSession.createDataFrame([], "hop long, pos long, file string, reason string")
    return found


def adjacency(candidates: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, adjacent): how many seeds a file is linked with, either way, itself not counted."""
    s = F.broadcast(seeds.select(F.col("file").alias("seed")))
    links = edges.join(s, F.col("dst") == F.col("seed")).select(F.col("src").alias("file"), "seed")
    links = links.unionByName(edges.join(s, F.col("src") == F.col("seed")).select(F.col("dst").alias("file"), "seed")).where("file <> seed")
    counted = links.groupBy("file").agg(F.countDistinct("seed").alias("adjacent"))
    return candidates.select("file").join(counted, "file", "left").select("file", F.coalesce("adjacent", F.lit(0)).cast("long").alias("adjacent"))


#: Statements that name another module: with a list and `from`, or for its effects alone.
STATEMENT = r"""(?m)^[ \t]*(?:import|export)\s[^;'"`()=:]*?\bfrom\s*["'][^"'\n]+["']|^[ \t]*import\s*["'][^"'\n]+["']"""


def statements(contents: DataFrame) -> DataFrame:
    """(src, spec, name, exported) of every import and re-export in (file, content).

    One row for each imported name: `default`, `*` for a whole module, an empty name for an
    import for its effects; of `a as b` the name in the other module. Re-exports are `exported`
    under their new name, null for imports.
    """
    found = contents.select(F.col("file").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(STATEMENT), F.lit(0))).alias("text"))
    spec = F.regexp_extract("text", r"""["']([^"'\n]+)["']$""", 1)
    listed = F.split(F.regexp_extract("text", r"\{([^}]*)\}", 1), ",")
    names = F.filter(F.transform(listed, lambda n: F.regexp_replace(F.trim(F.regexp_replace(n, r"\s+", " ")), "^type ", "")), lambda n: n != "")
    default = F.when(F.col("text").rlike(r"^\s*import\s+(?:type\s+)?[A-Za-z_$][\w$]*\s*(?:,|\s+from)"), F.array(F.lit("default")))
    star = F.when(F.col("text").rlike(r"\*"), F.array(F.regexp_replace(F.regexp_extract("text", r"(\*(?:\s*as\s+[\w$]+)?)", 1), r"\s+", " ")))
    none = F.expr("cast(array() as array<string>)")
    every = F.concat(F.coalesce(default, none), F.coalesce(star, none), names)
    rows = found.select("src", spec.alias("spec"), F.col("text").rlike(r"^\s*export").alias("out"), F.explode(F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("")))).alias("name"))
    new = F.when(F.contains("name", F.lit(" as ")), F.substring_index("name", " as ", -1)).otherwise(F.col("name"))
    return rows.select("src", "spec", F.substring_index("name", " as ", 1).alias("name"), F.when(F.col("out"), new).alias("exported")).distinct()


def module_paths(imports: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """The imports with `path`: where a relative specifier, or one that begins with an alias, leads from the root; null for others."""
    at = F.when(F.col("spec").rlike(r"^\.\.?(?:/|$)"), normalised(F.concat(dirname(F.col("src")), F.lit("/"), F.col("spec"))))
    for prefix, target in (aliases if aliases is not None else {"@/": ""}).items():
        at = at.when(F.col("spec").startswith(prefix), normalised(F.concat(F.lit(target), F.substring("spec", len(prefix) + 1, 1 << 30))))
    return imports.withColumn("path", at)


def modules(files: DataFrame) -> DataFrame:
    """(path, target, stage): the ways to name each file: with its ending (1), without (1), its directory if it is an index (2)."""
    f = files.select("file").distinct()
    bare = f.where(F.col("file").rlike(r"\.[jt]sx?$")).select(F.regexp_replace("file", r"(?:\.d)?\.[jt]sx?$", "").alias("path"), F.col("file").alias("target"), F.lit(1).alias("stage"))
    index = f.where(F.col("file").rlike(r"(?:^|/)index\.[jt]sx?$")).select(F.regexp_replace("file", r"/?index\.[jt]sx?$", "").alias("path"), F.col("file").alias("target"), F.lit(2).alias("stage"))
    return f.select(F.col("file").alias("path"), F.col("file").alias("target"), F.lit(1).alias("stage")).unionByName(bare).unionByName(index)


def specifier_packages(specs: DataFrame, packages: DataFrame) -> DataFrame:
    """(spec, pkg): the package a specifier names, by its whole name or as `name/...`, the longest name first.

    An equi join on the specifier's own prefixes, as with owners of files.
    """
    s = specs.select("spec").distinct()
    parts = F.split("spec", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    known = packages.select(F.col("name").alias("pkg")).distinct()
    return s.select("spec", F.explode(prefixes).alias("pkg")).join(known, "pkg").groupBy("spec").agg(F.max_by("pkg", F.length("pkg")).alias("pkg"))


def import_targets(imports: DataFrame, reexports: DataFrame, files: DataFrame, packages: DataFrame, index: DataFrame, aliases: dict[str, str] | None = None, steps: int = ALIAS_STEPS) -> DataFrame:
    """(src, spec, name, target, stage) of every import (src, spec, name); the first stage that finds a target wins.

    Stage 0: the module hands the name on, from another module (re-exports (src, spec, name,
    exported), followed up to `steps` times or until nothing changes); stage 1: the module's
    own file; stage 2: the index file of a directory; stage 3: the files of the package that
    the specifier names which declare the name (`index` from `symbol_index`). Imports without
    a target, such as those of packages outside, are left out.
    """
    known = modules(files)
    literal = cut(module_paths(imports, aliases).join(known, "path").select("src", "spec", "name", "target", "stage"))
    out = cut(module_paths(reexports.where("exported is not null"), aliases).join(known, "path").select(F.col("src").alias("target"), F.col("name").alias("inner"), "exported", F.col("target").alias("next")))
    one = out.where("exported <> '*'").select("target", "inner", F.col("exported").alias("wanted"), "next")
    whole = out.where("exported = '*'").select("target", F.col("next").alias("any")).distinct()
    at = literal.select("src", "spec", "name", "target", F.col("name").alias("wanted"), F.lit(0).alias("moved"), F.lit(False).alias("open"))
    for _ in range(steps):
        named = at.join(one, ["target", "wanted"], "left").join(whole, "target", "left")
        to = F.coalesce("next", "any")
        moved = named.select(
            "src", "spec", "name", F.coalesce(to, "target").alias("target"), F.coalesce("inner", "wanted").alias("wanted"), (F.col("moved") + to.isNotNull().cast("int")).alias("moved"),
            (F.col("open") | (F.col("next").isNull() & F.col("any").isNotNull())).alias("open"), to.isNotNull().alias("step"),
        )
        # A module that re-exports others whole can declare the name itself: it stays a candidate.
        stays = named.where("next is null and any is not null").select("src", "spec", "name", "target", "wanted", "moved", F.lit(True).alias("open"), F.lit(False).alias("step"))
        at = cut(moved.unionByName(stays).distinct())
        if at.where("step").isEmpty():
            break
        at = at.drop("step")
    declared = index.select(F.col("file").alias("target"), F.col("name").alias("wanted")).distinct()
    handed = at.where("moved > 0 and not open").unionByName(at.where("moved > 0 and open").join(declared, ["target", "wanted"], "left_semi").select(at.columns))
    handed = handed.select("src", "spec", "name", "target", F.lit(0).alias("stage"))
    by_package = imports.join(specifier_packages(imports, packages), "spec").join(index.select("pkg", "name", F.col("file").alias("target")), ["pkg", "name"]).select("src", "spec", "name", "target", F.lit(3).alias("stage"))
    every = handed.unionByName(literal).unionByName(by_package).where("src <> target")
    best = every.groupBy("src", "spec", "name").agg(F.min("stage").alias("stage"))
    return every.join(best, ["src", "spec", "name", "stage"]).select("src", "spec", "name", "target", F.col("stage").cast("long").alias("stage")).distinct()


def follow_aliases(aliases: DataFrame, steps: int = ALIAS_STEPS) -> DataFrame:
    """(name, target, steps): each alias (name, target) followed up to `steps` links, or until none goes on; loops end at the bound."""
    links = aliases.select("name", "target").distinct().groupBy("name").agg(F.min("target").alias("target"))
    nxt = links.select(F.col("name").alias("target"), F.col("target").alias("next"))
    done = links.select("name", "target", F.lit(1).cast("long").alias("steps"))
    for _ in range(steps - 1):
        j = cut(done.join(nxt, "target", "left").select("name", "target", "next", "steps"))
        if j.where("next is not null").isEmpty():
            break
        done = j.select("name", F.coalesce("next", "target").alias("target"), (F.col("steps") + F.when(F.col("next").isNotNull(), 1).otherwise(0)).alias("steps"))
    return done


def resolve_imports(imports: DataFrame, exact: DataFrame, by_name: DataFrame) -> DataFrame:
    """(src, spec, name, target, stage): the first stage that finds a target wins.

    Stage 1: the literal module file with an ending; stage 2: its index file; stage 3: the
    package that the specifier names, by the exported name. `exact` has (file),
    `by_name` (pkg, name, file).
    """
    one = imports.join(exact.select(F.col("file").alias("target"), F.regexp_replace("file", r"\.(tsx?|js)$", "").alias("spec")), "spec").withColumn("stage", F.lit(1))
    two = imports.join(exact.where(F.col("file").rlike(r"/index\.(tsx?|js)$")).select(F.col("file").alias("target"), F.regexp_replace("file", r"/index\.(tsx?|js)$", "").alias("spec")), "spec").withColumn("stage", F.lit(2))
    three = imports.join(by_name.select(F.col("pkg").alias("spec"), "name", F.col("file").alias("target")), ["spec", "name"]).withColumn("stage", F.lit(3))
    every = one.select("src", "spec", "name", "target", "stage").unionByName(two.select("src", "spec", "name", "target", "stage")).unionByName(three.select("src", "spec", "name", "target", "stage"))
    best = every.groupBy("src", "spec", "name").agg(F.min("stage").alias("stage"))
    return every.join(best, ["src", "spec", "name", "stage"]).select("src", "spec", "name", "target", F.col("stage").cast("long").alias("stage")).distinct()
