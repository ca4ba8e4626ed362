"""Command line: `index` and `update` keep an index of a workspace, `retrieve` prints the manifest for a task.

    python -m lodestone.cli index ROOT INDEX
    python -m lodestone.cli update ROOT INDEX FILE...
    python -m lodestone.cli retrieve INDEX_OR_TABLES --task TEXT
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.paths import is_doc, is_ts
from lodestone.operators import fusion, graph, indexing, maintenance, search, static_model
from lodestone.operators import manifest as man
from lodestone.sources import views as V
from lodestone.sources import workspace
from lodestone.tables import cut


def _packages(spark: SparkSession, root: str) -> DataFrame:
    """(name, dir, role) of the workspace."""
    rows = spark.createDataFrame([(n, d, None) for n, d in workspace.packages(root)], "name string, dir string, role string")
    deps, options = workspace.role_signals(root)
    return fusion.infer_roles(rows, spark.createDataFrame(deps, "name string, dep string"), spark.createDataFrame(options, "name string, option string, value string"))


def _tables(spark: SparkSession, root: str, scanned: DataFrame, everything: DataFrame, after: int = -1) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks, vectors, edges, files) of the scanned files; imports are looked up in `everything`. No model is at hand, so there are no vectors."""
    packages = _packages(spark, root)
    first = workspace.packages(root)[0][0]
    chunks = cut(indexing.chunks_of(scanned, packages, after, first))
    symbols = indexing.chunks_of(everything, packages, -1, first).select("pkg", F.col("symbol").alias("name"), "kind", "file")
    owner = indexing.structure.owners(scanned, packages, first)
    files = scanned.join(owner, "file").select("file", F.when(is_doc(F.col("file")), "docs").otherwise(F.col("owner")).alias("pkg"), "mtime_ms", "n_lines", is_doc(F.col("file")).alias("is_doc"))
    edges = indexing.edges_of(scanned, everything.select("file"), packages, graph.symbol_index(symbols))
    return chunks, spark.createDataFrame([], schemas.VECTORS), edges, files


def index(spark: SparkSession, root: str, where: str) -> str:
    """Reads the workspace and saves a new version of its index."""
    scanned = cut(workspace.scan(spark, root, workspace.read_config(root), workspace.ignore_rules(root)))
    return maintenance.save(spark, maintenance.build(*_tables(spark, root, scanned, scanned)) | {"packages": _packages(spark, root)}, where)


def update(spark: SparkSession, root: str, where: str, files: list[str]) -> str:
    """Reads the named files again, drops those that are gone, and saves a new version; other files are carried over."""
    old = maintenance.load(spark, where)
    everything = cut(workspace.scan(spark, root, workspace.read_config(root), workspace.ignore_rules(root)))
    named = spark.createDataFrame([(f,) for f in files], "file string").distinct()
    changed = cut(everything.join(named, "file", "left_semi"))
    deleted = named.join(everything, "file", "left_anti").where(is_ts(F.col("file")) | is_doc(F.col("file")))
    after = old["doclen"].agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    new = maintenance.updated(old, *_tables(spark, root, changed, everything, after), deleted)
    return maintenance.save(spark, new | {"packages": _packages(spark, root)}, where)


def retrieve(spark: SparkSession, d: str, text: str, config: workspace.Config = workspace.Config()) -> DataFrame:  # noqa: B008 (frozen)
    """The manifest for a task over a saved index, or over the tables in `d`.

    The dense list needs a vector of the task: it is made of its tokens by a static model
    learned from the chunks that have them; without vectors there is no such list.
    """
    task = spark.createDataFrame([(text,)], "task string")
    terms = cut(search.query_terms(task, "task"))
    if maintenance.exists(spark, d):
        i = maintenance.load(spark, d)
        chunks, vectors, files, edges = i["chunks"], i["vectors"], i["files"], i["edges"]
        symbols = chunks.select("file", F.col("chunk_id").alias("id"), F.col("symbol").alias("name"), "kind", "start_line")
        packages, scored, post = i["packages"], search.bm25_indexed(i, terms), i["postings"]
    else:
        chunks, vectors, files, edges = V.chunks_now(spark, d), V.vectors_now(spark, d), V.files_now(spark, d), V.edges_now(spark, d)
        symbols, packages, scored = V.symbols_now(spark, d), fusion.infer_roles(V.packages_now(spark, d)).distinct(), search.bm25(chunks, terms)
        post = search.postings(chunks.select("ord", "text"))
    model = static_model.learn(post, vectors, V.DIMS, terms)
    query = static_model.embed(terms.withColumn("key", F.lit(0)), "key", model, V.DIMS).select(F.col("vector").alias("q"))
    dense = cut(search.top(search.dense(chunks, vectors, query)))
    lists = [search.ranked_files(dense), search.ranked_files(search.top(scored)), search.symbol_files(search.symbol_scores(symbols, task)).select("file", "rank")]
    given = [(n, r) for n, r in config.package_roles.items() if r in fusion.ROLES]
    own = spark.createDataFrame(given, "name string, own string")
    packages = packages.join(F.broadcast(own), "name", "left").select("name", "dir", F.coalesce("own", "role").alias("role"))  # as many as the configuration names
    weights = fusion.package_weights(packages, fusion.layer_hits(spark, terms, config.layer_terms), config.package_weights, config.boost, config.weighting)
    weighted = cut(fusion.weigh(fusion.rrf(lists), files, weights))
    return man.manifest(weighted, fusion.seeds(weighted, config.top_n), edges, files, man.matched_symbols(dense, chunks), config.hops, config.max_expand, chunks, config.adjacency_bonus)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "update"):
        c = sub.add_parser(name)
        c.add_argument("root")
        c.add_argument("index")
        if name == "update":
            c.add_argument("files", nargs="+")
    c = sub.add_parser("retrieve")
    c.add_argument("dir")
    c.add_argument("--task", required=True)
    c.add_argument("--root", help="the workspace whose configuration holds")
    c.add_argument("--top", type=int)
    c.add_argument("--hops", type=int)
    c.add_argument("--max-expand", type=int)
    c.add_argument("--json", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if a.command != "retrieve":
        print(index(spark, a.root, a.index) if a.command == "index" else update(spark, a.root, a.index, a.files))
        return
    asked = {"top_n": a.top, "hops": a.hops, "max_expand": a.max_expand}
    config = workspace.read_config(a.root) if a.root else workspace.Config()
    entries = retrieve(spark, a.dir, a.task, replace(config, **{k: v for k, v in asked.items() if v is not None}))
    # Seeds and at most --max-expand files: a manifest is short.
    if a.json:
        print(json.dumps([r.asDict() for r in entries.orderBy("pos").collect()]))
    else:
        print("\n".join(r["line"] for r in man.render(entries).orderBy(F.col("pos")).collect()))


if __name__ == "__main__":
    main()
