"""Building, saving, reading and updating the index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.paths import is_doc, is_ts
from lodestone.functions.text import token_count
from lodestone.operators.search import doc_freq, postings, shard

#: Tables that are put together anew from the others, not carried over row by row.
DERIVED = ("df", "stats")


def _derived(post: DataFrame, doclen: DataFrame) -> dict[str, DataFrame]:
    stats = doclen.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))
    return {"df": doc_freq(post), "stats": stats}


def build(chunks: DataFrame, vectors: DataFrame, edges: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index: chunks, postings, lengths, frequencies, the corpus row, vectors, edges, files."""
    post = postings(chunks)
    doclen = chunks.select("ord", "file", token_count(F.col("text")).alias("len"))
    return {"chunks": chunks, "postings": post, "doclen": doclen, "vectors": vectors, "edges": edges, "files": files} | _derived(post, doclen)


def save(spark: SparkSession, index: dict[str, DataFrame], root: str, model: str = "", dims: int = 64) -> str:
    """Writes a new version of the index and returns its name.

    A version becomes visible by a row in the table of versions, appended when all its tables
    stand: a reader sees a whole version or the one before, also while another is written or
    after a crash. Postings are divided into shards by term and ordered by it within, so that
    a query's terms prune directories and row groups. Frequencies and the corpus row are
    counted from the written tables.
    """
    version = uuid.uuid4().hex
    for name in [n for n in index if n not in DERIVED]:
        df = index[name]
        out = df.withColumn("shard", shard(F.col("term"))).repartition("shard").sortWithinPartitions("shard", "term").write.partitionBy("shard") if name == "postings" else df.write
        out.mode("errorifexists").parquet(f"{root}/{version}/{name}")
    written = {n: spark.read.parquet(f"{root}/{version}/{n}") for n in ("postings", "doclen")}
    for name, df in _derived(written["postings"], written["doclen"]).items():
        df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
    known = _versions(spark, root)
    number = 0 if known is None else known.agg(F.max("number")).first()[0] + 1
    row = spark.createDataFrame([(number, version, model, dims, "packages" in index)], schemas.VERSIONS)
    row.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    """The table of versions, or None where there is no index."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schemas.VERSIONS).parquet(f"{root}/versions")
    except AnalysisException:
        return None


def exists(spark: SparkSession, root: str) -> bool:
    known = _versions(spark, root)
    return known is not None and not known.isEmpty()


def load(spark: SparkSession, root: str, model: str = "", dims: int = 64) -> dict[str, DataFrame]:
    """The newest version; raises if there is none or it was built for another model or vector length."""
    known = _versions(spark, root)
    newest = known and known.orderBy(F.desc("number"), "version").first()
    if newest is None:
        raise FileNotFoundError(f"no index in {root}")
    if (newest["model"], newest["dims"]) != (model, dims):
        raise ValueError(f"the index was built for {newest['model']!r} with {newest['dims']} numbers, not {model!r} with {dims}")
    at = f"{root}/{newest['version']}"
    found = {n: spark.read.schema(s).parquet(f"{at}/{n}") for n, s in schemas.INDEX.items()}
    if newest["packages"]:
        found["packages"] = spark.read.schema(schemas.PACKAGES).parquet(f"{at}/packages")
    return found


def updated(index: dict[str, DataFrame], chunks: DataFrame, vectors: DataFrame, edges: DataFrame, files: DataFrame, deleted: DataFrame) -> dict[str, DataFrame]:
    """The index after the files in `files` were read again and those in `deleted` (file) are gone.

    `chunks`, `vectors` and `edges` have what the files hold now. Rows of other files are
    carried over as they are: their texts are not tokenized or embedded again. Edges into
    deleted files go. The result equals an index built anew from the new state.
    """
    changed = files.select("file").distinct()
    affected = changed.unionByName(deleted.select("file")).distinct()
    gone = index["doclen"].join(affected, "file", "left_semi").select("ord")
    fresh = build(chunks, vectors, edges, files)
    kept = lambda n: index[n].join(gone, "ord", "left_anti").select(fresh[n].columns)
    post, doclen = kept("postings").unionByName(fresh["postings"]), kept("doclen").unionByName(fresh["doclen"])
    return {
        "chunks": upsert(index["chunks"], fresh["chunks"].select(index["chunks"].columns), affected), "files": upsert(index["files"], fresh["files"].select(index["files"].columns), affected),
        "vectors": kept("vectors").unionByName(fresh["vectors"]), "edges": update_edges(index["edges"], edges, changed, deleted), "postings": post, "doclen": doclen,
    } | _derived(post, doclen)


def classify_changes(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """(file, change): changed-ts, changed-doc, deleted or ignored for each path of a change list."""
    there = existing.select("file").distinct().withColumn("there", F.lit(True))
    p = paths.select("file").distinct().join(there, "file", "left")
    kind = F.when(F.col("there").isNull() & (is_ts(F.col("file")) | is_doc(F.col("file"))), "deleted").when(is_ts(F.col("file")), "changed-ts").when(is_doc(F.col("file")), "changed-doc").otherwise("ignored")
    return p.select("file", kind.alias("change"))


def upsert(kept: DataFrame, fresh: DataFrame, affected: DataFrame, key: str = "file") -> DataFrame:
    """Rows of files that are not affected, and the new rows; the same as building anew."""
    return kept.join(affected.select(key).distinct(), key, "left_anti").select(fresh.columns).unionByName(fresh)


def update_edges(edges: DataFrame, fresh: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges after changed files got new imports and deleted files are gone from both ends."""
    gone = deleted.select("file").distinct()
    kept = edges.join(changed.select(F.col("file").alias("src")).distinct(), "src", "left_anti").select("src", "dst").unionByName(fresh.select("src", "dst"))
    kept = kept.join(gone.withColumnRenamed("file", "src"), "src", "left_anti").join(gone.withColumnRenamed("file", "dst"), "dst", "left_anti")
    return kept.select("src", "dst").distinct()
