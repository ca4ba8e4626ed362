"""Clean views over the given tables: one row per key, the latest state, usable vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.vector import usable
from lodestone.tables import cut, table

DIMS = 64
#: Ids (8 bytes each) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def chunks_now(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, each id as it was last delivered; line ranges in order."""
    all_ = table(spark, d, "chunks")
    # Which rows a later delivery replaced: only ids and ords are read for it, and only repeated ids are left. Texts are not moved unless those are many.
    newest = all_.groupBy("chunk_id").agg(F.max("ord").alias("newest"), F.count("*").alias("n")).where("n > 1")
    replaced = cut(spark.read.parquet(f"{d}/chunks.parquet").select(F.col("chunk_id").alias("id"), "ord").join(newest, F.col("id").eqNullSafe(F.col("chunk_id"))).where("ord < newest").select("ord"))
    c = all_.join(F.broadcast(replaced) if replaced.count() <= BROADCAST_IDS else replaced, "ord", "left_anti")
    low, high = F.least("start_line", "end_line"), F.greatest("start_line", "end_line")
    return c.withColumns({"start_line": low, "end_line": high, "pkg": F.trim("pkg"), "text": F.coalesce("text", F.lit(""))})


def files_now(spark: SparkSession, d: str) -> DataFrame:
    """Files in their newest state by modification time; a later arrival of an older state does not count."""
    f = table(spark, d, "files")
    known = f.groupBy("file").agg(F.max(F.trim("pkg")).alias("known"))
    newest = _latest(f, "file", F.desc("mtime_ms"), F.desc("indexed_at"), F.desc_nulls_last("n_lines"), F.desc_nulls_last("pkg"))
    return newest.withColumn("pkg", F.trim("pkg")).join(known, "file").withColumn("pkg", F.coalesce("pkg", "known")).drop("known")


def symbols_now(spark: SparkSession, d: str) -> DataFrame:
    """Symbols, one row per id; padding and nulls of repeated rows are filled from one another."""
    first = {c: F.min(c).alias(c) for c in ("name", "kind", "file", "start_line", "end_line")}
    return table(spark, d, "symbols").groupBy("id").agg(*first.values(), F.max(F.trim("pkg")).alias("pkg"), F.max("doc").alias("doc"), F.max("signature").alias("signature"))


def vectors_now(spark: SparkSession, d: str) -> DataFrame:
    """Usable vectors, one per ord."""
    return table(spark, d, "vectors").where(usable(F.col("embedding"), DIMS)).groupBy("ord").agg(F.min("embedding").alias("embedding"))


def edges_now(spark: SparkSession, d: str) -> DataFrame:
    """Distinct import edges between different files that are indexed."""
    files = table(spark, d, "files").select("file").distinct()
    e = table(spark, d, "edges").where("src <> dst").select("src", "dst").distinct()
    return e.join(files.select(F.col("file").alias("dst")), "dst", "left_semi").select("src", "dst")


def packages_now(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "packages").select(F.trim("name").alias("name"), F.trim("dir").alias("dir"), F.lower(F.trim("role")).alias("role"))


def task(spark: SparkSession, d: str) -> DataFrame:
    """The task of the first evaluation item: one row (task)."""
    return table(spark, d, "eval_items").orderBy("item_id").limit(1).select("task")
