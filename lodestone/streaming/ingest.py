"""Structured Streaming over the tables: incremental file states, windowed event counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import ensure_checkpoint_dir, table


def read_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a directory of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    single = not path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, d, name).schema).option("maxFilesPerTrigger", 4)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if single else reader.parquet(f"{d}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _updates(rows: DataFrame, root: str) -> DataFrame | None:
    """Runs a stateful stream over all that is there and gives what it wrote: the groups that each micro-batch changed, by `batch`; None for no batch.

    The state store keeps the groups; a batch writes its own changes alone, under its number,
    so that one that runs twice writes the same again.
    """
    spark, wrote = rows.sparkSession, []

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        wrote.append(number)

    rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out") if wrote else None


def latest_states(spark: SparkSession, d: str) -> DataFrame:
    """(file, mtime_ms, n_lines): the newest state of each file, kept up by batches of arrivals; late arrivals of older states change nothing."""
    newest = F.max(F.struct("mtime_ms", "n_lines")).alias("s")
    states = read_stream(spark, d, "files").groupBy("file").agg(newest)
    found = _updates(states, _scratch(spark))
    if found is None:
        return spark.createDataFrame([], "file string, mtime_ms double, n_lines long")
    return found.groupBy("file").agg(F.max("s").alias("s")).select("file", "s.mtime_ms", F.col("s.n_lines").cast("long").alias("n_lines"))


def event_windows(spark: SparkSession, d: str, seconds: int = 3600) -> DataFrame:
    """(window_start, event_type, n, total): events counted in tumbling windows of event time, those without a time by themselves.

    Stored files come in any order of event time, so there is no watermark: no event is too
    late. The state grows with the windows, not with the events.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.timestamp_micros(at - F.pmod(at, F.lit(seconds * 1_000_000)))
    counted = read_stream(spark, d, "events").groupBy(start.alias("at"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("total"))
    found = _updates(counted, _scratch(spark))
    if found is None:
        return spark.createDataFrame([], "window_start timestamp_ntz, event_type string, n long, total double")
    last = found.groupBy("at", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select(F.col("at").cast("timestamp_ntz").alias("window_start"), "event_type", "s.n", F.round("s.total", 4).alias("total"))
