"""Reading the given tables and the few session facts that operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows cost far more to work on than to move.
HEAVY = {"chunks", "documents", "source_files", "vectors"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory (a Parquet file or a directory of them).

    A heavy table whose scan has fewer splits than there are cores, which is a small one, is
    spread over them; any other is read as it lies.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in HEAVY:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's own setting wins.

    On a cluster `spark.checkpoint.dir` names a folder that all executors share, and has to.
    Only in local mode (tests, a laptop) a folder of the machine is made where it is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        configured = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read from there: its lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
