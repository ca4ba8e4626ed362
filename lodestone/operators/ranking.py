"""Ranks over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.tables import cut


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """`df` with the 1-based position of each row in the given order.

    Rows are range-partitioned by the order; each partition counts its own rows, and the
    counts before it (one row for each partition) are added.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_n", local).join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_n") + F.col("_offset")).cast("long")).drop("_p", "_n", "_offset")
