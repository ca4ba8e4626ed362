"""Filling fixed-capacity containers with documents (problem 6): cost-balanced packing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import token_count
from lodestone.tables import ensure_checkpoint_dir

#: Cost of a text of n tokens in a sequence: LINEAR * n + QUADRATIC * n * n (attention within the text).
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Items that one group packs on its own. Groups only bound the work of a task: their number grows with the input.
GROUP_ITEMS = 4096


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: items in descending order, each into the cheapest container with room.

    As many containers are open from the start as the total needs, so that their
    cost stays balanced; another is opened only when no open one has room.
    """
    n = len(sizes)
    place = np.zeros(n, dtype=np.int64)
    if n == 0:
        return place
    order = np.argsort(-sizes, kind="stable")
    opened = max(1, math.ceil(int(sizes.sum()) / capacity))
    load, cost = np.zeros(n + opened, dtype=np.int64), np.zeros(n + opened, dtype=np.float64)
    for i in order:
        size = int(sizes[i])
        open_cost = np.where(load[:opened] + size <= capacity, cost[:opened], np.inf)
        b = int(open_cost.argmin())
        if open_cost[b] == np.inf:
            b, opened = opened, opened + 1
        load[b] += size
        cost[b] += LINEAR * size + QUADRATIC * size * size
        place[i] = b
    return place


def pack(docs: DataFrame, id_col: str, text_col: str, capacity: int = 512, size: Column | None = None) -> DataFrame:
    """Packs every row of `docs` into containers of at most `capacity` tokens.

    Returns (id_col, piece, pieces, token_start, tokens, container): one row for each
    piece. A text within the capacity is one piece. A longer one is split into full
    pieces, each a container of its own, and a rest that is packed like a short text.
    The size is the project's own token count, or `size`.

    Rows are spread over groups by hash; a group of about GROUP_ITEMS items is packed by
    one task with a linear plus quadratic cost: no task sees more, whatever the input.
    The room left over is what remains in the last containers of each group.

    Null, empty and token-less texts have 0 tokens and still get a container. Repeated
    ids are separate rows, spread over the groups one by one. An empty table gives an
    empty result. Other columns of `docs` are not read.
    """
    tokens = F.coalesce(size if size is not None else token_count(F.col(text_col)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("_id"), tokens.alias("_n"), F.monotonically_increasing_id().alias("_row"))
    # Sizes are counted once, and the row numbers stay what they are if a task runs again.
    ensure_checkpoint_dir(docs.sparkSession)
    sized = sized.checkpoint()
    pieces = F.greatest(F.ceil(F.col("_n") / capacity), F.lit(1)).cast("int")
    split = sized.withColumn("pieces", pieces).select("_id", "_n", "_row", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    split = split.select(
        "_id", "_row", "pieces", "piece",
        (F.col("piece").cast("long") * capacity).alias("token_start"),
        F.least(F.col("_n") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("int").alias("tokens"),
    )
    groups = max(1, math.ceil(sized.count() / GROUP_ITEMS))
    whole = (F.col("tokens") == capacity) & (F.col("pieces") > 1)
    id_type = docs.schema[id_col].dataType.simpleString()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "_row"], ascending=[False, True], kind="stable")
        pdf["container"] = [f"g{g}-{b}" for g, b in zip(pdf["_group"], pack_group(pdf["tokens"].to_numpy(), capacity))]
        return pdf[["_id", "piece", "pieces", "token_start", "tokens", "container"]]

    packed = (
        split.where(~whole)
        .withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
        .groupBy("_group")
        .applyInPandas(group, f"_id {id_type}, piece int, pieces int, token_start long, tokens int, container string")
    )
    full = split.where(whole).select("_id", "piece", "pieces", "token_start", "tokens", F.concat(F.lit("f"), F.col("_row"), F.lit("-"), F.col("piece")).alias("container"))
    return packed.unionByName(full).withColumnRenamed("_id", id_col)


def fill(packed: DataFrame, capacity: int = 512) -> DataFrame:
    """One row: containers used, the fewest possible, tokens, share of the capacity filled."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return per.agg(
        F.count("*").alias("containers"),
        F.ceil(F.sum("tokens") / capacity).cast("long").alias("least_containers"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count("*") * capacity), 6).alias("filled"),
    )
