"""Ranking quality and token savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that a keyword search leaves out.
KEYWORD_STOP = ("this", "that", "with", "from", "when", "into", "have", "been", "then", "them")


def estimate_tokens(text: Column) -> Column:
    """A cheap guess at the tokens of code: 1.3 for each piece and one for each 8 characters, at least 1."""
    spaced = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    pieces = F.size(F.filter(F.split(spaced, r"""[\s.,;:(){}\[\]<>="'`+\-*/|&?!]+"""), lambda p: p != ""))
    return F.greatest(F.lit(1), F.floor(pieces * F.lit(1.3) + F.length(text) / 8 + 0.5)).cast("long")


def chars_to_tokens(chars: Column) -> Column:
    return F.floor(chars / 4 + 0.5).cast("long")


def keywords(text: Column) -> Column:
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*KEYWORD_STOP)))


def keyword_grep(files: DataFrame, task: DataFrame) -> DataFrame:
    """One row: files that hold any keyword of the task as a substring, and their characters."""
    q = task.select(keywords(F.col("task")).alias("kw")).limit(1)
    hit = files.crossJoin(F.broadcast(q)).where(F.exists("kw", lambda k: F.contains(F.lower("content"), k)))
    return hit.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("chars"))


def ranks(ranked: DataFrame, items: DataFrame, cut: int) -> DataFrame:
    """(item_id, layer, rank): the best 0-based rank of any expected file, null if none is ranked within `cut`."""
    wanted = items.select("item_id", F.explode(F.array_distinct("expect")).alias("file"))
    found = ranked.where(F.col("rank") <= cut).join(wanted, ["item_id", "file"]).groupBy("item_id").agg((F.min("rank") - 1).alias("rank"))
    return items.select("item_id", "layer").join(found, "item_id", "left")


def metrics(item_ranks: DataFrame) -> DataFrame:
    """(layer, items, passed, mean_rank, mrr): mean rank over passing items, reciprocal rank over all."""
    return item_ranks.groupBy("layer").agg(
        F.count("*").alias("items"), F.count("rank").alias("passed"), F.round(F.avg("rank"), 6).alias("mean_rank"),
        F.round(F.avg(F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0))), 6).alias("mrr"),
    )
