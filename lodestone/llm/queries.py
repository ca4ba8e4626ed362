"""The queries of the numbered problems: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).select("file", "name").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.llm.code_docs import documented_functions

    return documented_functions(table(spark, d, "source_files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_files(spark, d).select("file").distinct()


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.llm.foreign_files import foreign_files

    return foreign_files(table(spark, d, "source_files"), table(spark, d, "packages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.llm.neighbours import nearest

    near = nearest(table(spark, d, "vectors"), "ord", "embedding", k=10, dims=64)
    return near.select(F.least("ord", "neighbour").alias("ord_a"), F.greatest("ord", "neighbour").alias("ord_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of every row whose ord is divisible by 50, among all rows."""
    from lodestone.llm.neighbours import nearest

    return nearest(table(spark, d, "vectors"), "ord", "embedding", k=10, dims=64, queries=F.col("_id") % 50 == 0)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.llm.splitting import split_items

    return split_items(table(spark, d, "chunks"), "ord", "text", "start_line", "end_line", 1500, 150)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("pieces > 1").select("ord").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.llm.near_duplicates import near_duplicate_pairs

    pairs = near_duplicate_pairs(table(spark, d, "chunks"), "ord", "text", size=3, threshold=0.5)
    return pairs.select(F.col("id_a").alias("ord_a"), F.col("id_b").alias("ord_b"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between different texts, each by its smallest ord."""
    from lodestone.llm.near_duplicates import near_duplicate_links

    return near_duplicate_links(table(spark, d, "chunks"), "ord", "text").select(F.col("id_a").alias("ord_a"), F.col("id_b").alias("ord_b"), F.round("similarity", 6).alias("similarity"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.llm.near_duplicates import near_duplicate_groups

    return near_duplicate_groups(table(spark, d, "chunks"), "ord", "text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.llm.packing import pack

    return pack(table(spark, d, "documents"), "doc_id", "text", 512)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("pieces > 1").select("doc_id").distinct()


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.llm.packing import fill

    return fill(_packed(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.llm.leakage import find_leaks

    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "task")


def p7_removals(spark: SparkSession, d: str) -> DataFrame:
    """The words to cut from each document, the passages of all items merged."""
    from lodestone.llm.leakage import removal_spans

    return removal_spans(p7_leaks(spark, d), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_residue(spark, d).select("doc_id").distinct()


def p8_residue(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.llm.residue import detect_residue

    return detect_residue(table(spark, d, "documents"), "doc_id", "text")


def p8_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Documents to leave out as a whole, by the share of their text that is residue."""
    from lodestone.llm.residue import excluded

    return excluded(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm.sql import ORACLES

    return dict(ORACLES)
