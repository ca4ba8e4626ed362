"""The manifest: candidates, scores, matched symbols, cap, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import is_doc
from lodestone.operators.graph import ADJACENCY_BONUS, HOPS, adjacency, expand
from lodestone.tables import cut

MAX_EXPAND, MATCHED, MATCH_ROWS, WHOLE_FILE_LINES = 10, 6, 40, 50


def matched_symbols(dense_top: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, n, name, kind, start_line, end_line): of the best rows at most MATCHED a file, without repeats and sections."""
    best = dense_top.orderBy(F.desc("score"), "ord").limit(MATCH_ROWS).select("ord", "score")
    c = best.join(chunks.where("kind <> 'doc'"), "ord").groupBy("file", F.col("symbol").alias("name"), "start_line")
    once = c.agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "kind", "end_line")).alias("m"))
    n = F.row_number().over(Window.partitionBy("file").orderBy("m.s", "m.ord"))
    return once.select("file", n.cast("long").alias("n"), "name", "m.kind", F.col("start_line").cast("long").alias("start_line"), F.col("m.end_line").cast("long").alias("end_line")).where(F.col("n") <= MATCHED)


def whole_file(files: DataFrame) -> DataFrame:
    """(file, whole): files of few lines are given whole; lines as counted when the file was indexed."""
    return files.select("file", (F.coalesce("n_lines", F.lit(1 << 30)) <= WHOLE_FILE_LINES).alias("whole"))


def manifest(weighted: DataFrame, seeds: DataFrame, edges: DataFrame, files: DataFrame, matched: DataFrame, hops: int = HOPS, max_expand: int = MAX_EXPAND, chunks: DataFrame | None = None, bonus: float = ADJACENCY_BONUS) -> DataFrame:
    """(pos, file, pkg, reason, score, whole, symbols): seeds and the best of what they are linked with.

    A file without a package of its own has that of its `chunks`, if they are given and name one.
    """
    seeds = cut(seeds.select("pos", "file"))
    grown = expand(seeds, edges, hops)
    candidates = seeds.select("file", F.lit(0).cast("long").alias("hop"), "pos", F.when(is_doc(F.col("file")), "doc").otherwise("query-match").alias("reason")).unionByName(grown.select("file", "hop", "pos", "reason"))
    scored = candidates.join(weighted.select("file", F.col("score").alias("base")), "file", "left").join(adjacency(candidates, seeds, edges), "file")
    scored = scored.withColumn("score", F.round(F.coalesce("base", F.lit(0.0)) + F.lit(bonus) * F.col("adjacent"), 9))
    order = [F.desc("score"), F.asc("hop"), F.asc("pos")]
    kept = scored.where("hop = 0").unionByName(scored.where("hop > 0").orderBy(*order).limit(max_expand))
    names = matched.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("n", "name"))).alias("m")).select("file", F.array_join(F.col("m.name"), ",").alias("symbols"))
    # Seeds and MAX_EXPAND files: a list of fixed length.
    placed = kept.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))
    described = placed.join(files.select("file", F.col("pkg").alias("pkg"), "n_lines"), "file", "left").join(names, "file", "left")
    if chunks is not None:
        by_chunk = chunks.where("pkg is not null").select("file", F.col("pkg").alias("chunk_pkg")).join(placed.select("file"), "file", "left_semi").groupBy("file").agg(F.min("chunk_pkg").alias("chunk_pkg"))
        described = described.join(by_chunk, "file", "left").withColumn("pkg", F.coalesce("pkg", "chunk_pkg"))
    return described.select("pos", "file", F.coalesce("pkg", F.lit("root")).alias("pkg"), "reason", "score", (F.coalesce("n_lines", F.lit(1 << 30)) <= WHOLE_FILE_LINES).alias("whole"), F.coalesce("symbols", F.lit("")).alias("symbols"))


def entries_symbols(entries: DataFrame, matched: DataFrame) -> DataFrame:
    """(pos, file, n, name, kind, start_line, end_line): the matched symbols of the entries."""
    return entries.select("pos", "file").join(matched, "file").select("pos", "file", "n", "name", "kind", "start_line", "end_line")


def render(entries: DataFrame) -> DataFrame:
    """(pos, line): the manifest as text lines."""
    line = F.concat(F.rpad("reason", 16, " "), F.lit(" "), F.format_string("%.3f", "score"), F.lit("  "), F.col("file"), F.when(F.col("whole"), "  (whole file)").otherwise(""))
    return entries.select("pos", line.alias("line"))
