"""Structure of a source tree: owners, directory profiles, templates, sections, slices, chunk projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import basename, dirname, file_suffix

DOC_NAMES = ("README.md", "AGENTS.md", "CLAUDE.md", "ARCHITECTURE.md")
TEXT_CHARS, SIGNATURE_CHARS, NAME_CHARS = 1500, 140, 80


def ancestors(path: Column) -> Column:
    """All directories above a path, and '.' for the top."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.concat(F.array(F.lit(".")), above)


def owners(files: DataFrame, packages: DataFrame, fallback: str | None = None) -> DataFrame:
    """(file, owner): the package with the longest directory above each file; '.' owns the rest, without it `fallback`.

    The prefix join is an equi join on a file's directories: no comparison of all with all.
    """
    own = files.select("file").distinct().select("file", F.explode(ancestors(F.col("file"))).alias("dir"))
    near = own.join(packages.select("dir", "name"), "dir")
    best = near.groupBy("file").agg(F.min_by("name", F.struct((-F.when(F.col("dir") == ".", 0).otherwise(F.length("dir"))).alias("l"), "name")).alias("owner"))
    return files.select("file").distinct().join(best, "file", "left").select("file", F.coalesce("owner", F.lit(fallback)).alias("owner"))


def directories(files: DataFrame) -> DataFrame:
    return files.select("file").distinct().select("file", dirname(F.col("file")).alias("dir"), file_suffix(basename(F.col("file"))).alias("suffix"))


def suffix_histogram(ts_files: DataFrame) -> DataFrame:
    return directories(ts_files).groupBy("dir", "suffix").agg(F.count("*").alias("n"))


def profile(ts_files: DataFrame, all_files: DataFrame) -> DataFrame:
    """(dir, files, suffixes, doc): files of each directory by suffix, and its first known document."""
    counts = suffix_histogram(ts_files).groupBy("dir").agg(
        F.sum("n").alias("files"),
        # As many entries as there are kinds of endings.
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "suffix", F.col("n").cast("string")))), ",").alias("suffixes"),
    )
    name = basename(F.col("file"))
    rank = F.array_position(F.array(*[F.lit(n) for n in DOC_NAMES]), name)
    docs = all_files.select("file").where(name.isin(*DOC_NAMES)).select(dirname(F.col("file")).alias("dir"), name.alias("doc"), rank.alias("r"))
    first = docs.groupBy("dir").agg(F.min_by("doc", "r").alias("doc"))
    return counts.join(first, "dir", "left").select("dir", "files", "suffixes", "doc")


def templates(ts_files: DataFrame, containers: bool = False) -> DataFrame:
    """(dir, template, modules): endings that at least half of a directory's child directories have, two or more of them.

    A directory that holds no file itself has no profile and no template, unless `containers` asks for it.
    """
    shapes = directories(ts_files).select("dir", "suffix").distinct()
    child = shapes.where("dir <> ''").withColumn("parent", dirname(F.col("dir")))
    parents = shapes.select(F.col("dir").alias("parent")).distinct()
    n = child.groupBy("parent").agg(F.countDistinct("dir").alias("modules")).where("modules >= 2")
    common = child.groupBy("parent", "suffix").agg(F.count("*").alias("c")).join(n, "parent").where(F.col("c") >= F.ceil(F.col("modules") / 2))
    found = common.groupBy("parent", "modules").agg(F.sort_array(F.collect_list("suffix")).alias("t")).where(F.size("t") >= 2)
    found = found if containers else found.join(parents, "parent", "left_semi")
    return found.select(F.col("parent").alias("dir"), F.array_join("t", ",").alias("template"), "modules")


def top_suffixes(ts_files: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("dir").orderBy(F.desc("n"), "suffix")
    return suffix_histogram(ts_files).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n).select("dir", "place", "suffix", "n")


def sections(docs: DataFrame) -> DataFrame:
    """(file, section, title, start_line, end_line, name, text): Markdown cut at headings of levels 1 to 3.

    Lines before the first heading are a section named by the file; a blank one is dropped.
    """
    lines = docs.select("file", F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("line", "body"))
    heading = F.regexp_extract("body", r"^#{1,3}\s+(.+)", 1)
    w = Window.partitionBy("file").orderBy("line")
    marked = lines.select("file", "line", "body", heading.alias("title")).withColumn("section", F.sum(F.when(F.col("title") != "", 1).otherwise(0)).over(w))
    # A section's lines belong to one file, whose text already was one value.
    made = marked.groupBy("file", "section").agg(
        F.min("line").alias("first"), F.max("line").alias("last"), F.max("title").alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n").alias("body"),
    ).where(F.col("body").rlike(r"\S"))
    base = basename(F.col("file"))
    title = F.when(F.col("section") == 0, base).otherwise(F.regexp_replace("title", r"^\s+|\s+$", ""))
    return made.select(
        "file", F.col("section").cast("long").alias("section"), title.alias("title"),
        (F.col("first") + 1).cast("long").alias("start_line"), (F.col("last") + 1).cast("long").alias("end_line"),
        F.substring(F.concat(base, F.lit(":"), title), 1, NAME_CHARS).alias("name"),
        F.substring(F.concat(F.lit("doc "), title, F.lit("\n"), F.col("body")), 1, TEXT_CHARS).alias("text"),
    )


def slice_lines(contents: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, lines, text): the union of a file's line ranges, each line once, in order."""
    wanted = ranges.select("file", F.explode(F.sequence("start_line", "end_line")).alias("n")).distinct()
    lines = contents.select("file", F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("line", "body")).withColumn("n", F.col("line") + 1)
    kept = lines.join(wanted, ["file", "n"])
    return kept.groupBy("file").agg(F.count("*").alias("lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), "\n").alias("text"))


def project_chunks(symbols: DataFrame, body: str, *also: str) -> DataFrame:
    """(id, signature, text, also): id file#name@line, first line as signature, text of kind and name, doc and the body's beginning."""
    trimmed = F.regexp_replace(F.split_part(F.regexp_replace(body, r"^\s+", ""), F.lit("\n"), F.lit(1)), r"\s+$", "")
    return symbols.select(
        F.concat("file", F.lit("#"), "symbol", F.lit("@"), F.col("start_line").cast("string")).alias("id"),
        F.substring(trimmed, 1, SIGNATURE_CHARS).alias("signature"),
        F.concat_ws("\n", F.concat_ws(" ", "kind", "symbol"), F.when(F.col("doc") != "", F.col("doc")), F.when(F.col(body) != "", F.substring(body, 1, TEXT_CHARS))).alias("text"),
        *also,
    )
