"""From the texts of a workspace to the tables of an index: symbols, chunks, edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.code import symbols_of
from lodestone.functions.paths import is_doc
from lodestone.operators import edits, graph, maintenance, structure
from lodestone.operators.ranking import global_rank
from lodestone.tables import cut

#: The order of symbols within a file.
KINDS = ("function", "class", "method", "interface", "type", "enum", "const", "doc")


def extract_symbols(contents: DataFrame) -> DataFrame:
    """(file, name, kind, start_line, end_line, doc, signature, body) of the declarations in (file, content).

    Markdown has none; null and empty texts neither. A file that comes twice is read twice.
    """

    def read(batches):
        for pdf in batches:
            rows = [(f, *s) for f, t in zip(pdf["file"], pdf["content"]) for s in symbols_of(t)]
            yield pd.DataFrame(rows, columns=["file", "name", "kind", "start_line", "end_line", "doc", "signature", "body"])

    code = contents.where(F.col("content").isNotNull() & ~is_doc(F.col("file"))).select("file", "content")
    return code.mapInPandas(read, "file string, name string, kind string, start_line int, end_line int, doc string, signature string, body string")


def chunks_of(contents: DataFrame, packages: DataFrame, after: int = -1, fallback: str | None = None) -> DataFrame:
    """The chunks of (file, content): one for each symbol and each section of a document, numbered from `after` + 1 by file, kind and line; `fallback` is the package of files under none."""
    s = extract_symbols(contents).join(structure.owners(contents.where(~is_doc(F.col("file"))), packages, fallback).withColumnRenamed("owner", "pkg"), "file", "left")
    made = structure.project_chunks(s.withColumnRenamed("name", "symbol"), "body", "file", "pkg", "symbol", "kind", "start_line", "end_line", "doc")
    docs = structure.sections(contents.where(is_doc(F.col("file")))).select(
        F.concat("file", F.lit("#"), "title", F.lit("@"), F.col("start_line").cast("string")).alias("id"), F.substring("title", 1, structure.SIGNATURE_CHARS).alias("signature"), "text",
        "file", F.lit("docs").alias("pkg"), F.col("name").alias("symbol"), F.lit("doc").alias("kind"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.lit(None).cast("string").alias("doc"),
    )
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    # Methods follow their class.
    owner = F.when(F.col("kind") == "method", F.substring_index("symbol", ".", 1)).otherwise(F.col("symbol"))
    ranked = made.unionByName(docs).withColumns({"_place": F.when(F.col("kind") == "method", 2).otherwise(place), "_owner": F.when(F.col("kind").isin("class", "method"), owner), "_method": F.col("kind") == "method"})
    ordered = global_rank(ranked, F.asc("file"), F.asc("_place"), F.asc_nulls_first("_owner"), F.asc("_method"), F.asc("start_line"), F.asc("symbol"), name="_place_in_all")
    return ordered.withColumn("ord", F.col("_place_in_all") + F.lit(after)).withColumnRenamed("id", "chunk_id").select([f.name for f in schemas.CHUNKS.fields])


def edges_of(contents: DataFrame, files: DataFrame, packages: DataFrame, index: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Import edges (src, dst) of the code in (file, content) between files that are indexed."""
    found = graph.statements(contents.where(~is_doc(F.col("file"))))
    targets = graph.import_targets(found.select("src", "spec", "name"), found, files, packages, index, aliases)
    return targets.select("src", F.col("target").alias("dst")).distinct()


def refresh(index: dict[str, DataFrame], before: DataFrame, after: DataFrame, packages: DataFrame, fallback: str | None = None, aliases: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The index after an edit: `before` and `after` have (file, content) of the whole workspace on both sides of it.

    Only files whose texts differ are read and chunked; what was deleted goes. Numbers of new
    chunks follow the last one of the index. New chunks have no vectors until they are embedded.
    """
    diff = cut(edits.snapshot_diff(before, after, "file", "content"))
    changed = cut(after.join(diff.where("change <> 'deleted'"), "file", "left_semi").select("file", "content"))
    last = index["doclen"].agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    chunks = cut(chunks_of(changed, packages, last, fallback))
    owner = structure.owners(changed, packages, fallback)
    files = changed.join(owner, "file").select(
        "file", F.when(is_doc(F.col("file")), "docs").otherwise(F.col("owner")).alias("pkg"), F.lit(None).cast("double").alias("mtime_ms"),
        F.size(F.split("content", "\n", -1)).alias("n_lines"), is_doc(F.col("file")).alias("is_doc"),
    )
    known = index["chunks"].join(diff.select("file"), "file", "left_anti").select("pkg", F.col("symbol").alias("name"), "kind", "file")
    names = graph.symbol_index(known.unionByName(chunks.select("pkg", F.col("symbol").alias("name"), "kind", "file")))
    edges = edges_of(changed, after, packages, names, aliases)
    return maintenance.updated(index, chunks, index["vectors"].limit(0), edges, files, diff.where("change = 'deleted'"))
