"""The relational part of editing: op streams, anchors, guards, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.paths import node_id, node_prefix

# The words that open an operation.
OPENERS = ("STRUCTURAL_EDIT", "CRITICAL_REFACTOR", "MOVE_FILE", "CREATE_FILE", "DELETE_FILE")

_REST = r"(\S[^\n]*?)"
_PATH = r"(\S+)"
#: Of each operation: its opener, the form of its first line, the headers that must follow (those with a text first to last), and the columns of what is captured.
FORMS = {
    "RENAME": ("CRITICAL_REFACTOR", rf"RENAME\s+{_PATH}\s+TO\s+([A-Za-z_$][\w$]*)", [], ["node_id", "new_name"]),
    "MOVE_FILE": ("MOVE_FILE", rf"{_PATH}\s+TO\s+{_PATH}", [], ["from_path", "to_path"]),
    "DELETE_FILE": ("DELETE_FILE", _REST, [], ["path"]),
    "CREATE_FILE": ("CREATE_FILE", _REST, ["CODE"], ["path", "code"]),
    "SET_BODY": ("STRUCTURAL_EDIT", _REST, ["CODE"], ["node_id", "body"]),
    "REPLACE_NODE": ("STRUCTURAL_EDIT", _REST, ["CODE"], ["node_id", "code"]),
    "INSERT_BEFORE": ("STRUCTURAL_EDIT", _REST, ["CODE"], ["node_id", "code"]),
    "REPLACE_TEXT": ("STRUCTURAL_EDIT", _REST, ["OLD", "NEW"], ["node_id", "old_text", "new_text"]),
}


def _form(op: str) -> str:
    """The regular expression of a whole block: everything up to the next opener."""
    opener, first, headers, _ = FORMS[op]
    action = rf"(?:[ \t]*\n)*[ \t]*ACTION:[ \t]*(?i:{op})[ \t]*(?:\n|$)" if opener == "STRUCTURAL_EDIT" else ""
    texts = "".join(rf"(?:[ \t]*\n)*[ \t]*{h}:[ \t]*(?:\n|$)(.*{'' if h == headers[-1] else '?'})" for h in headers)
    return rf"(?s)^[ \t]*{opener}:[ \t]*{first}[ \t]*(?:\n|$){action}{texts}{'$' if headers else ''}"


def parse_ops(streams: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, op_index, op_type, ...): the operations of each stream; a malformed stream has one row with the error and no op.

    A stream is cut at the lines that open an operation; each block has to have the form of its
    operation, and lines behind it are noise. Built-in functions alone, row by row: no Python,
    no shuffle. Null, empty and noise-only streams have no row.
    """
    any_opener = rf"[ \t]*(?:{'|'.join(OPENERS)}):"
    blocks = F.filter(F.split(F.col(text_col), rf"(?m)(?=^{any_opener})"), lambda b: b.rlike(rf"^{any_opener}"))
    text = lambda b, op, i: F.regexp_replace(F.regexp_extract(b, _form(op), i), r"^\n+|\n+\z", "")
    columns = [f.name for f in schemas.OPS.fields if f.name not in ("op_index", "op_type", "error")]

    def operation(block: Column) -> Column:
        kind, values = F.lit(None).cast("string"), dict.fromkeys(columns, F.lit(None).cast("string"))
        for op in FORMS:
            kind = F.when(block.rlike(_form(op)), op).otherwise(kind)
            for i, name in enumerate(FORMS[op][3], 1):
                values[name] = F.when(block.rlike(_form(op)), text(block, op, i)).otherwise(values[name])
        wrong = F.when(kind.isNull(), F.concat(F.lit("no operation has this form: "), F.substring_index(F.trim(block), "\n", 1)))
        return F.struct(F.coalesce(kind, F.lit("ERROR")).alias("op_type"), *[values[c].alias(c) for c in columns], wrong.alias("error"))

    ops = streams.select(F.col(id_col).alias("_id"), F.transform(blocks, operation).alias("ops"))
    failed = F.filter("ops", lambda o: o["op_type"] == "ERROR")
    sound = ops.select("_id", F.posexplode(F.when(F.size(failed) > 0, F.slice(failed, 1, 1)).otherwise(F.col("ops"))).alias("op_index", "op"))
    return sound.select(F.col("_id").alias(id_col), "op_index", *[F.col(f"op.{f.name}").alias(f.name) for f in schemas.OPS.fields if f.name != "op_index"])


def node_ids(symbols: DataFrame) -> DataFrame:
    """(file, start_line, name, node_id): symbols with their edit anchors; the nth of the same name in a file ends in ~n."""
    prefix = node_prefix(F.col("kind"))
    s = symbols.select("file", "start_line", "name", prefix.alias("prefix")).where(F.col("prefix").isNotNull())
    index = F.row_number().over(Window.partitionBy("file", "prefix", "name").orderBy("start_line")) - 1
    return s.withColumn("i", index).select("file", F.col("start_line").cast("long").alias("start_line"), "name", node_id(F.col("file"), F.col("prefix"), F.col("name"), F.col("i")).alias("node_id"))


def resolve_anchors(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, matches, file): a path as given, or the one file that ends in it at a directory boundary; null if several do.

    Each file is known by all its endings: an equi join, not a comparison of all with all.
    """
    parts = F.split("file", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    by_tail = files.select("file").distinct().select("file", F.explode(tails).alias("path"))
    j = wanted.select("path").distinct().join(by_tail, "path", "left")
    exact = F.max(F.when(F.col("file") == F.col("path"), F.col("file")))
    found = j.groupBy("path").agg(F.count("file").alias("matches"), exact.alias("exact"), F.min("file").alias("only"))
    return found.select("path", "matches", F.coalesce("exact", F.when(F.col("matches") == 1, F.col("only"))).alias("file"))


def replace_unique(text: Column, old: Column, new: Column) -> Column:
    """The text with `old` (taken literally) replaced if it occurs exactly once, else null."""
    at = F.instr(text, old)
    rest = F.substr(text, at + 1)
    once = (at > 0) & (F.instr(rest, old) == 0) & (F.length(old) > 0)
    return F.when(once, F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old))))


def rename_guards(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name, new_name, refused): why a rename is refused: foreign (not the project's own file), collision, kind; or null."""
    own = symbols.select("file", "name", "kind").distinct()
    taken = own.select("file", F.col("name").alias("new_name")).distinct().withColumn("taken", F.lit(True))
    j = requests.join(own, ["file", "name"], "left").join(taken, ["file", "new_name"], "left")
    why = F.when(F.contains("file", F.lit("node_modules/")) | F.endswith("file", F.lit(".d.ts")), "foreign").when(F.col("taken"), "collision").when(~F.col("kind").isin("function", "class", "interface", "type", "enum", "const", "method"), "kind").when(F.col("kind").isNull(), "unknown")
    return j.select("file", "name", "new_name", why.alias("refused"))


def delete_guard(deletes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, importers, allowed): a file goes only if no other file imports it."""
    n = edges.where("src <> dst").groupBy(F.col("dst").alias("file")).agg(F.countDistinct("src").alias("importers"))
    j = deletes.select("file").distinct().join(n, "file", "left")
    return j.select("file", F.coalesce("importers", F.lit(0)).cast("long").alias("importers"), (F.coalesce("importers", F.lit(0)) == 0).alias("allowed"))


def move_files(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges after files moved (from_path, to_path), at both ends."""
    m = moves.groupBy("from_path").agg(F.min("to_path").alias("to_path"))
    src = edges.join(m.select(F.col("from_path").alias("src"), F.col("to_path").alias("new_src")), "src", "left")
    both = src.join(m.select(F.col("from_path").alias("dst"), F.col("to_path").alias("new_dst")), "dst", "left")
    return both.select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst")).distinct()


def create_files(files: DataFrame, creates: DataFrame) -> DataFrame:
    """(path, refused): whether each new file (path) is refused because it exists or is created twice; null where it is not."""
    own = creates.groupBy("path").agg(F.count("*").alias("n"))
    there = files.select(F.col("file").alias("path")).distinct().withColumn("there", F.lit(True))
    why = F.when(F.col("there"), "exists").when(F.col("n") > 1, "twice")
    return own.join(there, "path", "left").select("path", why.alias("refused"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, deleted or changed between two snapshots."""
    j = before.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a")).join(after.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b")), key, "full_outer")
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(key, change.alias("change")).where(F.col("change").isNotNull())


def new_diagnostics(baseline: DataFrame, now: DataFrame) -> DataFrame:
    """Diagnostics (file, line, code, message) whose file, code and message are not in the baseline, wherever they stand."""
    key = F.concat_ws("::", "file", F.col("code").cast("string"), "message")
    return now.withColumn("_key", key).join(baseline.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def diagnostics_to_ops(diagnostics: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """(file, line, op_index): the first op whose span (file, op_index, first, last) holds a diagnostic's line.

    A range join by blocks of `width` lines: a span is listed in each block it touches.
    """
    s = spans.select("file", "op_index", "first", "last", F.explode(F.sequence((F.col("first") / width).cast("int"), (F.col("last") / width).cast("int"))).alias("block"))
    d = diagnostics.select("file", "line", (F.col("line") / width).cast("int").alias("block"))
    return d.join(s, ["file", "block"]).where("line between first and last").groupBy("file", "line").agg(F.min("op_index").cast("long").alias("op_index"))
