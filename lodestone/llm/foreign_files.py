"""Generated, minified or vendored source files (problem 2): Merkle hashes of directories, header and layout rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.tables import ensure_checkpoint_dir

#: Markdown is never a case.
MARKDOWN = r"(?i)\.mdx?$"
#: A shared subtree counts from so many files and characters; smaller ones (a lone index file) are alike by chance.
SUBTREE_FILES, SUBTREE_CHARS = 2, 1000

# Directories and endings that tools and package managers use.
PATH_RULES = {
    "vendored": r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|vendored|third[_-]?party|external|externals|forks?)/|(?:^|/)[a-z0-9_.-]+-\d+\.\d+\.\d+/",
    "generated": r"(?i)(?:^|/)(?:__generated__|generated|codegen-out|codegen|\.next|\.nuxt)/|\.(?:gen|generated|g)\.[jt]sx?$|_pb\.[jt]s$|_grpc_pb\.[jt]s$|\.pb\.[jt]s$",
    "built": r"(?i)(?:^|/)(?:dist|build/static|out-tsc|coverage)/|\.min\.[cm]?js$|\.bundle\.[cm]?js$|\.chunk\.[cm]?js$|(?:^|/)chunk-[^/]+\.js$",
}

# What tools and copies say of themselves in the comments a file opens with.
GENERATED = re.compile(
    r"auto-?generated|automatically generated|generated automatically|@generated\b|code generated by|generated by \S+ ?(?:v?\d|from|at|on|\.|$)|produced automatically|machine-(?:made|generated|written)|this file (?:is|was) (?:auto|generated|produced)"
    r"|do not (?:edit|modify|change)(?: (?:this|it|by hand|manually|directly|the generated)|[.!;,]|\s*$)|changes (?:made here )?(?:will be|get|are) (?:lost|overwritten)|regenerate (?:rather|instead|with|it)|:output sha=|output, revision|emitted from \S+\.\w+|^\W*sourceHash \w+|<auto-generated|any changes will be"
    r"|gerado por \S+ ?v?\d|generado por \S+ ?v?\d|generiert von \S+ ?v?\d|erzeugt von \S+ ?v?\d|généré par \S+ ?v?\d|cambios manuales se|alterações manuais|manuelle änderungen|modifications manuelles|gerado automaticamente|não edite|generado automáticamente|no editar|no modificar|automatisch (?:generiert|erzeugt|erstellt)|nicht (?:bearbeiten|ändern|editieren)|généré automatiquement|ne pas modifier",
    re.I | re.M,
)
VENDORED = re.compile(
    r"@license \S+ v?\d|^\s*\S*\s*vendored\b[: ]|\bvendored (?:from|copy)|bundled copy|imported verbatim|copied (?:verbatim )?from the \S+ (?:distribution|project|repository|package)|third[- ]party code|released under the \S+ licen[cs]e|licen[cs]e: see (?:the )?notice"
    r"|redistributed with permission|upstream (?:commit|tag|licen[cs]e|version)|local changes: none|\(c\) the \S+ (?:contributors|authors)",
    re.I | re.M,
)
COMPILED = re.compile(r"^//[#@] ?sourceMappingURL=|Object\.defineProperty\(exports, ?[\"']__esModule[\"']|^var __(?:awaiter|extends|assign|importDefault|createBinding|decorate) ?=|__webpack_require__|^\"use strict\";\s*\(self\.webpackChunk", re.M)

_HEAD = re.compile(r"\s*(?:(?P<comment>//[^\n]*|/\*.*?\*/)|#![^\n]*|[\"']use \w+[\"'];?|import\b[^;'\"`]*(?:'[^'\n]*'|\"[^\"\n]*\")[ \t]*\)?[ \t]*;?)", re.S)
#: A line of DENSE characters with few spaces was not written by hand; nor were many shorter ones that make up most of a file.
DENSE, DENSE_SPACES, DENSE_SHARE = 300, 0.08, 0.5


def header(text: str) -> str:
    """The comments before the first statement; directives and imports may stand between."""
    parts, at = [], 0
    while (m := _HEAD.match(text, at)) is not None:
        if m["comment"]:
            parts.append(m["comment"])
        at = m.end()
    return "\n".join(parts)


def content_kind(text: str | None) -> str | None:
    """generated, vendored, built or data by the content alone; None for hand-written code."""
    if not text:
        return None
    head = header(text)
    if head:
        if GENERATED.search(head):
            return "generated"
        if VENDORED.search(head):
            return "vendored"
    if COMPILED.search(text):
        return "built"
    dense = 0
    for line in text.split("\n"):
        if len(line) >= 60 and not line.startswith("import") and line.count(" ") < DENSE_SPACES * len(line):
            if len(line) >= DENSE:
                return "built" if "=>" in line or "function" in line or "return" in line else "data"
            dense += len(line)
    return "data" if dense >= 2 * DENSE and dense >= DENSE_SHARE * len(text) else None


def _content_kind_udf():
    @F.pandas_udf("string")
    def kind(contents: pd.Series) -> pd.Series:
        return contents.map(content_kind)

    return kind


def directory_hashes(files: DataFrame, file_col: str, content_col: str) -> DataFrame:
    """(dir, h1, h2, files, chars): Merkle hashes of all directories, bottom-up.

    A directory's hash sums the hashes of its entries' names and hashes: the order of
    entries does not matter, and partial sums keep any directory, however wide, out of a
    single task. One aggregation for each level of the deepest path.
    """
    leaf = files.select(F.col(file_col).alias("path"), F.col(content_col).alias("_c")).where(F.col("path").isNotNull())
    leaf = leaf.groupBy("path").agg(F.max(F.xxhash64("_c")).alias("h1"), F.max(F.hash("_c")).cast("long").alias("h2"), F.max(F.coalesce(F.length("_c"), F.lit(0))).cast("long").alias("chars"))
    ensure_checkpoint_dir(files.sparkSession)
    leaf = leaf.select("path", F.size(F.split("path", "/")).alias("depth"), "h1", "h2", F.lit(1).cast("long").alias("files"), "chars").checkpoint()
    deepest = leaf.agg(F.max("depth")).first()[0] or 0
    found, level = None, None
    for depth in range(deepest, 1, -1):
        own = leaf.where(F.col("depth") == depth).drop("depth")
        entries = own if level is None else own.unionByName(level)
        name = F.substring_index("path", "/", -1)
        level = (
            entries.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
            # Sums wrap around within 40 bits each, far below the width of a long.
            .agg(
                F.sum(F.xxhash64(name, "h1", "h2").bitwiseAND(0xFFFFFFFFFF)).alias("h1"),
                F.sum(F.xxhash64("h2", name, "h1").bitwiseAND(0xFFFFFFFFFF)).alias("h2"),
                F.sum("files").alias("files"), F.sum("chars").alias("chars"),
            )
            .withColumnRenamed("dir", "path")
            .checkpoint()  # each level is read by the next and by the result: without a cut the plan would grow with the square of the depth
        )
        found = level if found is None else found.unionByName(level)
    if found is None:
        return leaf.drop("depth").withColumnRenamed("path", "dir").limit(0)
    return found.withColumnRenamed("path", "dir")


def shared_directories(files: DataFrame, file_col: str, content_col: str, root_depth: int = 2) -> DataFrame:
    """Directories (dir) whose whole subtree also stands under another root (the first `root_depth` path segments), the origin left out.

    The origin is the copy that lies least deep, the first by path of several: what a
    workspace shares stays hand-written in one place. Vendored code that has no origin in the
    workspace loses all but one copy by this, and that one by its path, package or header.
    """
    dirs = directory_hashes(files, file_col, content_col).where((F.col("files") >= SUBTREE_FILES) & (F.col("chars") >= SUBTREE_CHARS))
    dirs = dirs.withColumns({"root": F.substring_index("dir", "/", root_depth), "depth": F.size(F.split("dir", "/"))})
    # One row for each hash, combined before the shuffle: a subtree that a third of all roots have is no hot group.
    shared = dirs.groupBy("h1", "h2").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.min(F.struct("depth", "dir")).alias("_first")).where("_a < _b").select("h1", "h2", F.col("_first.dir").alias("_origin"))
    copies = dirs.join(shared, ["h1", "h2"]).where("dir <> _origin").select("dir").distinct()
    return copies


def _ancestors(path_col: str):
    """All directories above a path."""
    parts = F.split(F.col(path_col), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def foreign_files(files: DataFrame, packages: DataFrame | None = None, file_col: str = "file", content_col: str = "content", pkg_col: str = "pkg") -> DataFrame:
    """Files a tool wrote, built or minified, files copied from a third party, and data saved as code: (file, kind, why).

    `why` is path, package, subtree or content, `kind` generated, built, vendored or data;
    a file has a row for each finding. Paths and packages decide without the content. A
    package is foreign if its name lacks the scope (`@scope/`) that most packages of the
    workspace have and its role is no `docs`; null and padded packages are told by the
    directory. Of subtrees with equal Merkle hashes under different roots all but the origin
    (the least deep, then the first by path) are vendored.
    Contents are judged by the comments they open with and by their layout, one file at a
    time, so that code about generators or with such words in strings stays.

    Markdown is never a case. Null or empty contents can only be found by path, package or
    subtree; null paths never. Files read twice count once. An empty table gives an empty
    result; other columns are not read.
    """
    own = files.select(F.col(file_col).alias("file"), F.col(content_col).alias("_content"), F.trim(F.col(pkg_col)).alias("_pkg")).where(F.col("file").isNotNull() & ~F.col("file").rlike(MARKDOWN))
    kind = None
    for name, rule in PATH_RULES.items():
        kind = F.when(F.col("file").rlike(rule), F.lit(name)) if kind is None else kind.when(F.col("file").rlike(rule), F.lit(name))
    by_path = own.select("file", kind.alias("kind"), F.lit("path").alias("why")).where(F.col("kind").isNotNull())
    by_content = own.where(kind.isNull()).select("file", _content_kind_udf()("_content").alias("kind"), F.lit("content").alias("why")).where(F.col("kind").isNotNull())
    shared = shared_directories(own, "file", "_content")
    by_subtree = own.select("file", F.explode(_ancestors("file")).alias("dir")).distinct().join(shared, "dir", "left_semi").select("file", F.lit("vendored").alias("kind"), F.lit("subtree").alias("why"))
    found = by_path.unionByName(by_content).unionByName(by_subtree)
    if packages is not None:
        named = packages.select(F.trim("name").alias("name"), F.trim("dir").alias("pkg_dir"), F.lower(F.trim("role")).alias("role"))
        scoped = named.agg((F.sum(F.when(F.col("name").startswith("@"), 1).otherwise(0)) * 2 > F.count("*")).alias("most"))
        foreign = named.join(F.broadcast(scoped), F.col("most")).where(~F.col("name").startswith("@") & (F.coalesce("role", F.lit("")) != "docs")).select("name", "pkg_dir").distinct()
        foreign_dirs = foreign.select(F.col("pkg_dir").alias("dir")).where("dir is not null and dir not in ('', '.')")
        by_name = own.join(foreign.select(F.col("name").alias("_pkg")), "_pkg", "left_semi").select("file")
        by_dir = own.select("file", F.explode(_ancestors("file")).alias("dir")).distinct().join(foreign_dirs, "dir", "left_semi").select("file")
        found = found.unionByName(by_name.unionByName(by_dir).select("file", F.lit("vendored").alias("kind"), F.lit("package").alias("why")))
    return found.distinct().withColumnRenamed("file", file_col)
