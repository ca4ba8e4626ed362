"""Paths, globs, file kinds and node ids as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """An anchored regular expression: ** crosses directories, * and ? stay within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]) if not glob[i].isalnum() and glob[i] not in "/_-" else glob[i])
            i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_to_regex(g))
    return found


def dirname(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalised(path: Column) -> Column:
    """A path without empty, `.` and `..` parts; what leads above the top is cut off."""
    empty = F.expr("cast(array() as array<string>)")
    step = lambda kept, part: (
        F.when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(part.isin("", "."), kept).otherwise(F.concat(kept, F.array(part)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def is_ts(path: Column) -> Column:
    return path.rlike(r"\.tsx?$") & ~path.rlike(r"\.d\.ts$")


def is_doc(path: Column) -> Column:
    return path.rlike(r"\.mdx?$")


def file_suffix(name: Column) -> Column:
    """foo.service.ts -> .service.ts, index.ts -> index, Bar.tsx -> .tsx, otherwise the extension or the name."""
    double = F.regexp_extract(name, r"(\.[A-Za-z0-9-]+\.tsx?)$", 1)
    single = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.when(name.rlike(r"^index\.tsx?$"), "index").when(double != "", double).when(single != "", single).otherwise(name)


NODE_KINDS = {"function": "fn", "class": "cls", "method": "meth", "interface": "iface", "type": "type", "enum": "enum", "const": "var"}


def node_prefix(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in NODE_KINDS.items() for x in kv])[kind]


def node_id(path: Column, prefix: Column, name: Column, index: Column) -> Column:
    return F.concat(path, F.lit("#"), prefix, F.lit("_"), name, F.when(index > 0, F.concat(F.lit("~"), index.cast("string"))).otherwise(""))


def parse_node_id(node: Column) -> Column:
    """struct(path, prefix, name, index), null for an id without # or with an unknown prefix."""
    path = F.regexp_extract(node, r"^([^#]*)#", 1)
    rest = F.regexp_replace(node, r"^[^#]*#", "")
    has_index = rest.rlike(r"~\d*$")
    locator = F.when(has_index, F.regexp_replace(rest, r"~\d*$", "")).otherwise(rest)
    digits = F.regexp_extract(rest, r"~(\d*)$", 1)
    prefix = F.regexp_extract(locator, r"^([^_]*)_", 1)
    name = F.regexp_replace(locator, r"^[^_]*_", "")
    ok = F.contains(node, F.lit("#")) & F.contains(locator, F.lit("_")) & prefix.isin(*NODE_KINDS.values()) & (name != "")
    index = F.when(has_index & (digits != ""), digits.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return F.when(ok, F.struct(path.alias("path"), prefix.alias("prefix"), name.alias("name"), index.alias("index")))
