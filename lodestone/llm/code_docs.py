"""Functions paired with their documentation (problem 1): an as-of join of function spans and comment spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.code_spans import spans_of
from lodestone.llm.doc_text import says_something

#: Files whose functions are read.
CODE = r"\.(ts|tsx|js)$"

_SPAN = "array<struct<is_comment:boolean,first:int,last:int,name:string,body:string>>"


def _spans_udf():
    @F.pandas_udf(_SPAN)
    def spans(contents: pd.Series) -> pd.Series:
        def one(text: str) -> list[tuple[bool, int, int, str | None, str]]:
            runs, functions = spans_of(text)
            lines = text.splitlines() if functions else []
            return [(True, a, b, None, t) for a, b, t in runs] + [(False, a, b, n, lines[a].strip()[:140] if a < len(lines) else "") for n, a, b in functions]

        return contents.map(one)

    return spans


def _says_something_udf():
    @F.pandas_udf("boolean")
    def telling(names: pd.Series, comments: pd.Series) -> pd.Series:
        return pd.Series([says_something(n, c) for n, c in zip(names, comments)], dtype=bool)

    return telling


def spans(files: DataFrame, file_col: str, content_col: str) -> DataFrame:
    """(file, row, is_comment, first, last, name, body): every comment run and every function of the code files."""
    code = files.select(F.col(file_col).alias("file"), F.col(content_col).alias("_content"), F.monotonically_increasing_id().alias("row"))
    code = code.where(F.col("file").rlike(CODE) & F.col("_content").isNotNull())
    return code.select("file", "row", F.explode(_spans_udf()("_content")).alias("s")).select("file", "row", "s.*")


def documented_functions(files: DataFrame, file_col: str = "file", content_col: str = "content", any_comment: bool = False) -> DataFrame:
    """Functions and methods with the comment that documents them: (file, name, signature, doc, line, end_line).

    Comment runs and functions are found independently in each file. An as-of join by line
    attaches the nearest run that ends before a function's first declaration; a run counts
    only if it ends on the line right above, so that no statement and no empty line comes
    between. Pairs whose comment says no more than the name are dropped (`any_comment`
    keeps them). Functions are top-level functions, top-level constants with a function
    value and methods of top-level classes (`Class.method`); see `code_spans`.

    One shuffle by file row; a file's spans are all that a window ever holds. Files read
    twice give equal pairs twice. Null names of files or contents, empty texts and other
    endings give none; an empty table gives an empty result; other columns are not read.
    """
    by_line = Window.partitionBy("row").orderBy("first", F.desc("is_comment"))
    nearest = F.last(F.when(F.col("is_comment"), F.struct("last", "body")), ignorenulls=True).over(by_line)
    # A comment run starts before it ends, and spans do not overlap: ordering by the first line is ordering by the end.
    joined = spans(files, file_col, content_col).withColumn("comment", nearest).where(~F.col("is_comment") & (F.col("comment.last") == F.col("first") - 1))
    pairs = joined.select("file", "name", F.col("body").alias("signature"), F.col("comment.body").alias("doc"), (F.col("first") + 1).alias("line"), (F.col("last") + 1).alias("end_line"))
    return pairs if any_comment else pairs.where(_says_something_udf()("name", "doc"))
