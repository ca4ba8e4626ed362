"""Splitting oversized items at natural boundaries (problem 4): lexical-cohesion segmentation."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units on either side of a gap whose words are compared, and the width of their hashed word vectors.
BLOCK, WIDTH = 4, 256
#: Units compared at once.
SLICE = 2_000
#: A line longer than this is cut into sentences, and those at spaces, to have boundaries inside it.
UNIT = 240
#: What a boundary adds to the depth of its valley: an empty line or heading, a line end, a sentence end, a space, none.
STRENGTH = {"block": 0.3, "line": 0.15, "sentence": 0.1, "space": 0.0, "none": -1.0}

_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"(?<=[.!?;。！？])\s+")


@lru_cache(maxsize=100_000)
def _slot(word: str) -> int:
    return crc32(word.encode()) % WIDTH


def _units(text: str) -> tuple[list[int], list[str]]:
    """Ends of the smallest units, and the kind of boundary at each end."""
    ends, kinds, at = [], [], 0
    for line in text.splitlines(keepends=True):
        begin, at = at, at + len(line)
        if len(line) > UNIT:
            cut = begin
            for stop in [*(begin + m.end() for m in _SENTENCE_END.finditer(line)), at]:
                while stop - cut > UNIT:
                    space = text.rfind(" ", cut + UNIT // 2, cut + UNIT)
                    ends.append(space + 1 if space > 0 else cut + UNIT)
                    kinds.append("space" if space > 0 else "none")
                    cut = ends[-1]
                if cut < stop < at:
                    ends.append(stop)
                    kinds.append("sentence")
                    cut = stop
        ends.append(at)
        follows = text[at : at + 1]
        kinds.append("block" if not line.strip() or follows in ("\n", "\r", "#") else "line")
    return ends, kinds


def _similarities(units: list[str]) -> np.ndarray:
    """Cosine of the words of up to BLOCK units before and behind the end of each unit."""
    n = len(units)
    keys = [u * WIDTH + _slot(w) for u, unit in enumerate(units) for w in _WORD.findall(unit.lower())]
    bags = np.bincount(keys, minlength=n * WIDTH).reshape(n, WIDTH).astype(np.float64)
    upto = np.vstack([np.zeros(WIDTH), np.cumsum(bags, axis=0)])
    gap = np.arange(1, n + 1)
    left = upto[gap] - upto[np.maximum(gap - BLOCK, 0)]
    right = upto[np.minimum(gap + BLOCK, n)] - upto[gap]
    norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    return np.einsum("ij,ij->i", left, right) / np.where(norm == 0, 1, norm)


def _depths(text: str, ends: list[int], kinds: list[str]) -> np.ndarray:
    """Depth of the similarity valley at each unit's end, with the boundary's own strength.

    SLICE units are compared at once, with their neighbours on both sides, so that a long text
    takes no more memory than a short one.
    """
    n, begins = len(ends), [0, *ends[:-1]]
    similar = np.empty(n)
    for at in range(0, n, SLICE):
        low, high = max(0, at - BLOCK), min(n, at + SLICE + BLOCK)
        found = _similarities([text[begins[u] : ends[u]] for u in range(low, high)])
        similar[at : at + SLICE] = found[at - low : at - low + SLICE]
    # The peaks around a gap: the highest similarity within a block's reach on each side.
    padded = np.pad(similar, BLOCK, mode="edge")
    around = np.lib.stride_tricks.sliding_window_view(padded, BLOCK + 1)
    peaks = around[:n].max(axis=1) + around[BLOCK : BLOCK + n].max(axis=1)
    return peaks - 2 * similar + np.array([STRENGTH[k] for k in kinds])


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Character spans of the pieces: none longer than `limit`, each starting `overlap` before the last one's end."""
    if len(text) <= limit:
        return [(0, len(text))]
    ends, kinds = _units(text)
    depths = _depths(text, ends, kinds)
    least = (limit - overlap) // 2
    pieces, start, last = [], 0, 0
    while len(text) - start > limit:
        low, high = bisect_left(ends, max(start + overlap + 1, last + least)), bisect_left(ends, start + limit + 1)
        if low < high:
            window = depths[low:high]
            end = ends[high - 1 - int(np.argmax(window[::-1]))]
        else:
            end = start + limit
        pieces.append((start, end))
        start, last = end - overlap, end
    pieces.append((start, len(text)))
    return pieces


_SPAN = "array<struct<start:int,end:int,first:int,last:int,pieces:int>>"


def _spans_udf(limit: int, overlap: int):
    @F.pandas_udf(_SPAN)
    def cut(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list[tuple[int, int, int, int, int]]:
            found = spans(text, limit, overlap)
            breaks = [m.start() for m in re.finditer("\n", text)]
            return [(a, b, bisect_left(breaks, a), bisect_left(breaks, max(a, b - 1)), len(found)) for a, b in found]

        return texts.map(one)

    return cut


def split_items(items: DataFrame, id_col: str, text_col: str, start_line: str | None = None, end_line: str | None = None, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """Cuts every text of more than `limit` characters (code points) into pieces of at most `limit`.

    Returns (id_col, piece, pieces, start_char, end_char, start_line, end_line, text).
    A piece ends at the deepest valley of lexical cohesion in its size window; the next
    one begins exactly `overlap` characters before that end. Only where a window has no
    boundary at all does a piece end after `limit` characters. Texts within the limit are
    one piece and never leave the JVM; the pieces' texts are cut there too. No shuffle.

    Lines count from the item's first line (the smaller of a swapped pair); lines of the
    text before the item's own (its title and comment) belong to the first. Without line
    columns, or with null lines, the lines are null. Null texts are left out; an empty
    text is one piece of length 0. Repeated rows and ties are kept row by row; other
    columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be within the limit")
    line = lambda c: F.col(c).cast("int") if c else F.lit(None).cast("int")
    rows = items.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("text"),
        F.least(line(start_line), line(end_line)).alias("_from"), F.greatest(line(start_line), line(end_line)).alias("_to"),
    ).where(F.col("text").isNotNull())
    length = F.length("text")
    long = rows.where(length > limit).select("*", F.posexplode(_spans_udf(limit, overlap)("text")).alias("piece", "s"))
    short = rows.where(length <= limit).select(
        "*", F.lit(0).alias("piece"),
        F.struct(F.lit(0).alias("start"), length.alias("end"), F.lit(0).alias("first"), (F.size(F.split("text", "\n")) - 1).alias("last"), F.lit(1).alias("pieces")).alias("s"),
    )
    # Lines of the text that come before the item's own lines.
    before = F.greatest(F.lit(0), F.size(F.split(F.regexp_replace("text", "\n\\z", ""), "\n")) - (F.col("_to") - F.col("_from") + 1))
    at = lambda n: F.least(F.col("_to"), F.col("_from") + F.greatest(F.lit(0), n - before))
    return long.unionByName(short).select(
        F.col("_id").alias(id_col), "piece", F.col("s.pieces").alias("pieces"), F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"),
        at(F.col("s.first")).alias("start_line"), at(F.col("s.last")).alias("end_line"),
        F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"),
    )
