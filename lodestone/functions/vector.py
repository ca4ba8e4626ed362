"""Vector functions as column expressions; all arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is all zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def l2_normalize(v: Column) -> Column:
    length = norm(v) + F.lit(1e-32)
    return F.transform(v, lambda x: x.cast("double") / length)


def max_abs_diff(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def usable(v: Column, dims: int) -> Column:
    """A vector of the right length that is not all zero (another length is from an older model)."""
    return (F.size(v) == dims) & F.exists(v, lambda x: x != 0)
