"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector scaled to length 1, in double precision; null for a null, empty or all-zero one."""
    lengths = F.array_repeat(F.nullif(norm(v), F.lit(0.0)), F.size(v))  # worked out once, not for each number
    return F.when(F.exists(v, lambda x: x != 0), F.zip_with(v, lengths, lambda x, n: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either has no direction."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
