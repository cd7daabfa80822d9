"""Vector expressions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def truncate(a: Column, size: int) -> Column:
    """The first ``size`` values, brought to length one; a zero vector stays."""
    head = F.transform(F.slice(a, 1, size), lambda x: x.cast("double"))
    length = norm(head)
    return F.when(length == 0, head).otherwise(F.transform(head, lambda x: x / length))
