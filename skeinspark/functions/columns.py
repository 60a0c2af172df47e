"""Column helpers shared by queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column | str, digits: int = 2) -> Column:
    """Rounded, as sums of doubles depend on their order in the last digits."""
    return F.round(c, digits)


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two arrays of numbers, in double precision."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays of numbers, null where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays of numbers."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(dot(gap, gap))
