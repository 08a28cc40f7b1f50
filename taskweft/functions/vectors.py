"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n != 0, dot(a, b) / n)


def mean_vector(vec: Column, width: int) -> Column:
    """Aggregate: the element-wise mean, partially summed before the shuffle."""
    return F.array(*(F.avg(vec[k]) for k in range(width)))
