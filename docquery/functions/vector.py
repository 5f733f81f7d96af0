"""Column builders for vectors (array<float>), accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """0 for an empty vector, a zero norm or different lengths."""
    comparable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm_a > 0) & (norm_b > 0)
    return F.when(comparable, dot(a, b) / (norm_a * norm_b)).otherwise(0.0)
