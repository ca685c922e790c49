"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    length = norm(v)
    return F.transform(v, lambda x: F.when(length == 0, x).otherwise(x / length))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def round_vector(v: Column, digits: int = 8) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))
