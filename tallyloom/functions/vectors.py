"""Vectors as arrays; sums in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def overlap(a: Column, b: Column) -> Column:
    """Share of the set ``a`` that ``b`` has; null if ``a`` is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union; null for two empty sets."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def nearest(x: Column, values: list[float]) -> Column:
    """The value nearest to ``x``; of equals the smaller."""
    return F.array_min(F.array(*[F.struct(F.abs(x - v).alias("d"), F.lit(v).alias("v")) for v in values]))["v"]
