"""Vector functions over ``array<float>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 for a zero vector; the similarity is clamped to -1..1; six digits."""
    n = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(1 - F.least(F.greatest(dot(a, b) / n, F.lit(-1.0)), F.lit(1.0)), 6))


def similarity(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector is like nothing (0)."""
    one = lambda n: F.coalesce(F.nullif(n, F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def blend(a: Column, b: Column, weight: float) -> Column:
    """``(1 - weight) * a + weight * b``, of length 1; weight 0 or 1 passes one side through."""
    if weight in (0, 1):
        return F.transform(b if weight else a, lambda x: x.cast("double"))
    mixed = F.zip_with(a, b, lambda x, y: x.cast("double") * (1 - weight) + y.cast("double") * weight)
    n = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mixed, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))
