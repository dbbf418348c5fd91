"""Vector functions on array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine similarity; null for a zero vector if there is no epsilon."""
    return F.try_divide(dot(a, b), norm(a) * norm(b) + F.lit(epsilon))


def weighted_mean(vectors: list[Column], weights: list[float]) -> Column:
    """The mean of several vectors of one length by fixed weights."""
    total = sum(weights)

    def add(out: Column, v: Column, share: float) -> Column:
        return F.zip_with(out, v, lambda a, b: a + b.cast("double") * share)

    out = F.transform(vectors[0], lambda x: x.cast("double") * (weights[0] / total))
    for v, w in zip(vectors[1:], weights[1:]):
        out = add(out, v, w / total)
    return out
