"""Functions over vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where lengths differ or a vector is zero; null of null."""
    usual = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(F.size(a) == F.size(b), F.coalesce(usual, F.lit(0.0))).otherwise(F.when(a.isNotNull() & b.isNotNull(), 0.0))


def similarity(a: Column, b: Column) -> Column:
    """Cosine within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def _distance(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(float("inf"))


def euclidean(a: Column, b: Column) -> Column:
    return _distance(a, b, F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))


def manhattan(a: Column, b: Column) -> Column:
    return _distance(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x))


def normalized(v: Column) -> Column:
    """Of length one; a zero vector as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(v)


def nonzero(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def comparison(old: Column, new: Column) -> dict[str, Column]:
    """How far a vector moved: cosine, distances, change of length in percent, statistics of the components' changes, and whether that matters."""
    moved = F.zip_with(new, old, lambda x, y: F.abs(x - y))
    n = F.size(moved)
    mean = F.aggregate(moved, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(moved, F.lit(0.0), lambda s, x: s + x * x) / n
    c = cosine(old, new)
    return {
        "cosine": c, "euclidean": euclidean(old, new), "manhattan": manhattan(old, new), "length_change": F.coalesce(F.try_divide((norm(new) - norm(old)) * 100.0, norm(old)), F.lit(0.0)),
        "max_move": F.array_max(moved), "mean_move": mean, "std_move": F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)), "score": c * 100, "significant": c < 0.95,
    }
