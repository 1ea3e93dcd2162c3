"""Vector distances and similarities as Column expressions; arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.errors import invalid

METRICS = ("cosine", "euclidean", "dotProduct", "manhattan")
_DOUBLES = "array<double>"


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast(_DOUBLES), b.cast(_DOUBLES), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit vector in single precision; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<float>")).otherwise(F.transform(a.cast(_DOUBLES), lambda x: (x / n)).cast("array<float>"))


def cosine_distance(a: Column, b: Column) -> Column:
    """Of any vectors; a zero vector is at distance 1 from all."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance under a metric; cosine expects unit vectors."""
    gaps = lambda f: _sum(F.zip_with(a.cast(_DOUBLES), b.cast(_DOUBLES), f))
    if metric == "cosine":
        return F.greatest(F.lit(0.0), 1 - dot(a, b))
    if metric == "euclidean":
        return F.sqrt(gaps(lambda x, y: (x - y) * (x - y)))
    if metric == "dotProduct":
        return -dot(a, b)
    if metric == "manhattan":
        return gaps(lambda x, y: F.abs(x - y))
    raise invalid(f"unknown metric {metric}")


def similarity(metric: str, d: Column) -> Column:
    if metric == "cosine":
        return 1 - d
    if metric == "dotProduct":
        return -d
    return 1 / (1 + d)
