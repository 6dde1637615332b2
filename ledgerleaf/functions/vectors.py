"""Column functions on vectors (arrays of numbers), accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "ip")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine: 1 - cos; l2: squared Euclidean; ip: 1 - dot product. Smaller is nearer."""
    if metric == "cosine":
        return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
