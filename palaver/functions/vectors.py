"""Vector arithmetic on ARRAY<FLOAT> / ARRAY<DOUBLE> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column, eps: float = 1e-10) -> Column:
    """``a`` over its norm; with ``eps`` of 0 a zero vector gives nulls."""
    size = norm(a) + F.lit(eps)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), size))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def affinity(a: Column, b: Column) -> Column:
    """Cosine shifted to 0..1."""
    return F.greatest((cosine(a, b) + 1.0) / 2.0, F.lit(0.0))
