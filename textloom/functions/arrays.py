"""Arithmetic on array columns of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector in length one; null where it has none."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, kept within 0 and 2; a vector without length is at distance 1."""
    scale = norm(a) * norm(b)
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)))


def usable(a: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite components that aren't all zero; false for null."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(a) == dim) & ~bad & F.exists(a, lambda x: x != 0), F.lit(False))
