"""Pair features over arrays of doubles: difference, product, cosine, distance, guarded division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def abs_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """a.b / (|a||b| + 1e-9): zero vectors give 0."""
    return total(product(a, b)) / (norm(a) * norm(b) + EPSILON)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def pair_vector(a: Column, b: Column, distance: bool = False) -> Column:
    """Differences, products, cosine and, if asked for, the distance, as one array."""
    parts = [abs_difference(a, b), product(a, b), F.array(cosine(a, b))]
    return F.concat(*parts, F.array(euclidean(a, b))) if distance else F.concat(*parts)


def safe_divide(x: Column, y: Column) -> Column:
    """x / y, and 0 where y is 0 (or either is null)."""
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
