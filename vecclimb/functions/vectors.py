"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def step(e: Column, gradient: Column, rate: Column) -> Column:
    """e - rate * gradient."""
    return F.zip_with(e, gradient, lambda x, g: x - rate * g)


def normalise(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is. The norm is one element of an array, not one an element."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)), 1)


def rescale_by_norm(unit: Column, stored: Column) -> Column:
    """The vector as it was before it was normalised, where its norm is stored."""
    return F.when(stored.isNotNull(), scale(unit, stored)).otherwise(unit)


def has_nan(a: Column) -> Column:
    return F.exists(a, F.isnan)


def has_nan_nested(a: Column) -> Column:
    return F.exists(a, lambda v: F.exists(v, F.isnan))


def reshape_flat(flat: Column, outputs: int, size: int) -> Column:
    """A flat tensor as array<array<double>>: outputs vectors of the given size."""
    return F.transform(F.sequence(F.lit(0), F.lit(outputs - 1)), lambda i: F.slice(flat, i * size + 1, size))
