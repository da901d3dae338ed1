"""Vector arithmetic on array columns, without user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def l2_normalise(a: Column) -> Column:
    """The vector at length 1; a vector without length stays as it is."""
    length = F.when(norm(a) == 0, 1.0).otherwise(norm(a))
    return F.transform(a, lambda x: x.cast("double") / length)


def one_hot(values: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.transform(F.array(*map(F.lit, vocabulary)), lambda v: F.when(F.array_contains(values, v), 1.0).otherwise(0.0))
