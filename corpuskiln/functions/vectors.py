"""Vector expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vector), F.lit(0.0), lambda s, x: s + x * x))


def normalised(vector: Column) -> Column:
    """The unit vector; a zero vector stays as it is. The norm is computed once a row, as a lambda's variable."""
    unit = lambda length: F.transform(doubles(vector), lambda x: F.when(length > 0, x / length).otherwise(x))
    return F.transform(F.array(norm(vector)), unit)[0]


def has_dimension(vector: Column, dimension: int) -> Column:
    return F.coalesce(F.size(vector) == dimension, F.lit(False))
