"""Column expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def l2_normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    v = v.cast("array<double>")
    scale = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, 1.0).otherwise(n))
    return F.flatten(F.transform(scale, lambda n: F.transform(v, lambda x: x / n)))


def padded(v: Column, width: int) -> Column:
    """The vector with zeros behind it up to ``width``; a longer one stays."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(width) - F.size(v))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rounded(v: Column, places: int = 6) -> Column:
    # adding 0.0 makes -0.0 a plain 0.0
    return F.transform(v, lambda x: F.round(x, places) + F.lit(0.0))
