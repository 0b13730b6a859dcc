"""Vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is null or empty of direction."""
    both = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (both > 0)
    return F.when(F.coalesce(usable, F.lit(False)), dot(a, b) / both).otherwise(F.lit(0.0))
