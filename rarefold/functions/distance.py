"""Distances between vector columns, as column expressions that fold from left to right in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Distance = Callable[[Column, Column], Column]


def _summed(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def sqeuclidean(a: Column, b: Column) -> Column:
    return _summed(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqeuclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _summed(a, b, lambda x, y: F.abs(x - y))


def minkowski(p: float) -> Distance:
    return lambda a, b: F.pow(_summed(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p))


def cosine(a: Column, b: Column) -> Column:
    norm = lambda v: F.sqrt(_summed(v, v, lambda x, y: x * y))
    return 1 - F.try_divide(_summed(a, b, lambda x, y: x * y), norm(a) * norm(b))
