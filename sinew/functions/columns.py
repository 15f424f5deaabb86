"""Small column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also when the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def sum_squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v)


def centred(values: Column) -> Column:
    """Values minus their mean."""
    return let(total(values) / F.size(values), lambda m: F.transform(values, lambda v: v - m))
