"""Expressions on quantile arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolate(values: Column, at: Column) -> Column:
    """Linear interpolation at a 0-based position; constant beyond the ends."""
    last = (F.size(values) - 1).cast("double")
    spot = F.least(F.greatest(at, F.lit(0.0)), last)
    low = F.floor(spot).cast("int")
    a, b = F.get(values, low), F.get(values, F.ceil(spot).cast("int"))
    return a + (b - a) * (spot - low)


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)
