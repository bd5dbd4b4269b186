"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_transform(x: Column) -> Column:
    """log(x + 1)."""
    return F.log1p(x)


def exp_transform(x: Column) -> Column:
    """exp(x); not the inverse of :func:`log_transform`."""
    return F.exp(x)


def clamp_at_zero(x: Column) -> Column:
    """Negative values become 0; null stays null."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def nan_to_null(x: Column) -> Column:
    """NaN as null, so that comparisons and aggregates treat it as missing."""
    return F.when(~F.isnan(x), x)
