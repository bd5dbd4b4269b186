"""Counts, metrics and column summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_counts(df: DataFrame, conditions: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """Rows in all and rows under each condition."""
    counts = [F.count_if(c).alias(name) for name, c in conditions.items()]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), *counts)


def periods_with(df: DataFrame, period: str, condition: Column, out: str = "periods") -> DataFrame:
    """Number of periods with at least one row under ``condition``."""
    return df.where(condition).agg(F.count_distinct(period).alias(out))


def error_metrics(df: DataFrame, truth: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """``mae``, ``mse`` and ``max_error`` of ``pred`` against ``truth``."""
    error = F.col(truth) - F.col(pred)
    return df.groupBy(*group).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.max(F.abs(error)).alias("max_error"),
    )


def column_range(df: DataFrame, column: str) -> DataFrame:
    """Minimum, maximum and count of a column."""
    c = F.col(column)
    return df.agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("n"))


def feature_means(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Mean and mean magnitude per feature of a long table."""
    return long.groupBy(feature).agg(
        F.avg(value).alias("mean"), F.avg(F.abs(F.col(value))).alias("mean_abs")
    )
