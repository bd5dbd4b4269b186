"""Tables on top of attributions ``key, feature, phi``: wide form, peers, importance, strongest impacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators.topk import top_by_magnitude, top_by_sign, top_rows


def to_wide(long: DataFrame, key: str, features: Sequence[str], value: str = "phi") -> DataFrame:
    """One row per key, one column per feature."""
    return long.groupBy(key).pivot("feature", list(features)).agg(F.first(value))


def to_long(wide: DataFrame, key: str, features: Sequence[str], value: str = "phi") -> DataFrame:
    """One row per key and feature."""
    return wide.unpivot([key], [F.col(f"`{c}`") for c in features], "feature", value)


def peer_delta(long: DataFrame, key: str, entity, n: int, value: str = "phi") -> DataFrame:
    """The ``n`` features where ``entity`` is furthest from the mean of the other keys.

    One pass: the entity's value and the sum of the others are conditional aggregates of the same group. Without
    another key the result is empty.
    """
    mine = F.col(key) == F.lit(entity)
    compared = long.groupBy("feature").agg(
        F.max(F.when(mine, F.col(value))).alias("own"), F.avg(F.when(~mine, F.col(value))).alias("others")
    )
    delta = compared.select("feature", (F.col("own") - F.col("others")).alias("delta"))
    return top_by_magnitude(delta.where(F.col("delta").isNotNull()), n, "delta", "feature").withColumn(
        "abs_delta", F.abs("delta")
    )


def global_importance(long: DataFrame, n: int | None = None, value: str = "phi") -> DataFrame:
    """Mean magnitude per feature, strongest first."""
    means = long.groupBy("feature").agg(F.avg(F.abs(F.col(value))).alias("importance"))
    return means if n is None else top_rows(means, n, [F.col("importance").desc(), F.col("feature").asc()])


def local_top(long: DataFrame, key: str, n: int = 3, value: str = "phi") -> DataFrame:
    """Per key the ``n`` strongest positive and negative features."""
    return top_by_sign(long, key, value, n, "feature")
