"""Unions and duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing from one table is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``, which has to be total within a key.

    Spark cuts every key to one row per task before the shuffle, so a hot key does not travel whole.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(ordered)).where("_n = 1").drop("_n")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their ``count``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows beyond the first of each key."""
    return duplicate_keys(df, keys).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of one column."""
    return df.select(column).distinct()


def union_names(*lists: Sequence[str]) -> list[str]:
    """Union of several name lists, sorted."""
    return sorted(set().union(*lists))
