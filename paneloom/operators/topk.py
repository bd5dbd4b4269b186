"""Best rows overall, per group, by absolute value and by sign."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows in ``order``: a top-n per task, then one merge of n rows each."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: Sequence[str], n: int, order: Sequence[Column], out: str = "_n") -> DataFrame:
    """The first ``n`` rows of each group, numbered in ``out``; each task sends at most n rows per group."""
    numbered = df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered.where(F.col(out) <= n)


def top_by_magnitude(df: DataFrame, n: int, value: str, tie: str) -> DataFrame:
    """The ``n`` rows with the largest absolute ``value``."""
    return top_rows(df, n, [F.abs(F.col(value)).desc_nulls_last(), F.col(tie).asc()])


def top_by_sign(df: DataFrame, entity: str, value: str, n: int, tie: str) -> DataFrame:
    """Per entity the ``n`` strongest positive and the ``n`` strongest negative rows.

    Adds ``sign`` (1 or -1) and ``place``; zeros are left out.
    """
    signed = df.where(F.col(value) != 0).withColumn("sign", F.signum(value).cast("int"))
    order = [F.abs(F.col(value)).desc(), F.col(tie).asc()]
    return top_per_group(signed, [entity, "sign"], n, order, "place")


def best_of_group(df: DataFrame, group: Sequence[str], score: str, tie: str, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of the row with the highest score of each group (smallest ``tie`` among equals)."""
    order = [F.col(f"`{score}`").desc_nulls_last(), F.col(f"`{tie}`").asc()]
    return top_per_group(df, group, 1, order).select(*group, *keep)


def entities_of_latest(df: DataFrame, entity: str, date: str, score: str, n: int) -> DataFrame:
    """Entities of the first ``n`` rows by date then score, both descending (fewer than n if one repeats)."""
    order = [F.col(date).desc(), F.col(score).desc(), F.col(entity).asc()]
    return top_rows(df.select(entity, date, score), n, order).select(entity).distinct()
