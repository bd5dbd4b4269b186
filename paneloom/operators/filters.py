"""Filters: absolute, relative to the group, by membership, by date and around a marker row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.operators.spread import attach


def drop_header_repeats(df: DataFrame, column: str, header: str) -> DataFrame:
    """Drop rows that repeat the header; a null value stays."""
    return df.where(~F.col(f"`{column}`").eqNullSafe(header))


def drop_containing(df: DataFrame, column: str, text: str) -> DataFrame:
    """Drop section rows, recognised by a piece of text."""
    return df.where(~F.col(f"`{column}`").contains(text))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with any null."""
    return df.na.drop("any")


def keep_members(df: DataFrame, column: str, values: Iterable | None, *, fold: str | None = None) -> DataFrame:
    """Keep rows whose ``column`` is among ``values`` (``None`` keeps all).

    ``fold="upper"`` or ``"lower"`` changes the case of the asked values first; unknown values match nothing.
    """
    if values is None:
        return df
    asked = [getattr(str(v), fold)() for v in values] if fold else list(values)
    return df.where(F.col(f"`{column}`").isin(asked))


def at_least(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Keep rows with every column at or above its limit."""
    for column, limit in limits.items():
        df = df.where(F.col(f"`{column}`") >= limit)
    return df


def at_most(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Keep rows with every column at or below its limit."""
    for column, limit in limits.items():
        df = df.where(F.col(f"`{column}`") <= limit)
    return df


def group_threshold(df: DataFrame, group: str, column: str, ratio: float) -> DataFrame:
    """Keep rows whose ``column`` reaches ``ratio`` of the group's maximum."""
    peak = df.groupBy(group).agg(F.max(f"`{column}`").alias("_peak"))
    kept = attach(df, peak, [group], "inner").where(F.col(f"`{column}`") >= F.col("_peak") * F.lit(ratio))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def removed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], which: Column) -> DataFrame:
    """Rows of interest that the filters between ``before`` and ``after`` removed."""
    return before.where(which).join(after.select(*keys), list(keys), "left_anti")


def days_before(df: DataFrame, column: str, end: Column, out: str) -> DataFrame:
    """Days between ``column`` and ``end``; rows after ``end`` are handled by :func:`until`."""
    return df.withColumn(out, F.datediff(end, F.col(column)))


def until(df: DataFrame, column: str, end: Column) -> DataFrame:
    """Keep rows dated up to ``end``."""
    return df.where(F.col(column) <= end)


def split_at_marker(
    df: DataFrame, order: str, marker: Column, *, after: bool = False, inclusive: bool = False
) -> DataFrame:
    """Rows of an ordered log before (or after) the first row that satisfies ``marker``.

    The marker row itself belongs to neither part unless ``inclusive`` puts it in the later one. Without a
    marker everything is before. The position is a scalar subquery, so the log is not shuffled.
    """
    first = df.where(marker).agg(F.min(order).alias("_first")).scalar()
    position = F.col(order)
    if not after:
        return df.where(first.isNull() | (position < first))
    return df.where(position >= first if inclusive else position > first)
