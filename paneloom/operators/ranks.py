"""Ranks of rows within their group (ties share the minimum or the average) and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.operators.spread import GROUP_ROWS, attach, largest_group, running_total

METHODS = ("min", "average", "position")


def rank_by_group(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    out: str,
    *,
    method: str = "min",
    tie: Sequence[str] = (),
    ascending: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rank ``score`` within ``group``, highest first unless ``ascending``.

    ``min`` and ``average`` share ranks between ties and leave a null score unranked; ``position`` numbers the
    rows 1, 2, 3 … with ``tie`` as tie-breaker (nulls last). When every group fits one task a single window does
    it; otherwise the rank is taken from a running total over the distinct (group, score) pairs, so neither a
    group nor a run of equal scores has to fit in a task.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "position" and not tie:
        raise ValueError("a position needs a tie-breaker to be well defined")
    if group_rows and largest_group(df, group) <= group_rows:
        return _rank_by_window(df, group, score, out, method, tie, ascending)
    return _rank_by_totals(df, group, score, out, method, tie, ascending)


def _direction(score: str, ascending: bool) -> Column:
    column = F.col(f"`{score}`")
    return column.asc_nulls_last() if ascending else column.desc_nulls_last()


def _rank_by_window(df, group, score, out, method, tie, ascending) -> DataFrame:
    by_group = Window.partitionBy(*group)
    ordered = by_group.orderBy(_direction(score, ascending), *(tie if method == "position" else ()))
    if method == "position":
        return df.withColumn(out, F.row_number().over(ordered).cast("long"))
    rank = F.rank().over(ordered).cast("long")
    if method == "average":
        ties = F.count(F.lit(1)).over(Window.partitionBy(*group, F.col(f"`{score}`")))
        rank = rank + (ties - 1) / F.lit(2.0)
    return df.withColumn(out, F.when(F.col(f"`{score}`").isNotNull(), rank))


def _rank_by_totals(df, group, score, out, method, tie, ascending) -> DataFrame:
    if method == "position":
        order = [_direction(score, ascending), *[F.col(f"`{c}`").asc() for c in tie]]
        placed = running_total(df, group, order, F.lit(1), out)
        return placed.withColumn(out, (F.col(out) + 1).cast("long"))
    values = score_ranks(df, group, score, ascending=ascending)
    chosen = values.select(*group, score, F.col(f"_{method}").alias(out))
    return attach(df, chosen, [*group, score]).select(*[F.col(f"`{c}`") for c in df.columns], out)


def score_ranks(
    df: DataFrame, group: Sequence[str], score: str, *, ascending: bool = False
) -> DataFrame:
    """One row per distinct (group, score): ``_ties``, ``_min`` rank and ``_average`` rank."""
    values = (
        df.where(F.col(f"`{score}`").isNotNull())
        .groupBy(*group, score)
        .agg(F.count(F.lit(1)).alias("_ties"))
    )
    above = running_total(values, group, [_direction(score, ascending)], F.col("_ties"), "_above")
    return above.select(
        *group,
        score,
        "_ties",
        (F.col("_above") + 1).cast("long").alias("_min"),
        (F.col("_above") + (F.col("_ties") + 1) / F.lit(2.0)).alias("_average"),
    )
