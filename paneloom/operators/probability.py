"""Scores to shares of a group: plain share or softmax, over all rows or the best ranked only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators.spread import attach

MODES = ("share", "softmax")


def probability(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    out: str,
    *,
    mode: str = "share",
    rank: str | None = None,
    top_n: int | None = None,
    factor: float = 1.0,
) -> DataFrame:
    """``factor`` times the share (or softmax) of ``score`` within ``group``.

    With ``rank`` and ``top_n`` only rows ranked up to ``top_n`` take part and the others get 0. A share of a
    zero total is null.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if (rank is None) != (top_n is None):
        raise ValueError("rank and top_n go together")
    x = F.col(f"`{score}`").cast("double")
    taken = F.lit(True) if rank is None else F.col(f"`{rank}`") <= F.lit(top_n)
    keys = list(group)

    if mode == "share":
        summary = df.where(taken).groupBy(*keys).agg(F.sum(x).alias("_total"))
        part = F.try_divide(x, F.col("_total"))
    else:
        # Shifting by the group's maximum keeps exp() finite; both numbers end up in one small table.
        rows = df.where(taken).select(*keys, x.alias("_x"))
        peaked = _with_summary(rows, rows.groupBy(*keys).agg(F.max("_x").alias("_peak")), keys)
        summary = peaked.groupBy(*keys).agg(
            F.max("_peak").alias("_peak"), F.sum(F.exp(F.col("_x") - F.col("_peak"))).alias("_total")
        )
        part = F.exp(x - F.col("_peak")) / F.col("_total")

    joined = _with_summary(df, summary, keys)
    value = part * F.lit(float(factor))
    if rank is not None:
        value = F.when(taken, value).when(~taken, F.lit(0.0))
    return joined.withColumn(out, value).select(*[F.col(f"`{c}`") for c in df.columns], out)


def _with_summary(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return attach(df, summary, keys)
    row = summary.first().asDict()
    return df.withColumns({name: F.lit(value).cast("double") for name, value in row.items()})
