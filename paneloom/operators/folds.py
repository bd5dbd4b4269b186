"""Splits by period and folds of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.operators.ranks import rank_by_group


def period_cutoff(df: DataFrame, period: str, share: float):
    """First period of the last ``int(share · n)`` of the n periods, or None when that is no period."""
    periods = df.select(period).where(F.col(period).isNotNull()).distinct()
    n = int(periods.count() * share)
    if n <= 0:
        return None
    latest = periods.orderBy(F.col(period).desc()).limit(n)
    return latest.agg(F.min(period)).first()[0]


def period_split(df: DataFrame, period: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the latest periods as test: two plain filters on the period."""
    cutoff = period_cutoff(df, period, share)
    if cutoff is None:
        return df, df.where(F.lit(False))
    return df.where(F.col(period) < cutoff), df.where(F.col(period) >= cutoff)


def assign_folds(df: DataFrame, key: str, n_splits: int, *, repeats: int = 1, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """Add one fold column per repeat (0 … n_splits-1); fold sizes differ by at most one row.

    Rows are numbered in the order of the md5 of key and seed, over range partitions at every size: no task sees more
    than its slice of the order.
    """
    names = []
    for r in range(repeats):
        name = f"fold_{r}"
        hashed = df.withColumn("_hash", seeded_md5(key, seed + r))
        placed = rank_by_group(
            hashed, [], "_hash", "_place", method="position", tie=[key], ascending=True, group_rows=0
        )
        df = placed.withColumn(name, F.pmod("_place", F.lit(n_splits)).cast("int")).drop("_hash", "_place")
        names.append(name)
    return df, names


def seeded_md5(column: str, seed: int) -> Column:
    """A hash that other engines have as well: md5 of the value as text, a colon and the seed."""
    return F.md5(F.concat(F.col(f"`{column}`").cast("string"), F.lit(f":{seed}")))


def period_folds(df: DataFrame, period: str, n_splits: int, out: str = "fold") -> DataFrame:
    """Folds that never split a period."""
    return df.withColumn(out, F.pmod(F.xxhash64(period), F.lit(n_splits)).cast("int"))


def fold_means(metrics: DataFrame, names: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Mean of each metric over the folds."""
    return metrics.groupBy(*group).agg(*[F.avg(m).alias(m) for m in names])
