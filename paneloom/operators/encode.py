"""One-hot columns from a stored vocabulary, and a sample of distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.operators.folds import seeded_md5
from paneloom.operators.ranks import rank_by_group
from paneloom.operators.spread import settle

#: More levels than this would make an unusably wide table.
MAX_LEVELS = 1000


def fit_one_hot(df: DataFrame, cols: Sequence[str], *, max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted levels of each text column; booleans have none, they pass through."""
    levels = {}
    for c in cols:
        if isinstance(df.schema[c].dataType, T.BooleanType):
            continue
        found = [
            r[0]
            for r in df.select(F.col(f"`{c}`").cast("string").alias("v")).where("v IS NOT NULL")
            .distinct().limit(max_levels + 1).collect()
        ]
        if len(found) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        levels[c] = sorted(found)
    return levels


def one_hot_names(levels: dict[str, list[str]]) -> list[str]:
    """Names of the indicator columns, in order."""
    return [f"{c}_{v}" for c, vs in levels.items() for v in vs]


def one_hot(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Replace each column by one 0/1 column per level; null and unseen levels give zeros."""
    indicators = [
        F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, vs in levels.items()
        for v in vs
    ]
    others = [F.col(f"`{c}`") for c in df.columns if c not in levels]
    return df.select(*others, *indicators)


def sample_values(df: DataFrame, column: str, share: float, *, seed: int = 0) -> DataFrame:
    """``int(share · n)`` of the n distinct values, chosen by md5 so that a rerun or another engine picks the same."""
    values = settle(df.select(column).distinct().withColumn("_hash", seeded_md5(column, seed)))
    wanted = int(share * values.count())
    placed = rank_by_group(
        values, [], "_hash", "_place", method="position", tie=[column], ascending=True, group_rows=0
    )
    return placed.where(F.col("_place") <= wanted).select(column)
