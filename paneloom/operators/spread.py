"""Building blocks that keep group-wise work balanced when one group holds much of the data.

* ``attach`` joins a per-group summary back to its rows: broadcast when the summary is small (its size is
  measured), otherwise a shuffle join whose hot partitions adaptive execution splits.
* ``running_total`` computes a prefix sum per group without ever gathering a group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.session import checkpoint_folder, shared_folder

#: A summary is broadcast only up to this many cells (rows x columns), about 32 MB of doubles.
BROADCAST_CELLS = 2_000_000

#: Groups up to this size go through one plain window; bigger ones through ordered slices.
GROUP_ROWS = 1_000_000


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a Parquet table of the open scope (``session.scratch``) and read it back.

    For wide tables that are read several times: each later read takes the columns and row groups that it needs, and
    knows its sizes. ``settle`` is for narrow tables and for rows whose order in a task matters.
    """
    path = shared_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark a settled table for broadcast when its measured size allows it."""
    small = df.count() * max(len(df.columns), 1) <= BROADCAST_CELLS
    return F.broadcast(df) if small else df


def attach(df: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table with at most one row per ``keys`` back to the rows of ``df``."""
    return df.join(broadcast_if_small(settle(summary)), list(keys), how)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group (partial counts on the map side)."""
    counts = df.groupBy(*keys).count()
    return counts.agg(F.max("count")).first()[0] or 0


def slices_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _offsets(totals: DataFrame, group: list[str]) -> DataFrame:
    """The sum of ``_total`` over the slices before each one; without a group, at most one row per slice leaves Spark."""
    if group:
        earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(
            *group, "_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
        )
    rows, so_far = [], 0
    for r in sorted(totals.collect(), key=lambda r: r["_slice"]):
        rows.append((r["_slice"], so_far))
        so_far += r["_total"] or 0
    schema = T.StructType([totals.schema["_slice"], T.StructField("_offset", totals.schema["_total"].dataType)])
    return totals.sparkSession.createDataFrame(rows, schema)


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    value: Column,
    out: str,
    *,
    slices: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows strictly before each row of its group, in ``order``.

    ``order`` must be total within a group. The rows are range-partitioned on (group, order), so a hot group
    spans many slices; the slice totals (at most groups + slices rows) give each slice its starting offset, and
    only then does a window run, inside (group, slice). The slices are settled first because the offsets and the
    rows must agree on the slice boundaries.
    """
    group = list(group)
    n = slices or slices_of(df)
    placed = settle(
        df.withColumn("_value", value)
        .repartitionByRange(n, *[F.col(c) for c in group], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    totals = placed.groupBy(*group, "_slice").agg(F.sum("_value").alias("_total"))
    offsets = _offsets(totals, group)
    inside = (
        Window.partitionBy(*group, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = attach(placed, offsets, [*group, "_slice"])
    total = F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return joined.withColumn(out, total).drop("_value", "_slice", "_offset")
