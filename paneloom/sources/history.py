"""Dated prediction history: a date comes from one batch, or from one stream, and is there as a whole or not at all.

Below the history's folder, ``data/`` holds one folder per append and ``ledger/`` says which of them count: one row per
date and folder. An append writes its data first and then its ledger rows as one file, which a writer publishes by one
rename. A run that stops before that has changed nothing that readers see, and its dates are appended by the next run.
Readers open the listed folders only. Appends to one history run one after another.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.operators.spread import broadcast_if_small, settle
from paneloom.sources.stages import read_or_empty


def read_ledger(spark: SparkSession, path: str, date_type: T.DataType | None = None) -> DataFrame:
    """(date, folder, source, epoch): what has been published."""
    schema = T.StructType([
        T.StructField("date", date_type or T.DateType()), T.StructField("folder", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("epoch", T.LongType()),
    ])
    return read_or_empty(spark, f"{path}/ledger", schema)


def read_history(spark: SparkSession, path: str, schema: T.StructType, date_col: str = "DATE") -> DataFrame:
    """All published rows; dates are partition folders, so a filter on them prunes."""
    folders = sorted(r.folder for r in read_ledger(spark, path, schema[date_col].dataType).select("folder").distinct().collect())
    if not folders:
        return spark.createDataFrame([], schema)
    # Each append has its own root; the files' date comes from the folder below it.
    tables = spark.read.schema(schema).option("basePath", f"{path}/data")
    return tables.parquet(*[f"{path}/data/append={f}" for f in folders]).select(*schema.names)


def _stage(batch: DataFrame, path: str, date_col: str) -> str:
    """Write a batch where no reader looks yet; its folder."""
    folder = uuid.uuid4().hex
    batch.write.partitionBy(date_col).parquet(f"{path}/data/append={folder}")
    return folder


def _publish(dates: DataFrame, path: str, folder: str, source: str | None, epoch: int | None) -> None:
    """List the dates of a staged folder: one file, so all of them or none."""
    rows = dates.select(
        F.col("date"), F.lit(folder).alias("folder"), F.lit(source).cast("string").alias("source"),
        F.lit(epoch).cast("long").alias("epoch"),
    )
    rows.coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def _append(batch: DataFrame, path: str, date_col: str, source: str | None, epoch: int | None) -> DataFrame:
    spark, schema = batch.sparkSession, batch.schema
    ledger = read_ledger(spark, path, schema[date_col].dataType)
    # Within a stream a date may go on; between sources the first one has it.
    other = ledger if source is None else ledger.where(~F.col("source").eqNullSafe(F.lit(source)))
    known = broadcast_if_small(settle(other.select(F.col("date").alias("_known")).distinct()))
    fresh = settle(batch.join(known, F.col(date_col).eqNullSafe(F.col("_known")), "left_anti").select(*schema.names))
    dates = settle(fresh.select(F.col(date_col).alias("date")).distinct())
    if not dates.isEmpty():
        _publish(dates, path, _stage(fresh, path, date_col), source, epoch)
    return read_history(spark, path, schema, date_col)


def append_once(batch: DataFrame, path: str, date_col: str = "DATE") -> DataFrame:
    """Append the dates of ``batch`` that the history at ``path`` does not hold yet; returns the history."""
    return _append(batch, path, date_col, None, None)


def append_epoch(batch: DataFrame, path: str, source: str, epoch: int, date_col: str = "DATE") -> DataFrame:
    """Append a micro-batch of the stream ``source``: once per epoch, whatever dates its earlier epochs brought.

    A date may be spread over many micro-batches of its stream, and all of its rows count. Dates that another source has
    published add nothing, and neither does an epoch that is replayed.
    """
    spark, schema = batch.sparkSession, batch.schema
    done = read_ledger(spark, path, schema[date_col].dataType).where((F.col("source") == source) & (F.col("epoch") == epoch))
    if not done.isEmpty():
        return read_history(spark, path, schema, date_col)
    return _append(batch, path, date_col, source, epoch)
