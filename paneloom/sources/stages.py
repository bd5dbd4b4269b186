"""Stage tables in Parquet: built once from given inputs by a given recipe, read many times."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The completion marker of a stage, below its folder; readers of the folder skip names that begin with an underscore.
MARKER = "_built"

_MARKER_SCHEMA = T.StructType([T.StructField("fingerprint", T.StringType())])


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one with ``schema`` when there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def file_state(table: DataFrame) -> tuple[int, int]:
    """How many files a table is read from, and a sum over their paths, sizes and times of change; no column is read."""
    try:
        files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    except AnalysisException as error:
        raise ValueError("a fingerprint needs inputs that are read from files") from error
    named = F.xxhash64("file_path", "file_size", F.unix_micros("file_modification_time")).cast("decimal(38,0)")
    return tuple(files.agg(F.count(F.lit(1)), F.coalesce(F.sum(named), F.lit(0))).first())


def fingerprint(inputs: Sequence[DataFrame] = (), recipe: str = "", partition_by: Sequence[str] = ()) -> str:
    """A digest of the state of all input files, the recipe's text and the layout."""
    parts = [recipe, *partition_by, *[f"{n}:{total}" for n, total in map(file_state, inputs)]]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def stage_exists(spark: SparkSession, path: str, wanted: str | None = None) -> bool:
    """Whether a stage at ``path`` was completed, and from ``wanted`` where that is given.

    Data without a marker are what an interrupted build has left: they do not count.
    """
    found = read_or_empty(spark, f"{path}/{MARKER}", _MARKER_SCHEMA).first()
    return found is not None and wanted in (None, found.fingerprint)


def build_once(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    *,
    inputs: Sequence[DataFrame] = (),
    recipe: str = "",
    refresh: bool = False,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Build and write a stage unless a complete one from the same inputs and recipe is there, then read it back.

    Overwriting removes the old marker with the old data, and the new one follows only when all data are written, so a
    build that stops midway is built again. ``inputs`` are tables read from files: a changed, added or removed file
    makes the stage stale, as do another ``recipe`` (any text, such as a version) and another layout.
    """
    wanted = fingerprint(inputs, recipe, partition_by)
    if refresh or not stage_exists(spark, path, wanted):
        writer = build().write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        spark.createDataFrame([(wanted,)], _MARKER_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MARKER}")
    return spark.read.parquet(path)
