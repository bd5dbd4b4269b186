"""Delimited text with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Separator and encoding of the files.
SEPARATOR = ";"
ENCODING = "UTF-8"


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    sep: str = SEPARATOR,
    encoding: str = ENCODING,
    nrows: int | None = None,
) -> DataFrame:
    """Read text files with a header row; bad values are errors. ``nrows`` keeps the first rows only."""
    df = (
        spark.read.schema(schema)
        .options(sep=sep, encoding=encoding, header=True, mode="FAILFAST", escape='"')
        .csv(path)
    )
    return df if nrows is None else df.limit(nrows)


def write_delimited(
    df: DataFrame,
    path: str,
    *,
    sep: str = SEPARATOR,
    encoding: str = ENCODING,
    compression: str | None = None,
    mode: str = "overwrite",
) -> None:
    """Write one text file per partition with a header row; ``compression="gzip"`` packs each file."""
    options = {"sep": sep, "encoding": encoding, "header": True, "escape": '"'}
    df.write.mode(mode).options(**options, compression=compression or "none").csv(path)
