"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.operators.spread import settle

#: Rows x columns up to which a table that grows with the corpus is broadcast: a few MB.
BROADCAST_CELLS = 200_000

#: The six ASCII white-space characters that separate words.
BLANKS = " \t\n\x0b\f\r"

#: A word, as a regular expression: a maximal run of anything but those six.
WORD = r"[^\x20\x09-\x0D]+"

#: What lies between words.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null, empty or blank text."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]+", " ")
    return F.array_remove(F.split(spaced, " "), "")  # splitting at one plain character needs no regular expression


def runs_of(hashes: Column, length: int) -> Column:
    """A hash for each run of ``length`` neighbours, by doubling: pairs, fours, ... and one overlapping step at the end."""
    def joined(parts: Column, step: int) -> Column:
        return F.transform(parts, lambda h, i: F.xxhash64(h, F.get(parts, i + step)))

    def grow(parts: Column, span: int) -> Column:
        if span == length:
            return F.slice(parts, 1, F.greatest(F.size(parts) - (length - 1), F.lit(0)))
        step = min(span, length - span)
        return let(joined(parts, step), lambda longer: grow(longer, span + step))

    return let(hashes, lambda parts: grow(parts, 1))


def non_null_key(column: Column) -> Column:
    """A string key that is never null: a null and any string stay different."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Send texts to Python in batches of at most ``rows`` rows, so that long ones do not pile up there."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Integers wrap around in what is built inside, as hash functions want it; the session's own setting comes back."""
    name = "spark.sql.ansi.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def reclaim(spark: SparkSession) -> None:
    """Let the driver drop what no table refers to any more, so that shuffle files of finished steps go at once.

    Spark deletes them when the driver's JVM collects its garbage, which may be long after.
    """
    gc.collect()
    spark._jvm.System.gc()


def attach(
    df: DataFrame, summary: DataFrame, keys: list[str], how: str = "left", *, cells: int = BROADCAST_CELLS
) -> DataFrame:
    """Join a table with at most one row per key: settled, counted, and broadcast only when it is small."""
    known = settle(summary)
    small = known.count() * len(known.columns) <= cells
    return df.join(F.broadcast(known) if small else known, list(keys), how)
