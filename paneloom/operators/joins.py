"""Equi-joins on keys: votes, standings, previous period, column-wise concat, lookups and key lists."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.operators.dedupe import duplicate_count
from paneloom.operators.spread import attach

log = logging.getLogger(__name__)


def join_unique(
    df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "left", *, on_duplicate: str = "raise"
) -> DataFrame:
    """Join ``other``, which should hold one row per key; repeated keys raise (or only warn)."""
    if on_duplicate not in ("raise", "warn", "ignore"):
        raise ValueError("on_duplicate must be 'raise', 'warn' or 'ignore'")
    if on_duplicate != "ignore":
        extra = duplicate_count(other, on)
        if extra:
            message = f"{extra} repeated rows for key {list(on)}"
            if on_duplicate == "raise":
                raise ValueError(message)
            log.warning(message)
    return df.join(other, list(on), how)


def previous_period_flags(
    df: DataFrame, keys: Sequence[str], period: str, predicates: dict[str, Column]
) -> DataFrame:
    """One flag per predicate: true where the same ``keys`` satisfied it exactly one period earlier, else false.

    Few rows satisfy a predicate such as "won", so the table of earlier hits is usually small enough to leave the
    rows where they are.
    """
    earlier = (
        df.where(reduce(lambda a, b: a | b, predicates.values()))
        .groupBy(*keys, (F.col(period) + 1).alias(period))
        .agg(*[F.bool_or(p).alias(out) for out, p in predicates.items()])
    )
    flags = [F.coalesce(out, F.lit(False)).alias(out) for out in predicates]
    return attach(df, earlier, [*keys, period]).select(*[F.col(f"`{c}`") for c in df.columns], *flags)


def previous_period_flag(
    df: DataFrame, keys: Sequence[str], period: str, predicate: Column, out: str
) -> DataFrame:
    """:func:`previous_period_flags` for one predicate."""
    return previous_period_flags(df, keys, period, {out: predicate})


def outer_concat(tables: Sequence[DataFrame], key: str | Sequence[str], *, coalesce: bool = False) -> DataFrame:
    """Column-wise concat of tables that hold one row per ``key``: a tagged union and one grouped merge.

    A column present in several tables keeps the first table's values, also where that table lacks the key;
    ``coalesce=True`` falls back to the later tables instead. However many tables there are, their rows are shuffled
    once, and a key meets at most one row of each. Rows whose key holds a null match nothing and stay as they are.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cells = [f"_table_{i}" for i in range(len(tables))]
    columns = [[c for c in t.columns if c not in keys] for t in tables]
    whole = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])

    def tagged(i: int) -> DataFrame:
        own = [F.col(f"`{c}`") for c in columns[i]] or [F.lit(True).alias("_there")]
        lone = F.when(~whole, F.concat(F.lit(f"{i}:"), F.monotonically_increasing_id().cast("string")))
        return tables[i].select(*[f"`{k}`" for k in keys], lone.alias("_lone"), F.struct(*own).alias(cells[i]))

    if len(tables) == 1:
        return tables[0]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tagged(i) for i in range(len(tables))])
    # Dealt out first, so that both steps of the aggregation stay in one task.
    dealt = union.repartition(*[F.col(f"`{k}`") for k in keys], "_lone")
    merged = dealt.groupBy(*[f"`{k}`" for k in keys], "_lone").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in cells]
    )
    names = list(dict.fromkeys(c for own in columns for c in own))

    def value(name: str) -> Column:
        found = [F.col(f"{cell}.`{name}`") for cell, own in zip(cells, columns) if name in own]
        return F.coalesce(*found) if coalesce else found[0]

    return merged.select(*[F.col(f"`{k}`") for k in keys], *[value(n).alias(n) for n in names])


def map_or_raise(df: DataFrame, column: str, lookup: DataFrame, lookup_key: str, lookup_value: str) -> DataFrame:
    """Replace ``column`` by its value in ``lookup``; an unmapped value fails the job and is named.

    The check is part of the expression, so it costs no pass of its own. :func:`unmapped_values` lists all.
    """
    pairs = lookup.select(F.col(lookup_key).alias(column), F.col(lookup_value).alias("_mapped")).distinct()
    value = F.coalesce(
        F.col("_mapped"), F.raise_error(F.concat(F.lit("unmapped value: "), F.col(column))).cast("string")
    )
    # A lookup read from a small file is broadcast by the planner, which knows its size.
    return df.join(pairs, column, "left").select(
        *[value.alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    )


def unmapped_values(df: DataFrame, column: str, lookup: DataFrame, lookup_key: str) -> DataFrame:
    """Distinct values of ``column`` that ``lookup`` does not know."""
    known = lookup.select(F.col(lookup_key).alias(column))
    return df.join(known, column, "left_anti").select(column).distinct()


def look_up(df: DataFrame, key: str, other: DataFrame, other_key: str, value: str, out: str) -> DataFrame:
    """Add ``out`` = ``value`` of the row of ``other`` whose ``other_key`` equals ``key`` (null if none)."""
    pairs = other.select(F.col(f"`{other_key}`").alias(key), F.col(f"`{value}`").alias(out))
    return df.join(pairs, key, "left").select(*[F.col(f"`{c}`") for c in df.columns], out)


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys, list(on), "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``keys``."""
    return df.join(keys, list(on), "left_anti")
