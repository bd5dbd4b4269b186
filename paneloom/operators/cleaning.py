"""Projections, renames, fills, casts and column selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.maths import nan_to_null
from paneloom.functions.text import place


def upper_columns(df: DataFrame) -> DataFrame:
    """Upper-case every column name."""
    return df.toDF(*[c.upper() for c in df.columns])


def rename_columns(df: DataFrame, names: dict[str, str] | Callable[[str], str]) -> DataFrame:
    """Rename by mapping or by a function of the name."""
    if callable(names):
        return df.toDF(*[names(c) for c in df.columns])
    return df.withColumnsRenamed(names)


def rename_first(df: DataFrame, name: str) -> DataFrame:
    """Rename the first column, whatever it is called."""
    return df.toDF(name, *df.columns[1:])


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Projection in the given order."""
    return df.select(*[F.col(f"`{c}`") for c in names])


def drop_columns(df: DataFrame, names: Sequence[str] = (), *, containing: Sequence[str] = ()) -> DataFrame:
    """Drop by name or by a piece of the name; absent names are ignored."""
    gone = [c for c in df.columns if c in names or any(piece in c for piece in containing)]
    return df.drop(*gone)


def constant_columns(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Add one constant column per entry."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def suffix_columns(df: DataFrame, suffix: str, shared: Sequence[str]) -> DataFrame:
    """Append ``_suffix`` to every column that is not shared between tables."""
    return df.toDF(*[c if c in shared else f"{c}_{suffix}" for c in df.columns])


def empty_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns without a single value: one aggregate over the table."""
    names = list(cols or df.columns)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if counts[i] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns without a single value."""
    return df.drop(*empty_columns(df))


def complete_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns among ``cols`` that hold no null: one aggregate over the table."""
    missing = df.agg(
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(cols)]
    ).first()
    return [c for i, c in enumerate(cols) if missing[i] == 0]


def fill_by_prefix(df: DataFrame, prefix: str, value: float = 0.0) -> DataFrame:
    """Fill nulls of the columns whose name starts with ``prefix``; text columns get the number as text."""
    chosen = [f for f in df.schema.fields if f.name.startswith(prefix)]
    return df.withColumns(
        {f.name: F.coalesce(F.col(f"`{f.name}`"), F.lit(value).cast(f.dataType)) for f in chosen}
    )


def fill_typed(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill nulls column by column."""
    return df.fillna(values)


def fill_numbers(df: DataFrame, value: float = 0.0) -> DataFrame:
    """Fill the nulls of all numeric columns."""
    return df.fillna(value)


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Strict casts: text that is not a number is an error."""
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in types.items()})


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats})


def rank_flags(df: DataFrame, rank_text: str, prefix: str) -> DataFrame:
    """Replace a place text by ``<prefix>WINNER``, ``<prefix>PODIUM`` and ``<prefix>CANDIDATE``."""
    at = place(F.col(rank_text))
    return df.withColumns(
        {
            f"{prefix}WINNER": at == 1,
            f"{prefix}PODIUM": at.isin(1, 2, 3),
            f"{prefix}CANDIDATE": F.lit(True),
        }
    ).drop(rank_text)


def label_where(df: DataFrame, condition: Column, yes: str, no: str, out: str) -> DataFrame:
    """Two-valued label."""
    return df.withColumn(out, F.when(condition, F.lit(yes)).otherwise(F.lit(no)))


def numerical_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric type, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """All other columns (booleans included), in order."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
