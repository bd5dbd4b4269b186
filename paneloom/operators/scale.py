"""Standard and min-max scaling, within a group or fitted on another table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.operators.spread import attach


def _fit(cols: Sequence[str], method: str) -> list[Column]:
    """Two numbers per column: what to subtract and what to divide by."""
    stats = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        if method == "std":
            # A constant is recognised by its range: merged partial variances can keep a trace of rounding.
            shift = F.when(F.min(x) == F.max(x), F.min(x)).otherwise(F.avg(x))
            width = F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.stddev_pop(x))
        else:
            shift, width = F.min(x), F.max(x) - F.min(x)
        stats += [shift.alias(f"_shift{i}"), width.alias(f"_width{i}")]
    return stats


def scale_by_group(
    df: DataFrame,
    cols: Sequence[str],
    *,
    group: str | None = None,
    fit_on: DataFrame | None = None,
    method: str = "std",
) -> DataFrame:
    """Replace ``cols`` by ``(x - shift) / width``; a constant column becomes 0 and a null stays null.

    ``method="std"``: mean and population standard deviation. ``method="minmax"``: minimum and range.
    ``group`` fits each group on its own rows; ``fit_on`` takes the numbers from another table.
    """
    if not cols:
        raise ValueError("need at least one numerical column to scale")
    if method not in ("std", "minmax"):
        raise ValueError("method must be 'std' or 'minmax'")
    if group is not None and fit_on is not None:
        raise ValueError("choose either group or fit_on, not both")

    if group is not None:
        # Partial aggregates per group, then a small table back to the rows: the rows are not shuffled.
        fitted = attach(df, df.groupBy(group).agg(*_fit(cols, method)), [group])
        numbers = {f"_{k}{i}": F.col(f"_{k}{i}") for i in range(len(cols)) for k in ("shift", "width")}
    else:
        row = (df if fit_on is None else fit_on).agg(*_fit(cols, method)).first().asDict()
        fitted = df
        numbers = {k: F.lit(v).cast("double") for k, v in row.items()}

    scaled = {}
    for i, c in enumerate(cols):
        width = numbers[f"_width{i}"]
        scaled[c] = (F.col(f"`{c}`").cast("double") - numbers[f"_shift{i}"]) / F.when(
            width == 0, F.lit(1.0)
        ).otherwise(width)
    return fitted.select(
        *[scaled[c].alias(c) if c in scaled else F.col(f"`{c}`") for c in df.columns]
    )
