"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The month after which a new season begins, and the date format of the history.
LAST_MONTH_OF_SEASON = 9
HISTORY_DATE = "dd-MM-yyyy"


def season_of(date: Column, last_month: int = LAST_MONTH_OF_SEASON) -> Column:
    """Year in which the season of ``date`` ends: the next year once ``last_month`` has passed."""
    return F.year(date) + (F.month(date) > last_month).cast("int")


def history_date(text: Column) -> Column:
    """Date of a history row."""
    return F.to_date(text, HISTORY_DATE)


def earlier_of(a: Column, b: Column) -> Column:
    """The earlier of two dates."""
    return F.least(a, b)
