"""Text expressions for names, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed from an entity name, and the suffix dropped from feature names.
NAME_NOISE = "[ _'.*]"
PLAIN_SUFFIX = "_advanced"


def clean_name(name: Column) -> Column:
    """Entity name without spaces, underscores, apostrophes, dots and asterisks."""
    return F.regexp_replace(name, NAME_NOISE, "")


def letters_only(name: Column) -> Column:
    """Upper-case name with everything but A-Z removed."""
    return F.regexp_replace(F.upper(name), "[^A-Z]", "")


def entity_key(name: Column, period: Column, team: Column) -> Column:
    """``name_period_team`` with the spaces of the name removed; null if any part is null."""
    return F.concat(
        F.regexp_replace(name, " ", ""), F.lit("_"), period.cast("string"), F.lit("_"), team
    )


def place(rank_text: Column) -> Column:
    """Place from texts like ``1T``; a text without digits is a cast error."""
    return F.regexp_replace(rank_text, "[^0-9]", "").cast("int")


def dash_as_zero(text: Column) -> Column:
    """Number of a column that writes zero as a long dash."""
    return F.replace(text, F.lit("—"), F.lit("0.0")).cast("double")


def conference_label(name: Column) -> Column:
    """One label per conference, however the source spells it: ``EAST`` is ``EASTERN_CONF``."""
    label = F.replace(
        F.replace(F.upper(name), F.lit(" "), F.lit("_")), F.lit("CONFERENCE"), F.lit("CONF")
    )
    return (
        F.when(label == "EAST", F.lit("EASTERN_CONF"))
        .when(label == "WEST", F.lit("WESTERN_CONF"))
        .otherwise(label)
    )


def feature_label(name: Column) -> Column:
    """Readable feature name: no trailing ``_advanced``, spaces for underscores."""
    return F.replace(F.regexp_replace(name, f"{PLAIN_SUFFIX}$", ""), F.lit("_"), F.lit(" "))


def feature_label_text(name: str) -> str:
    """:func:`feature_label` for a column name."""
    return name.removesuffix(PLAIN_SUFFIX).replace("_", " ")


def percent_text(value: Column) -> Column:
    """``12.345`` as ``12.35%`` (two digits, thousands separated)."""
    return F.concat(F.format_number(value, 2), F.lit("%"))


def percent_value(text: Column) -> Column:
    """Number in front of a percent sign."""
    return F.replace(F.rtrim(text, F.lit("%")), F.lit(","), F.lit("")).cast("double")
