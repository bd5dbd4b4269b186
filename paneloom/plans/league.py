"""League tables out of fetched pages: player statistics, votes, standings and schedules.

Every function takes all pages of all seasons at once; the season is a column, never a loop.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.text import (
    clean_name, conference_label, dash_as_zero, entity_key, letters_only,
)
from paneloom.operators.cleaning import rank_flags
from paneloom.operators.dedupe import keep_first
from paneloom.operators.filters import drop_containing, drop_header_repeats, keep_members
from paneloom.operators.joins import map_or_raise, outer_concat
from paneloom.operators.ranks import rank_by_group
from paneloom.operators.spread import attach, settle
from paneloom.schema import DEFAULT_STAT_TYPES, KEY, NOT_STATISTICS, SHARED, STAT_TYPES
from paneloom.sources.html import cell, has_column, header_names, html_tables

# Ids of the tables in the pages, and the two-row header of the votes table.
VOTE_TABLES = ["mvp", "nba_mvp"]
VOTE_HEADER_ROW = 1
STANDINGS_TABLES = {"standings_e": "EASTERN_CONF", "standings_w": "WESTERN_CONF"}
SCHEDULE_TABLES = ["schedule"]
# Text columns of the statistics; schedule columns that are dropped, and its marker row.
TEXT_COLUMNS = ["PLAYER", "POS", "TEAM"]
SCHEDULE_DROPPED = "UNNAMED|NOTES|START|ATTEND|ARENA"
PLAYOFFS = "Playoffs"
# Seasons without a usable marker, with the first date of their later part.
LATER_PART_STARTS = {2020: "2020-08-17"}


def player_stats(
    pages: DataFrame,
    *,
    stat_types: Iterable[str] | None = DEFAULT_STAT_TYPES,
    seasons: Iterable[int] | None = None,
    teams: Iterable[str] | None = None,
) -> DataFrame:
    """One row per player, season and team from pages ``page_id, season, stat_type, html``.

    Statistics get the suffix of their table. A shared column comes from the first table that has any value for
    it in that season.
    """
    wanted = [t for t in STAT_TYPES if stat_types is None or t in [str(s).lower() for s in stat_types]]
    pages = keep_members(keep_members(pages, "season", seasons), "stat_type", wanted)
    rows = html_tables(pages).withColumnRenamed("season", "SEASON")
    rows = rows.withColumn("PLAYER", cell("PLAYER"))
    rows = drop_header_repeats(rows, "PLAYER", "Player")
    rows = rows.withColumns(
        {
            "PLAYER": clean_name(F.col("PLAYER")),
            "TEAM": F.coalesce(cell("TEAM"), cell("TM")),
            # One number that follows document order across the pages of a table.
            "doc_ord": F.struct("page_id", "row_ord"),
        }
    )
    rows = rows.withColumn(KEY, entity_key(F.col("PLAYER"), F.col("SEASON"), F.col("TEAM")))
    # Parsed once: the header names below and the table itself read the settled rows.
    rows = settle(keep_first(rows, ["stat_type", KEY], ["doc_ord"]))

    tables = {t: _stat_table(rows.where(F.col("stat_type") == t), t) for t in wanted}
    joined = outer_concat(list(tables.values()), [KEY, "SEASON"])
    return keep_members(_first_filled(joined, tables), "TEAM", teams, fold="upper")


def _stat_table(rows: DataFrame, stat_type: str) -> DataFrame:
    """Typed columns of one statistics table; shared columns are marked with the table they come from."""
    statistics = [
        c for c in header_names(rows) if c not in (*NOT_STATISTICS, "PLAYER", "TEAM", "TM", "SEASON")
    ]
    columns: list[Column] = [F.col(KEY), F.col("SEASON")]
    for c in ["PLAYER", "TEAM", *statistics]:
        value = F.col(c) if c in ("PLAYER", "TEAM") else cell(c)
        if c not in TEXT_COLUMNS:
            value = value.cast("double")
        if c.startswith("3P"):
            # Zero where the table has the column without a value; a season without the column stays null.
            value = F.when(has_column(c), F.coalesce(value, F.lit(0.0)))
        columns.append(value.alias(f"{c}@{stat_type}" if c in SHARED else f"{c}_{stat_type}"))
    return rows.select(*columns)


def _first_filled(joined: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Resolve ``NAME@table`` columns: per season, the first table with a value decides."""
    marked = [c for c in joined.columns if "@" in c]
    names = list(dict.fromkeys(c.split("@")[0] for c in marked))
    counts = joined.groupBy("SEASON").agg(*[F.count(F.col(f"`{c}`")).alias(f"#{c}") for c in marked])
    resolved = attach(joined, counts, ["SEASON"])
    columns = [F.col(KEY), F.col("SEASON")]
    for name in names:
        value = None
        for t in tables:
            c = f"{name}@{t}"
            if c not in marked:
                continue
            filled = F.col(f"`#{c}`") > 0
            value = F.when(filled, F.col(f"`{c}`")) if value is None else value.when(filled, F.col(f"`{c}`"))
        columns.append(value.alias(name))
    rest = [F.col(f"`{c}`") for c in joined.columns if c not in (KEY, "SEASON", *marked)]
    return resolved.select(*columns, *rest)


def votes(pages: DataFrame, *, seasons: Iterable[int] | None = None) -> DataFrame:
    """Votes per player from pages ``page_id, season, html``; a page without the table is an error."""
    rows = html_tables(
        keep_members(pages, "season", seasons), VOTE_TABLES, header_row=VOTE_HEADER_ROW, missing="raise"
    )
    named = rows.select(
        clean_name(cell("PLAYER")).alias("PLAYER"),
        F.coalesce(cell("TEAM"), cell("TM")).alias("TEAM"),
        F.col("season").alias("SEASON"),
        cell("SHARE").cast("double").alias("MVP_VOTES_SHARE"),
        cell("RANK").alias("RANK"),
    )
    key = entity_key(F.col("PLAYER"), F.col("SEASON"), F.col("TEAM"))
    return rank_flags(named, "RANK", "MVP_").select(key.alias(KEY), "*")


def standings(
    pages: DataFrame,
    lookup: DataFrame,
    *,
    period: str = "season",
    seasons: Iterable[int] | None = None,
) -> DataFrame:
    """Standings per team from pages ``page_id, season, html`` that hold both conference tables.

    The same serves standings as of a date: give the pages a date column and name it in ``period``.
    """
    pages = keep_members(pages, period, seasons)
    halves = None
    for table_id, conference in STANDINGS_TABLES.items():
        rows = html_tables(pages, [table_id], missing="skip")
        part = rows.withColumn("CONF", F.lit(conference))
        halves = part if halves is None else halves.unionByName(part)
    raw = halves.where(~F.exists("cells", lambda c: c.isNull()) & (F.size("cells") == F.size("names")))
    named = raw.select(
        F.col(period).alias("SEASON") if period == "season" else F.col(period),
        letters_only(F.col("cells")[0]).alias("TEAM"),
        *[cell(c).alias(c) for c in ("W", "L", "W/L%", "GB", "PW", "PL", "PS/G", "PA/G")],
        "CONF",
    )
    return conform_standings(
        named, lookup, period="SEASON" if period == "season" else period
    )


def conform_standings(
    named: DataFrame, lookup: DataFrame, *, period: str = "SEASON"
) -> DataFrame:
    """Section rows out, casts, rank within conference, team codes (unknown names are an error), key."""
    kept = drop_containing(named, "TEAM", "DIVISION")
    typed = kept.withColumns(
        {
            "W": F.col("W").cast("int"),
            "L": F.col("L").cast("int"),
            "W/L%": F.col("`W/L%`").cast("double"),
            "GB": dash_as_zero(F.col("GB")),
            "CONF": conference_label(F.col("CONF")),
            **{c: F.col(f"`{c}`").cast("double") for c in ("PW", "PL", "PS/G", "PA/G") if c in kept.columns},
        }
    )
    # One row per team and period; the ranking looks at group sizes before it ranks.
    ranked = rank_by_group(settle(typed), [period, "CONF"], "W/L%", "CONF_RANK", method="position", tie=["TEAM"])
    coded = map_or_raise(ranked, "TEAM", lookup, "raw_name", "code")
    key = F.concat("TEAM", F.lit("_"), F.col(period).cast("string"))
    return coded.withColumn("CONF_RANK", F.col("CONF_RANK").cast("int")).select(key.alias("TEAM_SEASON"), "*")


def schedule(
    pages: DataFrame,
    *,
    playoffs: bool = False,
    later_part_starts: dict[int, str] | None = None,
    date_format: str = "MMM d, yyyy",
) -> DataFrame:
    """Games before (or, with ``playoffs``, after) the playoff marker, from pages ``season, page_id, html``.

    Pages follow each other by ``page_id``. Repeated games are dropped before the marker is looked for.
    """
    rows = html_tables(pages, SCHEDULE_TABLES, missing="skip")
    kept = F.filter(
        F.arrays_zip("names", "cells"),
        lambda z: z["names"].isNotNull() & ~z["names"].rlike(SCHEDULE_DROPPED),
    )
    rows = rows.select("season", F.struct("page_id", "row_ord").alias("at"), kept["cells"].alias("c"))
    named = rows.select(
        "season", "at",
        F.get("c", F.lit(0)).alias("DATE"), F.get("c", F.lit(1)).alias("VISITOR"),
        F.get("c", F.lit(2)).cast("int").alias("VISITOR_PTS"), F.get("c", F.lit(3)).alias("HOME"),
        F.get("c", F.lit(4)).cast("int").alias("HOME_PTS"),
    )
    named = keep_first(named, ["season", "DATE", "HOME", "VISITOR"], ["at"])
    starts = LATER_PART_STARTS if later_part_starts is None else later_part_starts
    return split_schedule(named, starts, playoffs=playoffs, date_format=date_format)


def split_schedule(
    games: DataFrame, starts: dict[int, str], *, playoffs: bool, date_format: str, marker: str = PLAYOFFS
) -> DataFrame:
    """Split each season at its marker row, or at the first date given for it in ``starts``."""
    is_marker = F.col("DATE") == marker
    day = F.regexp_replace("DATE", "^[A-Za-z]+, ", "")
    dated = games.withColumn("_day", F.when(~is_marker, F.to_date(day, date_format)))
    start = F.lit(None).cast("date")
    for season, first in starts.items():
        start = F.when(F.col("season") == season, F.lit(first).cast("date")).otherwise(start)
    dated = dated.withColumn("_start", start)
    positions = dated.groupBy("season").agg(
        F.min(F.when(is_marker, F.col("at"))).alias("_marker"),
        F.max(F.col("_day") == F.col("_start")).alias("_started"),
    )
    placed = attach(dated, positions, ["season"]).where(~is_marker)
    by_marker = F.coalesce(F.col("at") > F.col("_marker"), F.lit(False))
    by_date = F.coalesce(F.col("_started") & (F.col("_day") >= F.col("_start")), F.lit(False))
    later = F.when(F.col("_start").isNotNull(), by_date).otherwise(by_marker)
    return placed.where(later if playoffs else ~later).select(
        F.col("season").alias("SEASON"), F.col("_day").alias("DATE"), "VISITOR", "VISITOR_PTS", "HOME", "HOME_PTS"
    )
