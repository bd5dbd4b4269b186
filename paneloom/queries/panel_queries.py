"""Panel stages and league tables over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions.text import clean_name, dash_as_zero, entity_key
from paneloom.operators.cleaning import rank_flags
from paneloom.operators.dedupe import distinct_values
from paneloom.operators.filters import removed_rows
from paneloom.operators.joins import previous_period_flag
from paneloom.operators.scale import scale_by_group
from paneloom.operators.ranks import rank_by_group
from paneloom.operators.spread import slices_of
from paneloom.operators.summary import conditional_counts, periods_with
from paneloom.operators.topk import top_per_group
from paneloom.plans import league
from paneloom.plans import orders_panel as op
from paneloom.plans.stages import filter_audit, fit_gold, gold
from paneloom.queries.base import STATISTICS_SQL, WITH, big, query, r
from paneloom.schema import KEY, NOT_FEATURES

_BRONZE = [
    KEY, "PLAYER", "TEAM", "POS", "CONF", "MVP_VOTES_SHARE", "MVP_WINNER", "MVP_PODIUM", "MVP_CANDIDATE",
    "W/L%", "GB", "PREVIOUS_SEASON_MVP_WINNER", "PREVIOUS_SEASON_MVP_PODIUM_NOT_WINNER",
    "MP", "FGA_per_game", "PTS_per_game", "DISC_advanced", "TAX_advanced", "RET_advanced", "URG_advanced",
]
_BRONZE_SQL = (
    'SELECT player_season_team, "PLAYER", "TEAM", "POS", "CONF", "MVP_VOTES_SHARE", "MVP_WINNER", "MVP_PODIUM", '
    '"MVP_CANDIDATE", "W/L%", "GB", "PREVIOUS_SEASON_MVP_WINNER", "PREVIOUS_SEASON_MVP_PODIUM_NOT_WINNER", '
    f'{STATISTICS_SQL}, "SEASON", "G", "W", "L", "CONF_RANK" FROM '
)


def _wide(df: DataFrame) -> DataFrame:
    whole = [big(c) for c in ("SEASON", "G", "W", "L", "CONF_RANK")]
    return df.select(*[F.col(f"`{c}`") for c in _BRONZE], *whole)


@query("J12 D1 D2 D3 B8 B12 E4", WITH + _BRONZE_SQL + "bronze")
def panel_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(op.panel_bronze(spark, sf_dir))


@query("J13 C5 C6 F3", WITH + _BRONZE_SQL + "silver")
def panel_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(op.panel_silver(spark, sf_dir))


@query(
    "C11",
    WITH + 'SELECT player_season_team, "SEASON", "MVP_VOTES_SHARE" FROM bronze b WHERE "MVP_CANDIDATE" '
    "AND player_season_team NOT IN (SELECT player_season_team FROM silver)",
)
def removed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = op.panel_bronze(spark, sf_dir)
    after = op.silver(before, **op.LIMITS)
    lost = removed_rows(before, after, [KEY], F.col("MVP_CANDIDATE"))
    return lost.select(KEY, big("SEASON"), "MVP_VOTES_SHARE")


@query(
    "F1 C11",
    WITH + """, parts AS (
      SELECT 'before' AS stage, * FROM bronze UNION ALL SELECT 'after', * EXCLUDE (peak) FROM silver
      UNION ALL SELECT 'removed', * FROM bronze WHERE "MVP_CANDIDATE"
        AND player_season_team NOT IN (SELECT player_season_team FROM silver)
    ) SELECT stage, count(*) AS rows, count(*) FILTER ("MVP_CANDIDATE") AS candidates,
      count(*) FILTER ("MVP_WINNER") AS winners FROM parts GROUP BY stage""",
    name="filter_audit",
)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = op.panel_bronze(spark, sf_dir)
    return filter_audit(before, op.silver(before, **op.LIMITS)).select("stage", "rows", "candidates", "winners")


@query(
    "D3",
    WITH + """SELECT v."PLAYER", v."TEAM", v."SEASON",
      EXISTS (SELECT 1 FROM votes e WHERE e."PLAYER" = v."PLAYER" AND e."TEAM" = v."TEAM"
        AND e."SEASON" + 1 = v."SEASON" AND e."MVP_PODIUM") AS was_on_podium FROM panel v""",
)
def prev_season_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.panel(spark, sf_dir).select("PLAYER", "TEAM", "SEASON").join(
        op.votes(spark, sf_dir).select("PLAYER", "TEAM", "SEASON", "MVP_PODIUM"), ["PLAYER", "TEAM", "SEASON"], "left"
    )
    flagged = previous_period_flag(
        rows, ["PLAYER", "TEAM"], "SEASON", F.coalesce("MVP_PODIUM", F.lit(False)), "was_on_podium"
    )
    return flagged.select("PLAYER", "TEAM", big("SEASON"), "was_on_podium")


_STANDINGS_SQL = 'SELECT "TEAM_SEASON", "SEASON", "TEAM", "CONF", "W", "L", "W/L%", "GB", "CONF_RANK" FROM standings'


def _standings(df: DataFrame) -> DataFrame:
    return df.select(
        "TEAM_SEASON", "TEAM", "CONF", "`W/L%`", "GB", *[big(c) for c in ("SEASON", "W", "L", "CONF_RANK")]
    )


@query("J17 G3 B7 B13 B14 B20 C2 D5", WITH + _STANDINGS_SQL)
def conf_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standings(op.standings(spark, sf_dir))


_CUT = "1999-06-30"


@query(
    "J18 C9",
    WITH.replace(
        "JOIN region ON r_regionkey = n_regionkey GROUP BY ALL",
        f"JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate <= TIMESTAMP '{_CUT}' GROUP BY ALL",
    ) + _STANDINGS_SQL,
)
def standings_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standings(op.standings(spark, sf_dir, until=_CUT))


@query(
    "F1 F2 F3 E6",
    WITH + """SELECT "SEASON", count(*) AS rows, count(*) FILTER ("MVP_CANDIDATE") AS candidates,
      count(*) FILTER ("MVP_WINNER") AS winners, max("G") AS most_games,
      (SELECT count(DISTINCT "SEASON") FROM bronze WHERE "MVP_WINNER") AS seasons_with_winner
      FROM bronze GROUP BY "SEASON\"""",
)
def season_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = op.panel_bronze(spark, sf_dir)
    conditions = {"candidates": F.col("MVP_CANDIDATE"), "winners": F.col("MVP_WINNER")}
    counts = conditional_counts(data, conditions, ["SEASON"])
    peaks = data.groupBy("SEASON").agg(F.max("G").alias("most_games"))
    found = periods_with(data, "SEASON", F.col("MVP_WINNER"), "n").scalar()
    return counts.join(peaks, "SEASON").select(
        big("SEASON"), "rows", "candidates", "winners", "most_games", found.alias("seasons_with_winner")
    )


@query("E6", WITH + 'SELECT DISTINCT "SEASON" FROM panel')
def panel_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(op.panel(spark, sf_dir), "SEASON").select(big("SEASON"))


_Z = ["MP", "FGA_per_game", "PTS_per_game"]


def season_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver rows scaled within their season, scored and ranked: the best three of each season."""
    scaled = scale_by_group(op.panel_silver(spark, sf_dir), _Z, group="SEASON")
    scored = scaled.withColumn("score", sum((F.col(c) for c in _Z), F.lit(0.0)))
    ranked = rank_by_group(scored, ["SEASON"], "score", "score_rank", method="min")
    best = top_per_group(ranked, ["SEASON"], 3, [F.col("score").desc(), F.col(KEY).asc()], "place")
    return best.select(KEY, "PLAYER", "TEAM", big("SEASON"), r("score"), big("score_rank"), big("place"))


_SCORE_SQL = " + ".join(
    f'coalesce(("{c}" - avg("{c}") OVER w) / nullif(stddev_pop("{c}") OVER w, 0), 0)' for c in _Z
)
query(
    "C5 C6 G1 G4 H4",
    WITH + f""", scored AS (
      SELECT player_season_team, "PLAYER", "TEAM", "SEASON", {_SCORE_SQL} AS score
      FROM silver WINDOW w AS (PARTITION BY "SEASON")
    ) SELECT player_season_team, "PLAYER", "TEAM", "SEASON", round(score, 6) AS score,
        rank() OVER (PARTITION BY "SEASON" ORDER BY score DESC) AS score_rank,
        row_number() OVER (PARTITION BY "SEASON" ORDER BY score DESC, player_season_team) AS place
      FROM scored QUALIFY place <= 3""",
)(season_top3)


_GOLD_NUM = ["G", "MP", "FGA_per_game", "PTS_per_game", "DISC_advanced", "W/L%"]
_GOLD_SQL = ", ".join(
    f'round(coalesce(("{c}" - avg("{c}") OVER w) / nullif(stddev_pop("{c}") OVER w, 0), '
    f'CASE WHEN "{c}" IS NOT NULL THEN 0.0 END), 6) AS "{c}"'
    for c in _GOLD_NUM
)
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "J14 D9 G1 G4 J8 B18",
    WITH + f"""SELECT player_season_team, "PLAYER", "TEAM", "SEASON", "MVP_WINNER", "PREVIOUS_SEASON_MVP_WINNER",
      {_GOLD_SQL}, {", ".join(f'''CAST("POS" = '{s}' AS BIGINT) AS "POS_{s}"''' for s in _SEGMENTS)},
      rank() OVER (PARTITION BY "SEASON" ORDER BY "MVP_VOTES_SHARE" DESC) AS "MVP_RANK"
      FROM silver WINDOW w AS (PARTITION BY "SEASON")""",
)
def panel_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = op.panel_silver(spark, sf_dir).drop("CUSTKEY")
    recipe = fit_gold(data)
    done = gold(data, recipe)
    return done.select(
        KEY, "PLAYER", "TEAM", big("SEASON"), "MVP_WINNER", "PREVIOUS_SEASON_MVP_WINNER",
        *[r(c) for c in _GOLD_NUM], *[big(f"POS_{s}") for s in _SEGMENTS], big("MVP_RANK"),
    )


@query(
    "J11 A4 I8 C12 B18",
    WITH + """SELECT 'cat' AS kind, unnest(['CONF', 'POS', 'PREVIOUS_SEASON_MVP_PODIUM_NOT_WINNER',
        'PREVIOUS_SEASON_MVP_WINNER']) AS feature
      UNION ALL SELECT 'num', unnest(['CONF_RANK', 'DISC_advanced', 'FGA_per_game', 'G', 'GB', 'MP',
        'PTS_per_game', 'RET_advanced', 'TAX_advanced', 'URG_advanced', 'W', 'L', 'W/L%'])""",
)
def manifest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a manifest and read back; the threshold keeps every column of the panel."""
    from paneloom.session import shared_folder
    from paneloom.sources.manifest import Features, read_features_table, write_features

    data = op.panel_silver(spark, sf_dir).drop("CUSTKEY")
    recipe = fit_gold(data, not_features=NOT_FEATURES, max_correlation=1.0)
    path = shared_folder(spark, "features")
    write_features(spark, Features(recipe.cat, recipe.num, recipe.encoded), path)
    lists = read_features_table(spark, path)
    kinds = [lists.select(F.lit(k).alias("kind"), F.explode(k).alias("feature")) for k in ("cat", "num")]
    return kinds[0].unionByName(kinds[1])


# ------------------------------------------------ league tables rendered to HTML and parsed back


def _page(rows: DataFrame, keys: list, header: list[str], cells: list, *, table_id: str | None, top: str = "") -> DataFrame:
    """Pages of at most a few hundred rows each: ``keys`` must bound the rows per page."""
    names = rows.select(*keys).columns

    def escaped(c):
        return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    row = F.concat(
        F.lit("<tr>"),
        *[F.concat(F.lit("<td>"), F.coalesce(escaped(c.cast("string")), F.lit("")), F.lit("</td>")) for c in cells],
        F.lit("</tr>"),
    )
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in header) + "</tr>"
    opening = f'<table id="{table_id}">' if table_id else "<table>"
    # Spread by page: parsing costs time rather than bytes, so the pages should not share a few partitions.
    spread = rows.select(*keys, row.alias("_row")).repartition(slices_of(rows), *names)
    listed = spread.groupBy(*names).agg(F.sort_array(F.collect_list("_row")).alias("body"))
    return listed.withColumn(
        "html",
        F.concat(
            F.lit(f"<html><body><p>text</p>{opening}{top}{head}"), F.array_join("body", ""),
            F.lit("</table></body></html>"),
        ),
    ).drop("body")


#: Customers per rendered page and season, which bounds the size of a page.
_PER_PAGE = 200


@query(
    "J15 A6 B1 B4 B6 B8 B9 B10 B11 C1 D4 E1 E2",
    WITH + """SELECT replace("PLAYER", '_', '') || '_' || "SEASON" || '_' || "TEAM" AS player_season_team,
      "PLAYER", "TEAM", "POS", "SEASON", CAST("G" AS DOUBLE) AS "G", "MP", "FGA_per_game", 0.0::DOUBLE AS "3P_per_game",
      "RET_advanced" AS "TS%_advanced", "URG_advanced" AS "VORP_advanced" FROM panel""",
)
def entity_stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two statistics tables per season rendered as pages, then rebuilt into one wide table."""
    rows = op.panel(spark, sf_dir)
    keys = [
        F.col("SEASON").alias("season"), F.floor(F.col("CUSTKEY") / _PER_PAGE).alias("page_id"),
    ]
    empty = F.lit(None).cast("string")
    games = _page(
        rows, keys, ["Rk", "Player", "Pos", "Tm", "G", "MP", "FGA", "3P"],
        [F.lit(1), F.col("PLAYER"), F.col("POS"), F.col("TEAM"), F.col("G"), F.col("MP"), F.col("FGA_per_game"), empty],
        table_id=None, top="",
    ).withColumn("stat_type", F.lit("per_game"))
    advanced = _page(
        rows, keys, ["Rk", "Player", "Tm", "G", "MP", "TS%", "VORP", "Awards"],
        [F.lit(1), F.col("PLAYER"), F.col("TEAM"), empty, F.lit(0), F.col("RET_advanced"), F.col("URG_advanced"), empty],
        table_id=None,
    ).withColumn("stat_type", F.lit("advanced"))
    table = league.player_stats(games.unionByName(advanced))
    return table.select(
        KEY, "PLAYER", "TEAM", "POS", big("SEASON"), "G", "MP", "FGA_per_game", "3P_per_game",
        "`TS%_advanced`", "VORP_advanced",
    )


@query(
    "J16 A6 B1 B2 B5 B6 B15 B8",
    WITH + """SELECT player_season_team, "PLAYER", "TEAM", "SEASON", "MVP_VOTES_SHARE", "MVP_WINNER", "MVP_PODIUM",
      "MVP_CANDIDATE" FROM votes""",
)
def votes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten-row ballot of each season rendered as a page with a two-row header, then parsed."""
    top = op.ballot(spark, sf_dir)
    totals = top.groupBy("SEASON").agg(F.sum("cents").alias("total"))
    customers = op.table(spark, sf_dir, "customer")
    rows = (
        top.join(totals, "SEASON").join(customers, F.col("custkey") == customers.c_custkey)
        .join(op.teams(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    rank = F.concat(F.col("place").cast("string"), F.when(F.col("place") % 2 == 0, F.lit("T")).otherwise(F.lit("")))
    pages = _page(
        rows, [F.col("SEASON").alias("season"), F.col("SEASON").alias("page_id")], ["Rank", "Player", "Tm", "Share"],
        [rank, F.concat("c_name", F.lit("*")), F.col("TEAM"), F.col("cents") / F.col("total")],
        table_id="nba_mvp", top='<tr><th colspan="3"></th><th>Voting</th></tr>',
    )
    table = league.votes(pages)
    return table.select(
        KEY, "PLAYER", "TEAM", big("SEASON"), "MVP_VOTES_SHARE", "MVP_WINNER", "MVP_PODIUM", "MVP_CANDIDATE"
    )


@query(
    "A6 C1 C2 C3 B1 B2 B3 B4 B5",
    """SELECT s_suppkey AS suppkey, replace(s_name, '#', '') AS name, n_name AS nation, s_acctbal AS acctbal,
      'supplier' AS kind FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as one page per nation and key range, with noise rows that the clean-up has to remove."""
    from paneloom.operators import cleaning as c
    from paneloom.operators.filters import drop_containing, drop_header_repeats, drop_incomplete
    from paneloom.sources.html import cell, html_tables as parse

    suppliers = op.table(spark, sf_dir, "supplier").join(
        op.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    noise = (
        "<tr><td>Supplier</td><td>Name</td><td>Nation</td><td>Balance</td><td>x</td></tr>"
        "<tr><td>WEST DIVISION</td><td>a</td><td>b</td><td>0</td><td>x</td></tr>"
        "<tr><td>7</td><td></td><td>c</td><td>1</td><td>x</td></tr>"
    )
    header = ["Supplier", "Name", "Nation", "Balance", "Notes"]
    pages = _page(
        suppliers, [F.col("s_nationkey"), F.floor(F.col("s_suppkey") / 1000).alias("page_id")], header,
        [F.col("s_suppkey"), F.regexp_replace("s_name", "#", ""), F.col("n_name"), F.col("s_acctbal"), F.lit("x")],
        table_id="suppliers",
    ).withColumn("html", F.replace("html", F.lit("</table>"), F.lit(noise + "</table>")))
    rows = parse(pages, ["missing", "suppliers"]).select(*[cell(h).alias(h) for h in header])
    rows = drop_incomplete(drop_containing(drop_header_repeats(rows, "Supplier", "Supplier"), "Supplier", "DIVISION"))
    rows = c.drop_columns(c.rename_first(c.upper_columns(rows), "SUPPKEY"), containing=["NOTES"])
    rows = c.rename_columns(rows, {"BALANCE": "ACCTBAL"})
    rows = c.constant_columns(c.rename_columns(rows, str.lower), {"kind": "supplier"})
    typed = c.cast_columns(rows, {"suppkey": "long", "acctbal": "double"})
    return c.keep_columns(typed, ["suppkey", "name", "nation", "acctbal", "kind"])


@query(
    "B6 B8 B14 B15",
    WITH + """SELECT player_season_team AS key, "PLAYER" AS clean, place = 1 AS "MVP_WINNER", place <= 3 AS "MVP_PODIUM",
      true AS "MVP_CANDIDATE", CASE WHEN place % 2 = 0 THEN 0.0::DOUBLE ELSE CAST(place AS DOUBLE) / 2 END AS behind
      FROM votes""",
    name="rank_flags",
)
def flags_from_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = op.ballot(spark, sf_dir).join(
        op.table(spark, sf_dir, "customer"), F.col("custkey") == F.col("c_custkey")
    ).join(op.teams(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    shown = top.select(
        entity_key(F.col("c_name"), F.col("SEASON"), F.col("TEAM")).alias("key"),
        clean_name(F.concat(F.lit(" "), "c_name", F.lit("*"))).alias("clean"),
        F.concat(F.col("place").cast("string"), F.lit("T")).alias("RANK"),
        dash_as_zero(
            F.when(F.col("place") % 2 == 0, F.lit("—")).otherwise((F.col("place") / 2).cast("string"))
        ).alias("behind"),
    )
    return rank_flags(shown, "RANK", "MVP_")
