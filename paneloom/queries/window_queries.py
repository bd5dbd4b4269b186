"""Ranks, scaling, probabilities and the reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions.text import percent_text, percent_value
from paneloom.operators.filters import days_before, until
from paneloom.operators.probability import probability
from paneloom.operators.ranks import rank_by_group
from paneloom.operators.scale import scale_by_group
from paneloom.operators.spread import settle
from paneloom.operators.topk import best_of_group, entities_of_latest, top_per_group, top_rows
from paneloom.plans import orders_panel as op
from paneloom.plans.reports import build_history, history_report as report, ranking_report as ranking
from paneloom.queries.base import WITH, big, query, r

# ------------------------------------------------ ranks

_COUNTS = (
    "SELECT CAST(year(o_orderdate) AS BIGINT) AS season, o_custkey AS custkey, count(*) AS orders FROM orders GROUP BY ALL"
)


def _order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = op.table(spark, sf_dir, "orders")
    return settle(
        orders.groupBy(op.season().cast("long").alias("season"), F.col("o_custkey").alias("custkey"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )


@query(
    "G1",
    f"SELECT *, rank() OVER (PARTITION BY season ORDER BY orders DESC) AS place FROM ({_COUNTS})",
)
def season_rank_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_by_group(_order_counts(spark, sf_dir), ["season"], "orders", "place", method="min")


@query(
    "G2",
    f"""SELECT *, rank() OVER (PARTITION BY season ORDER BY orders DESC)
      + (count(*) OVER (PARTITION BY season, orders) - 1) / 2.0::DOUBLE AS place FROM ({_COUNTS})""",
)
def season_rank_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_by_group(_order_counts(spark, sf_dir), ["season"], "orders", "place", method="average")


@query(
    "G3",
    f"SELECT *, row_number() OVER (PARTITION BY season ORDER BY orders DESC, custkey) AS place FROM ({_COUNTS})",
)
def season_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_by_group(
        _order_counts(spark, sf_dir), ["season"], "orders", "place", method="position", tie=["custkey"]
    )


@query(
    "G2",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, rank() OVER (ORDER BY l_quantity DESC)
      + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS place FROM lineitem""",
)
def global_rank_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group with few distinct scores: ranked over the distinct scores, as if it did not fit a task."""
    lines = op.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    ranked = rank_by_group(lines, [], "l_quantity", "place", method="average", group_rows=0)
    return ranked.select("l_orderkey", big("l_linenumber"), "l_quantity", "place")


@query(
    "H4 H1",
    f"SELECT *, row_number() OVER (PARTITION BY season ORDER BY orders DESC, custkey) AS place FROM ({_COUNTS}) "
    "QUALIFY place <= 5",
)
def season_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("orders").desc(), F.col("custkey").asc()]
    top = top_per_group(_order_counts(spark, sf_dir), ["season"], 5, order, "place")
    return top.withColumn("place", big("place"))


@query(
    "F6",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS season, o_orderkey, o_totalprice FROM orders
      QUALIFY row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def best_order_of_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = op.table(spark, sf_dir, "orders").select(
        op.season().cast("long").alias("season"), "o_orderkey", "o_totalprice"
    )
    return best_of_group(orders, ["season"], "o_totalprice", "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("H2 H1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = op.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return top_rows(orders, 50, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


# ------------------------------------------------ scaling

_COLS = ["MP", "FGA_per_game", "PTS_per_game", "URG_advanced"]


def _scaled_sql(shift: str, width: str) -> str:
    parts = []
    for c in _COLS:
        s, w = shift.format(c=c), width.format(c=c)
        parts.append(f'round(("{c}" - {s}) / CASE WHEN {w} = 0 THEN 1 ELSE {w} END, 6) AS "{c}"')
    return ", ".join(parts)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("player_season_team", big("SEASON"), *[r(c) for c in _COLS])


@query(
    "G4",
    WITH + 'SELECT player_season_team, "SEASON", '
    + _scaled_sql('avg("{c}") OVER w', 'stddev_pop("{c}") OVER w')
    + ' FROM panel WINDOW w AS (PARTITION BY "SEASON")',
)
def scale_std_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scale_by_group(op.panel(spark, sf_dir), _COLS, group="SEASON"))


@query(
    "G5",
    WITH + 'SELECT player_season_team, "SEASON", '
    + _scaled_sql('min("{c}") OVER w', '(max("{c}") OVER w - min("{c}") OVER w)')
    + ' FROM panel WINDOW w AS (PARTITION BY "SEASON")',
)
def scale_minmax_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scale_by_group(op.panel(spark, sf_dir), _COLS, group="SEASON", method="minmax"))


@query(
    "G6",
    WITH + 'SELECT player_season_team, "SEASON", '
    + _scaled_sql(
        '(SELECT avg("{c}") FROM panel WHERE "SEASON" < 1999)',
        '(SELECT stddev_pop("{c}") FROM panel WHERE "SEASON" < 1999)',
    )
    + " FROM panel",
)
def scale_global_fit_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.panel(spark, sf_dir)
    return _shown(scale_by_group(rows, _COLS, fit_on=rows.where("SEASON < 1999")))


# ------------------------------------------------ probabilities and reports

_RANKED = """ranked AS (
  SELECT *, rank() OVER (PARTITION BY "DATE" ORDER BY "PRED" DESC)
    + (count(*) OVER (PARTITION BY "DATE", "PRED") - 1) / 2.0::DOUBLE AS "RANK" FROM daily
)"""


@query(
    "G7",
    WITH + """, shifted AS (SELECT *, exp("PRED" - max("PRED") OVER (PARTITION BY "DATE")) AS e FROM daily)
      SELECT "DATE", "PLAYER", round(e / sum(e) OVER (PARTITION BY "DATE"), 6) AS p FROM shifted""",
)
def softmax_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = settle(op.daily_scores(spark, sf_dir))
    return probability(days, ["DATE"], "PRED", "p", mode="softmax").select("DATE", "PLAYER", r("p"))


@query(
    "G8",
    WITH + """SELECT "DATE", "PLAYER", round("PRED" / nullif(sum("PRED") OVER (PARTITION BY "DATE"), 0), 6) AS p
      FROM daily""",
)
def share_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = settle(op.daily_scores(spark, sf_dir))
    return probability(days, ["DATE"], "PRED", "p").select("DATE", "PLAYER", r("p"))


@query(
    "G9 G2",
    WITH + f""", {_RANKED}, marked AS (
      SELECT *, CASE WHEN "RANK" <= 5 THEN exp("PRED" - max("PRED") OVER (PARTITION BY "DATE")) END AS e FROM ranked
    ) SELECT "DATE", "PLAYER", "RANK", round(CASE WHEN "RANK" <= 5
        THEN 100 * "PRED" / sum("PRED") FILTER ("RANK" <= 5) OVER (PARTITION BY "DATE") ELSE 0 END, 6) AS share,
      round(CASE WHEN "RANK" <= 5 THEN 100 * e / sum(e) OVER (PARTITION BY "DATE") ELSE 0 END, 6) AS soft FROM marked""",
)
def topn_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = settle(op.daily_scores(spark, sf_dir))
    ranked = rank_by_group(days, ["DATE"], "PRED", "RANK", method="average")
    chosen = {"rank": "RANK", "top_n": 5, "factor": 100.0}
    both = probability(ranked, ["DATE"], "PRED", "share", **chosen)
    both = probability(both, ["DATE"], "PRED", "soft", mode="softmax", **chosen)
    return both.select("DATE", "PLAYER", "RANK", r("share"), r("soft"))


_END, _TODAY = "2024-01-25", "2024-01-28"


@query(
    "K14 C9 H5 D8 G2 G8 I2",
    WITH + f""", {_RANKED}, kept AS (SELECT * FROM ranked WHERE "DATE" <= DATE '{_END}'),
    leaders AS (SELECT DISTINCT "PLAYER" FROM (
      SELECT "PLAYER" FROM kept ORDER BY "DATE" DESC, "PRED" DESC, "PLAYER" LIMIT 20))
    SELECT "DATE" AS date, "PLAYER" AS player, "PRED" AS prediction, date_diff('day', "DATE", DATE '{_END}') AS days_ago,
      "RANK" AS rank, round(chance, 6) AS chance FROM (
        SELECT *, 100 * "PRED" / sum("PRED") OVER (PARTITION BY "DATE") AS chance FROM kept)
    WHERE "PLAYER" IN (FROM leaders) AND date_diff('day', "DATE", DATE '{_END}') <= 14""",
)
def history_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = settle(op.daily_scores(spark, sf_dir))
    built = build_history(history, F.lit(_TODAY).cast("date"), F.lit(_END).cast("date"))
    done = report(built, keep_top_n=20, mode="share", keep_last_days=14)
    return done.select("date", "player", "prediction", big("days_ago"), "rank", r("chance"))


@query(
    "H5",
    WITH + """SELECT DISTINCT "PLAYER" FROM (
      SELECT "PLAYER" FROM daily ORDER BY "DATE" DESC, "PRED" DESC, "PLAYER" LIMIT 200)""",
)
def latest_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities_of_latest(op.daily_scores(spark, sf_dir), "PLAYER", "DATE", "PRED", 200)


@query(
    "C9 I2",
    WITH + f"""SELECT "DATE", count(*) AS n, date_diff('day', "DATE", DATE '{_END}') AS days_ago FROM daily
      WHERE "DATE" <= DATE '{_END}' GROUP BY ALL""",
)
def dates_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.least(F.lit(_TODAY).cast("date"), F.lit(_END).cast("date"))
    days = until(days_before(op.daily_scores(spark, sf_dir), "DATE", end, "days_ago"), "DATE", F.lit(_END).cast("date"))
    return days.groupBy("DATE", "days_ago").agg(F.count(F.lit(1)).alias("n")).withColumn("days_ago", big("days_ago"))


@query(
    "K15 G9 B17 H2 K2",
    WITH + """, scored AS (
      SELECT "PLAYER", greatest(sum("PRED") - 300, 0) AS "PRED" FROM daily GROUP BY "PLAYER"
    ), ranked AS (
      SELECT *, rank() OVER (ORDER BY "PRED" DESC) + (count(*) OVER (PARTITION BY "PRED") - 1) / 2.0::DOUBLE AS rk FROM scored
    ), chances AS (
      SELECT *, CASE WHEN rk <= 5 THEN 100 * "PRED" / sum("PRED") FILTER (rk <= 5) OVER () ELSE 0 END AS c FROM ranked
    ) SELECT "PLAYER", round("PRED", 4) AS "PRED", rk AS "MVP rank", round(c, 4) AS chance FROM chances
      ORDER BY rk, "PLAYER" LIMIT 10""",
)
def ranking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly scores, clamped at zero, ranked; probability among the best five, as number and as text."""
    from paneloom.functions.maths import clamp_at_zero

    totals = op.daily_scores(spark, sf_dir).groupBy("PLAYER").agg(F.sum("PRED").alias("PRED"))
    scored = settle(totals.withColumn("PRED", clamp_at_zero(F.col("PRED") - 300)))
    ranked = rank_by_group(scored, [], "PRED", "PRED_RANK", method="average")
    done = ranking(ranked, mode="share", top_n=5, show=10)
    return done.select("PLAYER", r("PRED", 4), "MVP rank", r("chance", 4))


@query(
    "B17",
    "SELECT o_orderkey, round(o_totalprice / 7, 2) AS value FROM orders",
)
def percent_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = op.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", percent_value(percent_text(F.col("o_totalprice") / 7)).alias("value"))
