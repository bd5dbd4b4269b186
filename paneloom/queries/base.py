"""Registry of the runnable queries, each with the SQL that must give the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    """A query with the operators it exercises and its SQL counterpart."""

    run: Query
    operators: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(operators: str, sql: str | None = None, name: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""
    def add(fn: Query) -> Query:
        REGISTRY[name or fn.__name__] = Entry(fn, tuple(operators.split()), sql)
        return fn

    return add


def r(column: str, digits: int = 6, name: str | None = None) -> Column:
    """A rounded double; minus zero becomes zero."""
    value = F.round(F.col(f"`{column}`").cast("double"), digits) + F.lit(0.0)
    return value.alias(name or column)


def big(column: str, name: str | None = None) -> Column:
    """A whole number as bigint."""
    return F.col(f"`{column}`").cast("long").alias(name or column)


# Common table expressions over the given tables; each query's SQL picks what it needs.
WITH = """
WITH lines AS (
  SELECT o.o_custkey AS custkey, year(o.o_orderdate) AS season, o.o_orderkey, o.o_orderpriority, l.*
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
), panel AS (
  SELECT c.c_name || '_' || season || '_' || n.n_name AS player_season_team,
    c.c_custkey AS "CUSTKEY", c.c_name AS "PLAYER", c.c_mktsegment AS "POS", n.n_name AS "TEAM",
    CAST(season AS BIGINT) AS "SEASON",
    count(DISTINCT o_orderkey) AS "G",
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS "MP",
    CAST(count(*) AS DOUBLE) / count(DISTINCT o_orderkey) AS "FGA_per_game",
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS DOUBLE)
      / (count(DISTINCT o_orderkey) * 10000) AS "PTS_per_game",
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS "DISC_advanced",
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS "TAX_advanced",
    CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS "RET_advanced",
    CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) / count(*) AS "URG_advanced"
  FROM lines JOIN customer c ON c.c_custkey = custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  GROUP BY ALL
), spent AS (
  SELECT year(o_orderdate) AS season, o_custkey AS custkey,
    sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
  FROM orders GROUP BY ALL
), ballot AS (
  SELECT *, row_number() OVER (PARTITION BY season ORDER BY cents DESC, custkey) AS place FROM spent
  QUALIFY place <= 10
), votes AS (
  SELECT c_name || '_' || season || '_' || n_name AS player_season_team, c_name AS "PLAYER", n_name AS "TEAM",
    CAST(season AS BIGINT) AS "SEASON", place,
    CAST(cents AS DOUBLE) / CAST(sum(cents) OVER (PARTITION BY season) AS DOUBLE) AS "MVP_VOTES_SHARE",
    place = 1 AS "MVP_WINNER", place <= 3 AS "MVP_PODIUM", true AS "MVP_CANDIDATE"
  FROM ballot JOIN customer ON c_custkey = custkey JOIN nation ON n_nationkey = c_nationkey
), record AS (
  SELECT n_name AS "TEAM", r_name AS region, CAST(year(o_orderdate) AS BIGINT) AS "SEASON",
    count(*) FILTER (o_orderstatus = 'F') AS "W", count(*) FILTER (o_orderstatus = 'O') AS "L"
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey GROUP BY ALL
), standings AS (
  SELECT "TEAM" || '_' || "SEASON" AS "TEAM_SEASON", "SEASON", "TEAM", "W", "L",
    CASE WHEN "W" + "L" > 0 THEN CAST("W" AS DOUBLE) / ("W" + "L") END AS "W/L%",
    CASE WHEN "L" <= "W" THEN 0.0::DOUBLE ELSE CAST("L" - "W" AS DOUBLE) / 2 END AS "GB",
    replace(region, ' ', '_') || '_CONF' AS "CONF",
    row_number() OVER (PARTITION BY "SEASON", region
      ORDER BY CASE WHEN "W" + "L" > 0 THEN CAST("W" AS DOUBLE) / ("W" + "L") END DESC NULLS LAST, "TEAM") AS "CONF_RANK"
  FROM record
), joined AS (
  SELECT p.*, coalesce(v."MVP_VOTES_SHARE", 0.0) AS "MVP_VOTES_SHARE",
    coalesce(v."MVP_WINNER", false) AS "MVP_WINNER", coalesce(v."MVP_PODIUM", false) AS "MVP_PODIUM",
    coalesce(v."MVP_CANDIDATE", false) AS "MVP_CANDIDATE",
    s."W", s."L", s."W/L%", s."GB", s."CONF", s."CONF_RANK"
  FROM panel p LEFT JOIN votes v USING ("PLAYER", "TEAM", "SEASON") JOIN standings s USING ("TEAM", "SEASON")
), bronze AS (
  SELECT j.*,
    EXISTS (SELECT 1 FROM joined e WHERE e."PLAYER" = j."PLAYER" AND e."TEAM" = j."TEAM"
      AND e."SEASON" + 1 = j."SEASON" AND e."MVP_WINNER") AS "PREVIOUS_SEASON_MVP_WINNER",
    EXISTS (SELECT 1 FROM joined e WHERE e."PLAYER" = j."PLAYER" AND e."TEAM" = j."TEAM"
      AND e."SEASON" + 1 = j."SEASON" AND e."MVP_PODIUM" AND NOT e."MVP_WINNER")
      AS "PREVIOUS_SEASON_MVP_PODIUM_NOT_WINNER"
  FROM joined j
), silver AS (
  SELECT * FROM (SELECT *, max("G") OVER (PARTITION BY "SEASON") AS peak FROM bronze)
  WHERE "G" >= peak * 0.6::DOUBLE AND "FGA_per_game" >= 2 AND "MP" >= 20 AND "CONF_RANK" <= 3
), daily AS (
  SELECT CAST(ts AS DATE) AS "DATE", CAST(user_id AS VARCHAR) AS "PLAYER",
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS "PRED"
  FROM events GROUP BY ALL
)
"""

STATISTICS_SQL = (
    '"MP", "FGA_per_game", "PTS_per_game", "DISC_advanced", "TAX_advanced", "RET_advanced", "URG_advanced"'
)
