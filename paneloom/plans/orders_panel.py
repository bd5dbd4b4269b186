"""The order tables seen as a panel: customers per year, with their nations as teams.

Money and rates have two decimals and are summed as whole hundredths, so every sum is exact and does not depend on
how the rows were partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.text import entity_key, letters_only
from paneloom.operators.spread import settle, stage
from paneloom.operators.topk import top_per_group
from paneloom.plans.league import conform_standings
from paneloom.plans.stages import bronze, silver
from paneloom.schema import KEY

#: Silver limits that suit these tables: lines per order, lines' quantity and place within the region.
LIMITS = {"share_of_games": 0.6, "min_attempts": 2, "min_minutes": 20.0, "max_conf_rank": 3}
STATISTICS = [
    "G", "MP", "FGA_per_game", "PTS_per_game", "DISC_advanced", "TAX_advanced", "RET_advanced", "URG_advanced",
]
VOTERS = 10

_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its schema is looked up in the files once per session."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def hundredths(x: Column) -> Column:
    """A two-decimal number as a whole number of hundredths."""
    return F.rint(x * 100).cast("long")


def season() -> Column:
    return F.year("o_orderdate")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_nationkey, TEAM, CONF``; both tables are of fixed size, which the planner sees from the files."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("TEAM"), F.col("r_name").alias("CONF")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per customer and year.

    Lines are reduced to one row per order before they meet the orders, and orders to one row per customer and
    year before they meet the customers: both reductions start on the map side.
    """
    lines = table(spark, sf_dir, "lineitem")
    revenue = hundredths(F.col("l_extendedprice")) * hundredths(1 - F.col("l_discount"))
    per_order = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
        F.sum(revenue).alias("revenue"),
        F.sum(hundredths(F.col("l_discount"))).alias("discount"),
        F.sum(hundredths(F.col("l_tax"))).alias("tax"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", season().alias("SEASON"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    joined = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey)
    per_customer = joined.groupBy("o_custkey", "SEASON").agg(
        F.count(F.lit(1)).alias("G"),
        *[F.sum(c).alias(c) for c in ("lines", "quantity", "revenue", "discount", "tax", "returned")],
        F.sum(F.when(F.col("urgent"), F.col("lines")).otherwise(0)).alias("urgent"),
    )
    customers = table(spark, sf_dir, "customer")
    named = per_customer.join(customers, per_customer.o_custkey == customers.c_custkey).join(
        teams(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = entity_key(F.col("c_name"), F.col("SEASON"), F.col("TEAM"))
    return named.select(
        key.alias(KEY),
        F.col("c_custkey").alias("CUSTKEY"),
        F.col("c_name").alias("PLAYER"),
        F.col("c_mktsegment").alias("POS"),
        "TEAM",
        F.col("SEASON"),
        "G",
        (F.col("quantity") / F.col("lines")).alias("MP"),
        (F.col("lines") / F.col("G")).alias("FGA_per_game"),
        (F.col("revenue") / (F.col("G") * 10000)).alias("PTS_per_game"),
        (F.col("discount") / (F.col("lines") * 100)).alias("DISC_advanced"),
        (F.col("tax") / (F.col("lines") * 100)).alias("TAX_advanced"),
        (F.col("returned") / F.col("lines")).alias("RET_advanced"),
        (F.col("urgent") / F.col("lines")).alias("URG_advanced"),
    )


def ballot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per year the ten customers who spent most: ``SEASON, custkey, cents, place``."""
    spent = (
        table(spark, sf_dir, "orders")
        .groupBy(season().alias("SEASON"), F.col("o_custkey").alias("custkey"))
        .agg(F.sum(hundredths(F.col("o_totalprice"))).alias("cents"))
    )
    order = [F.col("cents").desc(), F.col("custkey").asc()]
    return settle(top_per_group(spent, ["SEASON"], VOTERS, order, "place"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the ballot and the flags that follow from the place."""
    top = ballot(spark, sf_dir)
    totals = top.groupBy("SEASON").agg(F.sum("cents").alias("total"))
    customers = table(spark, sf_dir, "customer")
    named = (
        top.join(totals, "SEASON")
        .join(customers, F.col("custkey") == customers.c_custkey)
        .join(teams(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    key = entity_key(F.col("c_name"), F.col("SEASON"), F.col("TEAM"))
    return named.select(
        key.alias(KEY),
        F.col("c_name").alias("PLAYER"),
        "TEAM",
        "SEASON",
        (F.col("cents") / F.col("total")).alias("MVP_VOTES_SHARE"),
        (F.col("place") == 1).alias("MVP_WINNER"),
        (F.col("place") <= 3).alias("MVP_PODIUM"),
        F.lit(True).alias("MVP_CANDIDATE"),
    )


def letter_name(name: Column) -> Column:
    """Nation names differ in their digits only, which the team clean-up removes: digits to letters first."""
    return F.translate(name, "0123456789", "ABCDEFGHIJ")


def team_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup from the cleaned name to the nation."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(letters_only(letter_name(F.col("n_name"))).alias("raw_name"), F.col("n_name").alias("code"))


def raw_standings(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """Wins (status F) and losses (status O) per nation and year, as text the way a standings page has them."""
    orders = table(spark, sf_dir, "orders")
    if until is not None:
        orders = orders.where(F.col("o_orderdate") <= F.lit(until).cast("timestamp_ntz"))
    per_customer = orders.groupBy("o_custkey", season().alias("SEASON")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("W"),
        F.count_if(F.col("o_orderstatus") == "O").alias("L"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    totals = joined.groupBy("c_nationkey", "SEASON").agg(F.sum("W").alias("W"), F.sum("L").alias("L"))
    named = totals.join(teams(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    behind = (F.col("L") - F.col("W")) / F.lit(2.0)
    return named.select(
        "SEASON",
        letters_only(letter_name(F.col("TEAM"))).alias("TEAM"),
        F.col("W").cast("string").alias("W"),
        F.col("L").cast("string").alias("L"),
        F.try_divide(F.col("W"), F.col("W") + F.col("L")).cast("string").alias("W/L%"),
        F.when(behind <= 0, F.lit("—")).otherwise(behind.cast("string")).alias("GB"),
        F.concat("CONF", F.lit(" Conference")).alias("CONF"),
    )


def standings(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """Conformed standings per nation and year."""
    return conform_standings(raw_standings(spark, sf_dir, until), team_codes(spark, sf_dir))


def panel_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, votes, standings and the flags of the year before."""
    return bronze(
        panel(spark, sf_dir), settle(votes(spark, sf_dir)), settle(standings(spark, sf_dir))
    )


def panel_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze after the filters, settled as a stage."""
    return stage(silver(panel_bronze(spark, sf_dir), **LIMITS))


def daily_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a prediction history: ``DATE, PLAYER, PRED``, one row per day and user."""
    events = table(spark, sf_dir, "events")
    day = F.to_date("ts").alias("DATE")
    user = F.col("user_id").cast("string").alias("PLAYER")
    sums = events.groupBy(day, user).agg(F.sum(hundredths(F.col("value"))).alias("cents"))
    return sums.select("DATE", "PLAYER", (F.col("cents") / 100).alias("PRED"))
