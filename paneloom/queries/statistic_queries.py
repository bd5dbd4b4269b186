"""Correlations, feature selection, encoding and splits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.operators.correlation import (
    correlation_matrix, pair_correlations, prune_correlated, select_features, target_correlations,
)
from paneloom.operators.dedupe import union_names
from paneloom.operators.encode import fit_one_hot, one_hot, sample_values
from paneloom.operators.folds import assign_folds, period_split
from paneloom.operators.spread import settle
from paneloom.plans import orders_panel as op
from paneloom.queries.base import WITH, big, query, r
from paneloom.schema import TARGET

_COLS = op.STATISTICS


def _pairs_sql(cols: list[str], digits: int = 6) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(abs(corr("{a}", "{b}")), {digits}) AS abs_corr FROM wide"""
        for a, b in combinations(cols, 2)
    )


@query("J1", WITH + ", wide AS (FROM panel) " + _pairs_sql(_COLS))
def pairwise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_correlations(op.panel(spark, sf_dir), _COLS).select("col_a", "col_b", r("abs_corr"))


@query("J1", WITH + ", wide AS (FROM panel) " + _pairs_sql(_COLS))
def pairwise_corr_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs the way they are computed when there are many columns."""
    rows = settle(op.panel(spark, sf_dir).select(*_COLS))
    return pair_correlations(rows, _COLS, in_aggregate=0).select("col_a", "col_b", r("abs_corr"))


_MORE = [*_COLS, "FGM_per_game", "PTS_36"]


@query(
    "J2",
    WITH + """, wide AS (SELECT *, "FGA_per_game" * 0.8 + "URG_advanced" * 0.05 AS "FGM_per_game",
        "PTS_per_game" * 0.5 + "MP" AS "PTS_36" FROM panel), pairs AS (""" + _pairs_sql(_MORE, 15)
    + ") SELECT c.name AS feature FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in _MORE) + """]) AS name) c
      WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE col_b = c.name AND abs_corr > 0.95 AND abs_corr < 1)""",
)
def corr_pruned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = op.panel(spark, sf_dir).select(*_COLS).withColumns(
        {
            "FGM_per_game": F.col("FGA_per_game") * 0.8 + F.col("URG_advanced") * 0.05,
            "PTS_36": F.col("PTS_per_game") * 0.5 + F.col("MP"),
        }
    )
    kept = prune_correlated(settle(wide), _MORE, 0.95)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


_CORNER = ["MP", "FGA_per_game", "PTS_per_game", "URG_advanced"]


@query(
    "J10",
    WITH + " UNION ALL ".join(
        f"""SELECT '{b}' AS "row", '{a}' AS "col", round(corr("{a}", "{b}"), 6) AS corr FROM panel"""
        for a, b in combinations(_CORNER, 2)
    ),
)
def corr_matrix_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation_matrix(op.panel(spark, sf_dir), _CORNER).select("row", "col", r("corr"))


_X = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CAST("{c}" AS DOUBLE) AS x, "MVP_VOTES_SHARE" AS y FROM bronze""" for c in _COLS
)
_LONG = f", long AS MATERIALIZED ({_X})"
_AVERAGE = "rank() OVER (PARTITION BY feature ORDER BY {c}) + (count(*) OVER (PARTITION BY feature, {c}) - 1) / 2.0::DOUBLE"
_PEARSON_SQL = "SELECT feature, abs(corr(x, y)) AS c FROM long GROUP BY feature"
_SPEARMAN_SQL = f"""SELECT feature, abs(corr(rx, ry)) AS c FROM (
    SELECT feature, {_AVERAGE.format(c='x')} AS rx, {_AVERAGE.format(c='y')} AS ry FROM long) GROUP BY feature"""
# Most rows share y = 0, so only pairs with a higher y on one side are joined.
_KENDALL_SQL = """SELECT s.feature, abs(s.s / sqrt((t.n0 - t.n1) * (t.n0 - t.n2))) AS c FROM (
    SELECT a.feature, CAST(sum(sign(a.x - b.x)) AS DOUBLE) AS s FROM long a JOIN long b ON a.feature = b.feature AND a.y > b.y
    GROUP BY ALL) s JOIN (
    SELECT feature, n0, n1, n2 FROM
      (SELECT feature, count(*) * (count(*) - 1) / 2.0::DOUBLE AS n0 FROM long GROUP BY ALL)
      JOIN (SELECT feature, sum(n * (n - 1) / 2.0::DOUBLE) AS n1 FROM
        (SELECT feature, x, count(*) AS n FROM long GROUP BY ALL) GROUP BY ALL) USING (feature)
      JOIN (SELECT feature, sum(n * (n - 1) / 2.0::DOUBLE) AS n2 FROM
        (SELECT feature, y, count(*) AS n FROM long GROUP BY ALL) GROUP BY ALL) USING (feature)
    ) t ON s.feature = t.feature"""


def _against_target(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    rows = settle(op.panel_bronze(spark, sf_dir).select(*_COLS, TARGET))
    return target_correlations(rows, _COLS, TARGET, method).select("feature", "method", r("abs_corr"))


def _target_sql(method: str, body: str) -> str:
    return WITH + _LONG + f" SELECT feature, '{method}' AS method, round(c, 6) AS abs_corr FROM ({body})"


@query("J3 J4", _target_sql("pearson", _PEARSON_SQL))
def target_corr_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _against_target(spark, sf_dir, "pearson")


@query("J3 J6", _target_sql("spearman", _SPEARMAN_SQL))
def target_corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _against_target(spark, sf_dir, "spearman")


@query("J3 J5", _target_sql("kendall", _KENDALL_SQL))
def target_corr_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _against_target(spark, sf_dir, "kendall")


@query(
    "J7 E5 C12",
    WITH + _LONG + f" SELECT DISTINCT feature FROM ({_PEARSON_SQL} UNION ALL {_SPEARMAN_SQL} UNION ALL {_KENDALL_SQL})"
    " WHERE c > 0.05",
)
def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(op.panel_bronze(spark, sf_dir).select(*_COLS, TARGET))
    names = union_names(
        *[
            select_features(target_correlations(rows, _COLS, TARGET, m), threshold=0.05)
            for m in ("pearson", "kendall", "spearman")
        ]
    )
    return spark.createDataFrame([(n,) for n in names], "feature string")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "J8",
    "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS BIGINT) AS \"c_mktsegment_{s}\"" for s in _SEGMENTS)
    + " FROM customer",
)
def segment_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = op.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    encoded = one_hot(customers, fit_one_hot(customers, ["c_mktsegment"]))
    return encoded.select("c_custkey", *[big(c) for c in encoded.columns[1:]])


@query(
    "J9",
    """SELECT c_custkey FROM (SELECT DISTINCT c_custkey FROM customer)
      QUALIFY row_number() OVER (ORDER BY md5(c_custkey || ':7'), c_custkey) <= floor(0.2::DOUBLE * count(*) OVER ())""",
)
def sampled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the customer keys by md5."""
    return sample_values(op.table(spark, sf_dir, "customer"), "c_custkey", 0.2, seed=7)


@query(
    "H7 C7",
    """WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS season FROM orders), s AS (
      SELECT season, row_number() OVER (ORDER BY season DESC) AS n, count(*) OVER () AS total
      FROM (SELECT DISTINCT season FROM o)
    ) SELECT season, CASE WHEN n <= floor(total * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS part, count(*) AS rows
      FROM o JOIN s USING (season) GROUP BY ALL""",
    name="period_split",
)
def split_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = op.table(spark, sf_dir, "orders").select("o_orderkey", op.season().cast("long").alias("season"))
    train, test = period_split(orders, "season", 0.3)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("season", "part").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "K3",
    """WITH n AS (SELECT count(*) AS n FROM customer) SELECT CAST(f AS BIGINT) AS fold,
      (SELECT n FROM n) // 3 + CASE WHEN (f + 2) % 3 < (SELECT n FROM n) % 3 THEN 1 ELSE 0 END AS rows
      FROM range(3) t(f)""",
)
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are numbered by md5 and dealt in turn, so the sizes differ by one at most."""
    customers = op.table(spark, sf_dir, "customer").select("c_custkey")
    folded, (name,) = assign_folds(customers, "c_custkey", 3)
    return folded.groupBy(big(name, "fold")).agg(F.count(F.lit(1)).alias("rows"))
