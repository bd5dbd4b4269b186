"""Ranks, scaling and probabilities, also with one group that holds most rows."""

import math

import pytest
from pyspark.sql import functions as F

from paneloom.operators.probability import probability
from paneloom.operators.ranks import rank_by_group
from paneloom.operators.scale import scale_by_group
from paneloom.operators.spread import running_total
from paneloom.operators import topk
from conftest import rows


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(
        [("g", i, s) for i, s in enumerate([0.5, 0.5, 0.1, 0.1, 0.0])] + [("g", 9, None)], "g string, id int, s double"
    )


@pytest.mark.parametrize("group_rows", [1000, 0])
@pytest.mark.parametrize(
    "method, expected",
    [
        ("min", [1, 1, 3, 3, 5, None]),
        ("average", [1.5, 1.5, 3.5, 3.5, 5.0, None]),
        ("position", [1, 2, 3, 4, 5, 6]),
    ],
)
def test_ranks(scores, method, expected, group_rows):
    got = rank_by_group(scores, ["g"], "s", "r", method=method, tie=["id"], group_rows=group_rows)
    assert [r.r for r in got.orderBy("id").collect()] == expected


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, half of those with one score."""
    n = F.col("id")
    return spark.range(6000).select(
        F.when(n % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("g"), (n % 50).cast("string"))).alias("g"),
        F.when(n % 2 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(500))).cast("double").alias("s"),
        "id",
    )


@pytest.mark.parametrize("method", ["min", "average", "position"])
@pytest.mark.parametrize("ascending", [False, True])
def test_hot_group_gives_the_same_ranks(skewed, method, ascending):
    args = dict(method=method, tie=["id"], ascending=ascending)
    plain = rank_by_group(skewed, ["g"], "s", "r", **args)
    sliced = rank_by_group(skewed, ["g"], "s", "r", group_rows=0, **args).select(plain.columns)
    assert plain.exceptAll(sliced).count() == 0 and sliced.exceptAll(plain).count() == 0


def test_average_ranks_add_up(skewed):
    ranked = rank_by_group(skewed, ["g"], "s", "r", method="average", group_rows=0)
    for r in ranked.groupBy("g").agg(F.sum("r").alias("t"), F.count("*").alias("n")).collect():
        assert r.t == r.n * (r.n + 1) / 2


def test_running_total(spark):
    df = spark.range(1000).select(F.pmod("id", F.lit(2)).alias("g"), "id")
    got = running_total(df, ["g"], [F.col("id").asc()], F.col("id"), "before", slices=7)
    for r in got.collect():
        assert r.before == sum(range(r.g, r.id, 2))


def test_positions_need_a_tie_breaker(scores):
    with pytest.raises(ValueError):
        rank_by_group(scores, ["g"], "s", "r", method="position")


def test_scaling_edge_groups(spark):
    df = spark.createDataFrame(
        [("c", 5.0), ("c", 5.0), ("one", 3.0), ("n", 1.0), ("n", None), ("n", 3.0)], "g string, x double"
    )
    std = rows(scale_by_group(df, ["x"], group="g"), "g", "x")
    assert std == [("c", 0.0), ("c", 0.0), ("n", None), ("n", -1.0), ("n", 1.0), ("one", 0.0)]
    mm = rows(scale_by_group(df, ["x"], group="g", method="minmax"), "g", "x")
    assert mm == [("c", 0.0), ("c", 0.0), ("n", None), ("n", 0.0), ("n", 1.0), ("one", 0.0)]


def test_scaling_properties(skewed):
    scaled = scale_by_group(skewed, ["s"], group="g")
    for r in scaled.groupBy("g").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).collect():
        assert abs(r.m) < 1e-9 and min(abs(r.d - 1), abs(r.d)) < 1e-9
    bounds = scale_by_group(skewed, ["s"], group="g", method="minmax").agg(F.min("s"), F.max("s")).first()
    assert tuple(bounds) == (0.0, 1.0)


def test_scaling_on_another_table(spark):
    df = spark.createDataFrame([(1.0,), (5.0,)], "x double")
    fit = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    assert rows(scale_by_group(df, ["x"], fit_on=fit), "x") == [(0.0,), (4.0,)]
    with pytest.raises(ValueError):
        scale_by_group(df, ["x"], fit_on=fit, group="x")
    with pytest.raises(ValueError):
        scale_by_group(df, [])


@pytest.mark.parametrize("values, expected", [([0.0, 0.0], [None, None]), ([1.0, 3.0], [0.25, 0.75]), ([-1.0, 1.0], [None, None])])
def test_share(spark, values, expected):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, id int, x double")
    assert [r.p for r in probability(df, ["g"], "x", "p").orderBy("id").collect()] == expected


def test_softmax_and_share_sum_to_one(skewed):
    for mode in ("softmax", "share"):
        got = probability(skewed.withColumn("s", F.col("s") + 800), ["g"], "s", "p", mode=mode)
        for r in got.groupBy("g").agg(F.sum("p").alias("t")).collect():
            assert math.isclose(r.t, 1.0, rel_tol=1e-9)


def test_probability_among_the_best(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 1.0, 2.0), (3, 0.5, 3.0)], "id int, x double, r double")
    got = probability(df, [], "x", "p", rank="r", top_n=2, factor=100.0)
    assert [r.p for r in got.orderBy("id").collect()] == [75.0, 25.0, 0.0]
    with pytest.raises(ValueError):
        probability(df, [], "x", "p", top_n=2)


def test_top_rows(spark):
    df = spark.createDataFrame(
        [("a", "f1", 3.0), ("a", "f2", -5.0), ("a", "f3", 0.0), ("a", "f4", 1.0), ("a", "f5", 2.0)],
        "e string, f string, v double",
    )
    assert [r.f for r in topk.top_by_magnitude(df, 2, "v", "f").collect()] == ["f2", "f1"]
    signed = rows(topk.top_by_sign(df, "e", "v", 2, "f").select("f", "sign", "place"), "sign", "place")
    assert signed == [("f2", -1, 1), ("f1", 1, 1), ("f5", 1, 2)]
    best = topk.best_of_group(df, ["e"], "v", "f", ["f"])
    assert rows(best) == [("a", "f1")]


def test_top_per_group_cuts_before_the_shuffle(skewed, capsys):
    topk.top_per_group(skewed, ["g"], 3, [F.col("s").desc(), F.col("id")]).explain()
    plan = capsys.readouterr().out
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_leaders_of_the_latest_dates(spark):
    df = spark.createDataFrame(
        [("p1", "2024-01-02", 2.0), ("p2", "2024-01-01", 9.0), ("p1", "2024-01-01", 8.0), ("p3", "2024-01-01", 1.0)],
        "player string, date string, prediction double",
    )
    assert rows(topk.entities_of_latest(df, "player", "date", "prediction", 3), "player") == [("p1",), ("p2",)]
