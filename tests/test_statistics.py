"""Correlations against brute force, pruning, selection, encoding, splits."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paneloom.operators import correlation as c
from paneloom.operators.encode import fit_one_hot, one_hot, one_hot_names, sample_values
from paneloom.operators.folds import assign_folds, period_cutoff, period_folds, period_split
from conftest import rows


def brute_signed(x, y, w):
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y) * (w[:, None] * w)
    return s.sum() / 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 4)), max_size=40))
def test_signed_pairs_equals_brute_force(points):
    x, y, w = (np.array([p[i] for p in points], dtype=float) for i in range(3))
    assert c.signed_pairs(x, y, w) == brute_signed(x, y, w)


def tau_b(x, y):
    keep = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[keep], y[keep]
    s = (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum()
    return s / np.sqrt((x[:, None] != x).sum() * (y[:, None] != y).sum())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 900
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 9, n).astype(float)})
    pdf["copy"] = pdf.a
    pdf["near"] = pdf.a + rng.normal(size=n) * 0.05
    pdf["flat"] = 2.0
    # A third and more of the targets share one value, which must not form one big group.
    pdf["y"] = np.where(rng.random(n) < 0.6, 0.0, np.round(pdf.a + pdf.b / 4, 1))
    pdf.loc[rng.random(n) < 0.1, "b"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def table(spark, data):
    df = spark.createDataFrame(data)
    return df.withColumn("b", F.when(~F.isnan("b"), F.col("b"))).cache()


@pytest.mark.parametrize("in_aggregate", [1000, 0])
def test_pairs(table, data, in_aggregate):
    names = ["a", "b", "copy", "near", "flat"]
    got = {(r.col_a, r.col_b): r["corr"] for r in c.pair_correlations(table, names, in_aggregate=in_aggregate).collect()}
    assert len(got) == 10
    for (p, q), value in got.items():
        if "flat" in (p, q):
            assert value is None
        else:
            assert value == pytest.approx(data[p].corr(data[q]), abs=1e-12)
    assert got["a", "copy"] == 1.0


def test_pruning_keeps_exact_copies_unless_asked(table):
    names = ["a", "b", "copy", "near", "flat"]
    assert c.prune_correlated(table, names, 0.95) == ["a", "b", "copy", "flat"]
    assert c.prune_correlated(table, names, 0.95, include_perfect=True) == ["a", "b", "flat"]


def serial_greedy(edges):
    """The later column of the strongest pair goes, again and again."""
    gone = set()
    for _, a, b in sorted((-w, a, b) for a, b, w in edges):
        if a not in gone and b not in gone:
            gone.add(b)
    return gone


@pytest.mark.parametrize("seed, columns, share", [(1, 12, 0.6), (2, 30, 0.2), (3, 30, 1.0), (4, 60, 0.05)])
def test_rounds_equal_the_serial_pass(spark, seed, columns, share):
    rng = np.random.default_rng(seed)
    edges = [
        (a, b, float(rng.integers(950, 999)) / 1000)
        for a in range(columns) for b in range(a + 1, columns) if rng.random() < share
    ]
    got = c.later_of_strongest(spark.createDataFrame(edges, "a int, b int, abs_corr double"))
    assert {r.b for r in got.collect()} == serial_greedy(edges)


def test_rounds_of_stars_chains_and_nothing(spark):
    star = [(0, b, 1 - b / 100) for b in range(1, 40)]
    chain = [(b, b + 1, 0.99 - b / 1000) for b in range(50, 60)]
    got = c.later_of_strongest(spark.createDataFrame(star + chain, "a int, b int, abs_corr double"))
    assert {r.b for r in got.collect()} == serial_greedy(star + chain)
    assert c.later_of_strongest(spark.createDataFrame([], "a int, b int, abs_corr double")).count() == 0


@pytest.mark.parametrize("tile, bytes_, fan_in", [(2, 1, 2), (3, 300, 2), (2, 10**6, 3), (512, 10**6, 8)])
def test_tiles_equal_whole_matrices(spark, tile, bytes_, fan_in):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 7)) @ rng.normal(size=(7, 7))
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcdefg")).assign(h=3.0)
    names = list(pdf.columns)
    df = spark.createDataFrame(pdf).repartition(9)
    df = df.select(*[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
    before, c.ROWS_PER_COLUMN = c.ROWS_PER_COLUMN, 4
    try:
        got = c._pairs_by_moments(df, names, tile=tile, bytes_=bytes_, fan_in=fan_in).collect()
    finally:
        c.ROWS_PER_COLUMN = before
    assert len(got) == 28 and len({(r.col_a, r.col_b) for r in got}) == 28
    for r in got:
        assert names.index(r.col_a) < names.index(r.col_b)
        if "h" in (r.col_a, r.col_b):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(pdf[r.col_a].corr(pdf[r.col_b]), abs=1e-12)


def test_groups_of_tiles_hold_their_bound():
    groups = c.tile_groups(2000, 512, 64 << 20)
    assert sorted(pair for g in groups for pair in g) == [(i, j) for i in range(4) for j in range(i, 4)]
    assert all(len(g) * 8 * 6 * 512 ** 2 <= 64 << 20 and len({i for i, _ in g}) == 1 for g in groups)


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_kendall(table, data, slices):
    got = {r.feature: r.abs_corr for r in c.target_correlations(table, ["a", "b", "near"], "y", "kendall", slices=slices).collect()}
    for name, value in got.items():
        assert value == pytest.approx(abs(tau_b(data[name].to_numpy(), data.y.to_numpy())), abs=1e-12)
    assert set(got) == {"a", "b", "near"}


def test_kendall_cuts_a_large_grid_again(table, data):
    points = c.target_points(table, ["a", "b"], "y")
    for r in c._kendall(points, 16, grid_cells=30).collect():
        assert r["corr"] == pytest.approx(tau_b(data[r.feature].to_numpy(), data.y.to_numpy()), abs=1e-12)


@pytest.mark.parametrize("group_rows", [10**6, 0])
def test_spearman(table, data, group_rows):
    got = {r.feature: r.abs_corr for r in c.target_correlations(table, ["a", "b"], "y", "spearman", group_rows=group_rows).collect()}
    for name, value in got.items():
        both = data[[name, "y"]].dropna()
        assert value == pytest.approx(abs(both[name].rank().corr(both.y.rank())), abs=1e-12)


def test_selection(table):
    found = c.target_correlations(table, ["a", "b", "flat"], "y", "pearson")
    assert set(c.select_features(found, top_n=1)) <= {"a", "b"}
    assert sorted(c.select_features(found, threshold=0.0)) == ["a", "b"]
    with pytest.raises(ValueError):
        c.select_features(found)
    with pytest.raises(ValueError):
        c.select_features(found, threshold=0.1, top_n=2)
    with pytest.raises(ValueError):
        c.target_correlations(table, ["a"], "y", "other")


def test_matrix(table, data):
    corner = c.correlation_matrix(table, ["a", "b", "near"])
    assert rows(corner.select("row", "col"), "row", "col") == [("b", "a"), ("near", "a"), ("near", "b")]
    full = c.correlation_matrix(table, ["a", "b"], corner=False)
    assert full.count() == 4


def test_one_hot(spark):
    train = spark.createDataFrame([("C", True), ("PG", False), (None, True)], "POS string, flag boolean")
    levels = fit_one_hot(train, ["POS", "flag"])
    assert levels == {"POS": ["C", "PG"]} and one_hot_names(levels) == ["POS_C", "POS_PG"]
    assert rows(one_hot(train, levels), "POS_C", "POS_PG") == [(True, 0, 0), (False, 0, 1), (True, 1, 0)]
    later = spark.createDataFrame([("C", True), ("SF", True)], "POS string, flag boolean")
    assert rows(one_hot(later, levels), "POS_C") == [(True, 0, 0), (True, 1, 0)]
    with pytest.raises(ValueError):
        fit_one_hot(train, ["POS"], max_levels=1)


def test_sample_of_values(spark):
    df = spark.range(100).select(F.pmod("id", F.lit(40)).alias("v"))
    got = sample_values(df, "v", 0.25, seed=1)
    assert got.count() == 10 and got.distinct().count() == 10
    assert rows(got, "v") == rows(sample_values(df, "v", 0.25, seed=1), "v")


def test_period_split(spark):
    df = spark.createDataFrame([(y,) for y in range(2000, 2011) for _ in range(2)], "SEASON int")
    train, test = period_split(df, "SEASON", 0.2)
    assert sorted({r[0] for r in test.collect()}) == [2009, 2010] and train.count() == 18
    assert period_cutoff(df, "SEASON", 0.05) is None
    assert [d.count() for d in period_split(df, "SEASON", 0.05)] == [22, 0]


def test_folds(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    folded, names = assign_folds(df, "k", 3, repeats=2, seed=0)
    assert names == ["fold_0", "fold_1"]
    for name in names:
        assert sorted(r["count"] for r in folded.groupBy(name).count().collect()) == [33, 33, 34]
    assert folded.where("fold_0 <> fold_1").count() > 0
    periods = period_folds(df.withColumn("s", F.pmod("k", F.lit(7))), "s", 3)
    assert periods.groupBy("s").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
