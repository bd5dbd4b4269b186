"""Network, held-out evaluation and attributions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import impacts, mlp
from paneloom.operators.outcomes import held_out_line, hit_rate, period_outcomes, predict_held_out_line
from paneloom.operators.shapley import linear_shapley, linear_shapley_long, shapley
from paneloom.plans.stages import cross_validate, hold_out_periods
from conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = np.maximum(x[:, 0] - 0.5 * x[:, 1], 0) + 0.1 * x[:, 2]
    records = [(f"k{i:03d}", 2000 + i % 4, *map(float, x[i]), float(y[i])) for i in range(300)]
    return spark.createDataFrame(records, "k string, SEASON int, a double, b double, c double, y double").cache()


FEATURES = ["a", "b", "c"]


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    weights = rng.normal(size=(2, 3 * 4 + 4 + 4 + 1))
    used = rng.integers(0, 2, (2, 20)).astype(float)
    _, grad = mlp._gradients(x, y, used, weights, 4)
    for at in (0, 5, 13, 17, 20):
        step = np.zeros_like(weights)
        step[:, at] = 1e-6
        up, down = (mlp._gradients(x, y, used, weights + s, 4)[0] for s in (step, -step))
        assert grad[:, at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_fit_learns_and_scores_the_same_in_the_jvm(spark, data, tmp_path):
    model = mlp.MLPRegressor(max_iter=60).fit(data, FEATURES, "y")
    scored = model.transform(data, "p").collect()
    truth = np.array([r.y for r in scored])
    pred = np.array([r.p for r in scored])
    assert np.mean((truth - pred) ** 2) < 0.25 * np.var(truth)
    x = np.array([[r.a, r.b, r.c] for r in scored])
    assert pred == pytest.approx(model.predict_array(x), abs=1e-9)
    model.save(spark, str(tmp_path / "m"))
    again = mlp.MLPModel.load(spark, str(tmp_path / "m"))
    assert again.features == FEATURES and np.array_equal(again.weights, model.weights)


def test_held_out_fits_equal_separate_fits(data):
    regressor = mlp.MLPRegressor(max_iter=8)
    together = regressor.fit(data, FEATURES, "y", fold_cols=["SEASON"])
    for k, (_, season) in enumerate(together.held_out):
        alone = regressor.fit(data.where(F.col("SEASON") != season), FEATURES, "y")
        assert together.weights[k] == pytest.approx(alone.weights[0], abs=1e-9)
    scored = hold_out_periods(data, FEATURES, regressor, target="y")
    one = scored.where("SEASON = 2002").first()
    at = [v for _, v in together.held_out].index(2002)
    assert one.PRED == pytest.approx(mlp._forward(np.array([[one.a, one.b, one.c]]), together.weights[at], 8)[0])


def test_wide_sums_take_two_levels(data):
    many = data.repartition(40, "k")
    a = mlp.MLPRegressor(max_iter=3).fit(many, FEATURES, "y")
    b = mlp.MLPRegressor(max_iter=3).fit(data, FEATURES, "y")
    assert a.weights == pytest.approx(b.weights, abs=1e-9)


def test_nulls_are_refused(data):
    with pytest.raises(Exception, match="must not be null"):
        mlp.MLPRegressor(max_iter=1).fit(data.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), FEATURES, "y")


def test_cross_validation(data):
    means, tested = cross_validate(data, FEATURES, mlp.MLPRegressor(max_iter=5), target="y", key="k", test=data)
    assert [r[0] for r in rows(means, "part")] == ["training", "validation"]
    assert all(v >= 0 for r in rows(means) for v in r[1:])
    assert tested.count() == 1


def test_held_out_line(data):
    lines = {r.SEASON: (r.slope, r.intercept) for r in held_out_line(data, "SEASON", "a", "y").collect()}
    everything = data.toPandas()
    for season, (slope, intercept) in lines.items():
        rest = everything[everything.SEASON != season]
        expected = np.polyfit(rest.a, rest.y, 1)
        assert (slope, intercept) == pytest.approx(tuple(expected), abs=1e-9)
    assert predict_held_out_line(data, "SEASON", "a", "y").where("PRED IS NULL").count() == 0


def test_outcomes(spark):
    df = spark.createDataFrame(
        [
            (2000, "k1", "A", 0.9, 0.8), (2000, "k2", "B", 0.1, 0.7), (2000, "k3", "C", 0.0, 0.1),
            (2001, "k4", "A", 0.6, 0.2), (2001, "k5", "B", 0.4, 0.3), (2001, "k6", "C", 0.0, 0.9),
        ],
        "SEASON int, k string, PLAYER string, t double, p double",
    )
    got = period_outcomes(df, "SEASON", "k", "t", "p", label="PLAYER")
    shown = rows(got.select("SEASON", "`Pred. MVP`", "`True MVP`", "REAL_RANK", "PRED_RANK"), "SEASON")
    assert shown == [(2000, "A", "A", 1, 1), (2001, "C", "A", 3, 3)]
    assert period_outcomes(df, "SEASON", "k", "t", "p", cap=2).agg(F.max("REAL_RANK")).first()[0] == 2
    assert rows(hit_rate(got, "SEASON")) == [(2, 2000, 2001, 50, 2.0, 2.0)]
    assert rows(hit_rate(got, "SEASON", last=1)) == [(1, 2001, 2001, 0, 3.0, 3.0)]


def test_linear_attribution(spark):
    background = spark.createDataFrame([("b1", 0.0, 0.0), ("b2", 2.0, 4.0)], "k string, u double, v double")
    row = spark.createDataFrame([("r", 5.0, 1.0)], "k string, u double, v double")
    exact = {r.feature: r.phi for r in linear_shapley(row, "k", {"u": 1.0, "v": -2.0}, background).collect()}
    assert exact == {"u": 4.0, "v": 2.0}
    w = np.array([1.0, -2.0])
    sampled = {r.feature: r.phi for r in shapley(row, background, "k", ["u", "v"], lambda x: x @ w).collect()}
    assert sampled == pytest.approx(exact)
    long = impacts.to_long(background, "k", ["u", "v"], "value")
    weights = spark.createDataFrame([("u", 1.0), ("v", -2.0)], "feature string, weight double")
    assert linear_shapley_long(long, weights).agg(F.sum("phi")).first()[0] == pytest.approx(0.0)


def test_attributions_add_up(data):
    model = mlp.MLPRegressor(max_iter=20).fit(data, FEATURES, "y")
    sample = data.orderBy("k").limit(5)
    phi = shapley(sample, data, "k", FEATURES, model.predict_array, permutations=3, rows_per_pass=2)
    mean = model.transform(data, "p").agg(F.avg("p")).first()[0]
    sums = {r.k: r.s for r in phi.groupBy("k").agg(F.sum("phi").alias("s")).collect()}
    assert len(sums) == 5
    for r in model.transform(sample, "p").collect():
        assert sums[r.k] == pytest.approx(r.p - mean, abs=1e-9)
    spread = shapley(sample, data.repartition(7), "k", FEATURES, model.predict_array, permutations=3)
    moved = phi.join(spread.withColumnRenamed("phi", "other"), ["k", "feature"])
    assert moved.where(F.abs(F.col("phi") - F.col("other")) > 1e-9).count() == 0


def by_all_orders(predict, x, background):
    """Shapley values over all p! orders."""
    p, phi = len(x), np.zeros(len(x))
    orders = list(itertools.permutations(range(p)))
    for order in orders:
        mixed, before = background.copy(), predict(background).mean()
        for j in order:
            mixed[:, j] = x[j]
            after = predict(mixed).mean()
            phi[j] += after - before
            before = after
    return phi / len(orders)


def test_errors_cover_all_orders(spark):
    """Five features, a model with interactions: the stated errors hold against all 120 orders, and shrink on demand."""
    def product(x):
        return x[:, 0] * x[:, 1] * x[:, 2] + np.maximum(x[:, 3] - x[:, 4], 0.0)

    names = list("abcde")
    values = np.random.default_rng(4).normal(size=(46, 5))
    data = spark.createDataFrame([(f"r{i}", *map(float, v)) for i, v in enumerate(values)], "k string, " + ", ".join(f"{n} double" for n in names))
    sample = data.where("k IN ('r0', 'r1', 'r2', 'r3', 'r4', 'r5')")
    exact = {f"r{i}": by_all_orders(product, values[i], values) for i in range(6)}

    def misses(found):
        """Per row the largest gap to the exact values and the largest stated error."""
        worst = {}
        for r in found:
            gap, error = worst.get(r.k, (0.0, 0.0))
            worst[r.k] = max(gap, abs(r.phi - exact[r.k][names.index(r.feature)])), max(error, r.error)
        return zip(*worst.values())

    gap, error = misses(shapley(sample, data, "k", names, product, permutations=16).collect())
    assert max(error) > 0.02 and all(g <= 5 * e for g, e in zip(gap, error))
    gap, error = misses(shapley(sample, data, "k", names, product, permutations=8, tolerance=0.05).collect())
    assert len(gap) == 6 and max(error) <= 0.05 and max(gap) < 0.25


def test_a_linear_model_stops_at_once(spark):
    """Every order of a linear model gives the same attribution: no error, one round, however low the tolerance."""
    calls = []

    def linear(x):
        calls.append(1)
        return x @ np.array([2.0, -1.0])

    data = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "k string, u double, v double")
    found = shapley(data, data, "k", ["u", "v"], linear, permutations=2, tolerance=1e-12)
    assert {(r.k, r.feature): (r.phi, r.error) for r in found.collect()} == {
        ("a", "u"): (-2.0, 0.0), ("a", "v"): (1.0, 0.0), ("b", "u"): (2.0, 0.0), ("b", "v"): (-1.0, 0.0),
    }
    alone = shapley(data, data, "k", ["u", "v"], linear, permutations=1)
    assert {r.error for r in alone.collect()} == {None}


def test_many_periods_share_passes_within_a_bound(spark, monkeypatch):
    """A thousand weight sets: one number per row and groups of sets, with the weights of any other grouping."""
    groups = mlp.set_groups(np.arange(1000), mlp.BLOCK_ROWS, mlp.HIDDEN)
    assert np.concatenate(groups).tolist() == list(range(1000))
    assert all(len(g) * mlp.BLOCK_ROWS * mlp.HIDDEN * 24 <= mlp.LAYER_BYTES for g in groups)
    rng = np.random.default_rng(1)
    values = rng.normal(size=(2000, 2))
    data = spark.createDataFrame([(i % 1000, *map(float, v), float(v[0])) for i, v in enumerate(values)], "s int, a double, b double, y double")
    regressor = mlp.MLPRegressor(hidden=2, max_iter=2)
    together = regressor.fit(data, ["a", "b"], "y", fold_cols=["s"])
    assert together.weights.shape[0] == 1000
    for k in (0, 123, 999):
        alone = regressor.fit(data.where(F.col("s") != k), ["a", "b"], "y")
        assert together.weights[k] == pytest.approx(alone.weights[0], abs=1e-9)


def test_impact_tables(spark):
    long = spark.createDataFrame(
        [("a", "f", 1.0), ("a", "g", -2.0), ("b", "f", 3.0), ("b", "g", 0.0)], "k string, feature string, phi double"
    )
    assert rows(impacts.to_wide(long, "k", ["f", "g"]), "k") == [("a", 1.0, -2.0), ("b", 3.0, 0.0)]
    back = impacts.to_long(impacts.to_wide(long, "k", ["f", "g"]), "k", ["f", "g"])
    assert rows(back, "k", "feature") == rows(long, "k", "feature")
    assert rows(impacts.global_importance(long, 1)) == [("f", 2.0)]
    assert rows(impacts.peer_delta(long, "k", "b", 2)) == [("f", 2.0, 2.0), ("g", 2.0, 2.0)]
    assert impacts.peer_delta(long.where("k = 'a'"), "k", "a", 2).count() == 0
    assert impacts.local_top(long, "k", 3).count() == 3
