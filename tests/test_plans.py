"""Physical plans: what is shuffled, what is pushed down, what stays in the JVM."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import spread
from paneloom.operators.filters import group_threshold
from paneloom.operators.folds import period_split
from paneloom.operators.mlp import MLPModel
from paneloom.operators.probability import probability
from paneloom.operators.ranks import rank_by_group
from paneloom.operators.scale import scale_by_group


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise((F.col("id") % 20).cast("int")).alias("SEASON"),
        F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x"), "id",
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_group_statistics_do_not_shuffle_the_rows(stored, capsys):
    for df in (
        scale_by_group(stored, ["x"], group="SEASON"),
        probability(stored, ["SEASON"], "x", "p", mode="softmax"),
        group_threshold(stored, "SEASON", "x", 0.5),
    ):
        text = plan(df, capsys)
        assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_too_large_a_summary_is_not_broadcast(stored, capsys, monkeypatch):
    small = scale_by_group(stored, ["x"], group="SEASON")
    ranks = rank_by_group(stored, ["SEASON"], "x", "r", method="average", group_rows=0)
    # The planner must not broadcast on its own either: it knows no small size here.
    stored.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(spread, "BROADCAST_CELLS", 0)
    try:
        large = scale_by_group(stored, ["x"], group="SEASON")
        assert "BroadcastHashJoin" not in plan(large, capsys)
        assert large.exceptAll(small).count() == 0 and small.exceptAll(large).count() == 0
        again = rank_by_group(stored, ["SEASON"], "x", "r", method="average", group_rows=0)
        assert again.exceptAll(ranks).count() == 0 and again.count() == stored.count()
    finally:
        stored.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_period_split_reaches_the_scan(stored, capsys):
    train, test = period_split(stored, "SEASON", 0.2)
    assert "LessThan(SEASON" in plan(train, capsys)
    assert "GreaterThanOrEqual(SEASON" in plan(test, capsys)


def test_unused_columns_are_not_read(stored, capsys):
    text = plan(scale_by_group(stored, ["x"], group="SEASON").select("x"), capsys)
    assert "ReadSchema: struct<SEASON:int,x:double>" in text


def test_scoring_stays_in_the_jvm(stored, capsys):
    model = MLPModel(["x"], 2, np.ones((1, 1 * 2 + 2 + 2 + 1)), [(None, None)])
    assert "Python" not in plan(model.transform(stored), capsys)


def test_staged_tables_are_columnar_and_go_with_their_scope(spark, tmp_path):
    """A scope's folder holds the panel as Parquet while it is open; reads take the columns they name."""
    import os

    from paneloom import scratch
    from paneloom.plans import orders_panel as op

    with scratch(spark) as folder:
        table = op.panel_bronze(spark, "/root/testdata/sf0.001")
        few = table.where("SEASON = 1997").select("PLAYER", "MP")
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "PTS_per_game" not in plan and "PushedFilters: [IsNotNull(SEASON)" in plan
        assert few.count() > 0 and os.listdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))


def test_scopes_nest_and_end_with_errors(spark):
    import os

    import pytest

    from paneloom import scratch, shared_folder

    with scratch(spark) as outer:
        with pytest.raises(ValueError), scratch(spark) as inner:
            spark.range(3).write.parquet(shared_folder(spark, "x"))
            assert inner.startswith(outer) and os.listdir(inner.removeprefix("file:"))
            raise ValueError
        assert not os.path.exists(inner.removeprefix("file:"))
    assert not os.path.exists(outer.removeprefix("file:"))
    assert not shared_folder(spark, "x").startswith(outer)


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_outer_concat_shuffles_once(spark):
    """However many tables are joined side by side, there is one exchange, on the key."""
    from paneloom.operators.joins import outer_concat

    tables = [spark.range(20).selectExpr(f"id + {i} AS k", f"id AS x{i}", f"id * {i} AS shared") for i in range(5)]
    joined = outer_concat(tables, "k")
    plan = _physical(joined)
    assert plan.count("Exchange hashpartitioning(k") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    assert joined.columns == ["k", "x0", "shared", "x1", "x2", "x3", "x4"] and joined.count() == 24
    lone = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "k int, a int")
    both = outer_concat([lone, lone.withColumnRenamed("a", "b")], "k").collect()
    assert sorted(map(tuple, both), key=str) == sorted(
        [(None, 1, None), (None, 2, None), (None, None, 1), (None, None, 2), (5, 3, 3)], key=str
    )


def test_folds_are_numbered_without_a_window_over_everything(spark):
    import math

    from paneloom.operators.folds import assign_folds

    folded, names = assign_folds(spark.range(1000), "id", 3, repeats=2)
    assert "SinglePartition" not in _physical(folded)
    for name in names:
        sizes = [r["count"] for r in folded.groupBy(name).count().collect()]
        assert sorted(sizes) == [math.floor(1000 / 3)] * 2 + [334]
    again, _ = assign_folds(spark.range(1000).repartition(7), "id", 3, repeats=2)
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, again.collect()))
