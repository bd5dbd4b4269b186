"""Cleaning, filters, joins, duplicates, summaries."""

import pytest
from pyspark.sql import functions as F

from paneloom.operators import cleaning, dedupe, filters, joins, summary
from conftest import rows


def test_repeated_headers_go_and_nulls_stay(spark):
    df = spark.createDataFrame([("Player",), ("A",), (None,)], "Player string")
    assert rows(filters.drop_header_repeats(df, "Player", "Player"), "Player") == [(None,), ("A",)]


def test_column_tools(spark):
    df = spark.createDataFrame([("a", 1, None, None)], "name string, `3P%` int, `3PA` double, e string")
    assert cleaning.upper_columns(df).columns == ["NAME", "3P%", "3PA", "E"]
    assert cleaning.rename_first(df, "TEAM").columns[0] == "TEAM"
    assert cleaning.suffix_columns(df, "adv", ["name"]).columns == ["name", "3P%_adv", "3PA_adv", "e_adv"]
    assert cleaning.drop_columns(df, ["absent"], containing=["3P"]).columns == ["name", "e"]
    assert cleaning.drop_empty_columns(df).columns == ["name", "3P%"]
    assert cleaning.complete_columns(df, ["name", "3PA"]) == ["name"]
    assert rows(cleaning.fill_by_prefix(df, "3P")) == [("a", 1, 0.0, None)]
    flags = df.withColumn("flag", F.lit(True))
    assert cleaning.numerical_columns(flags) == ["3P%", "3PA"]
    assert cleaning.categorical_columns(flags) == ["name", "e", "flag"]
    assert cleaning.keep_columns(df, ["e", "3P%"]).columns == ["e", "3P%"]


def test_strict_casts_raise(spark):
    df = spark.createDataFrame([("",)], "w string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cleaning.cast_columns(df, {"w": "int"}).collect()


def test_rank_flags(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2T"), ("c", "2T"), ("d", "4")], "p string, RANK string")
    got = rows(cleaning.rank_flags(df, "RANK", "MVP_"), "p")
    assert got == [
        ("a", True, True, True), ("b", False, True, True), ("c", False, True, True), ("d", False, False, True)
    ]


def test_thresholds_and_missing_values(spark):
    df = spark.createDataFrame(
        [("s", 82, 27.9), ("s", 50, 28.0), ("s", 49, 30.0), ("s", 60, None), ("s", 60, float("nan"))],
        "SEASON string, G int, MP double",
    )
    kept = filters.at_least(filters.group_threshold(cleaning.without_nan(df), "SEASON", "G", 0.6), {"MP": 28.0})
    assert rows(kept) == [("s", 50, 28.0)]
    limited = filters.at_most(df, {"G": 50})
    assert sorted(r.G for r in limited.collect()) == [49, 50]


def test_membership(spark):
    df = spark.createDataFrame([("BOS",), ("LAL",)], "TEAM string")
    assert rows(filters.keep_members(df, "TEAM", ["bos", "xxx"], fold="upper")) == [("BOS",)]
    assert filters.keep_members(df, "TEAM", None).count() == 2


def test_marker_split(spark):
    df = spark.createDataFrame([(1, "a"), (2, "Playoffs"), (3, "b"), (4, "Playoffs")], "n int, d string")
    marker = F.col("d") == "Playoffs"
    assert rows(filters.split_at_marker(df, "n", marker)) == [(1, "a")]
    assert [r[0] for r in rows(filters.split_at_marker(df, "n", marker, after=True), "n")] == [3, 4]
    assert [r[0] for r in rows(filters.split_at_marker(df, "n", marker, after=True, inclusive=True), "n")] == [2, 3, 4]
    none = F.col("d") == "absent"
    assert filters.split_at_marker(df, "n", none).count() == 4
    assert filters.split_at_marker(df, "n", none, after=True).count() == 0


def test_previous_period_flag(spark):
    df = spark.createDataFrame(
        [
            ("A", "X", 2000, True), ("A", "X", 2001, False),
            ("B", "X", 2000, True), ("B", "Y", 2001, False),
            ("C", "X", 2000, True), ("C", "X", 2002, False),
        ],
        "p string, t string, s int, won boolean",
    )
    got = joins.previous_period_flag(df, ["p", "t"], "s", F.col("won"), "prev")
    assert [r[:3] for r in rows(got.where("prev"))] == [("A", "X", 2001)]
    loose = joins.previous_period_flag(df, ["p"], "s", F.col("won"), "prev")
    assert sorted(r[:3] for r in rows(loose.where("prev"))) == [("A", "X", 2001), ("B", "Y", 2001)]


def test_outer_concat_keeps_the_first_table(spark):
    first = spark.createDataFrame([("a", 1.0, 9.0), ("b", 2.0, 8.0)], "k string, x double, MP double")
    second = spark.createDataFrame([("b", 5.0, 70.0), ("c", 6.0, 60.0)], "k string, y double, MP double")
    got = joins.outer_concat([first, second], "k").select("k", "x", "y", "MP")
    assert rows(got, "k") == [("a", 1.0, None, 9.0), ("b", 2.0, 5.0, 8.0), ("c", None, 6.0, None)]
    filled = joins.outer_concat([first, second], "k", coalesce=True).select("k", "MP")
    assert rows(filled, "k") == [("a", 9.0), ("b", 8.0), ("c", 60.0)]


def test_unmapped_value_is_named(spark):
    df = spark.createDataFrame([("BOSTON",), ("NOWHERE",)], "TEAM string")
    lookup = spark.createDataFrame([("BOSTON", "BOS")], "raw string, code string")
    assert rows(joins.map_or_raise(df.where("TEAM = 'BOSTON'"), "TEAM", lookup, "raw", "code")) == [("BOS",)]
    with pytest.raises(Exception, match="unmapped value: NOWHERE"):
        joins.map_or_raise(df, "TEAM", lookup, "raw", "code").collect()
    assert rows(joins.unmapped_values(df, "TEAM", lookup, "raw")) == [("NOWHERE",)]


def test_repeated_keys_raise_or_warn(spark):
    left = spark.createDataFrame([("a",)], "k string")
    right = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError, match="1 repeated rows"):
        joins.join_unique(left, right, ["k"])
    assert joins.join_unique(left, right, ["k"], on_duplicate="warn").count() == 2


def test_lookup_and_key_lists(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a", 1)], "id string, v int")
    assert rows(joins.look_up(left, "k", right, "id", "v", "w"), "k") == [("a", 1), ("b", None)]
    keys = right.select(F.col("id").alias("k"))
    assert rows(joins.keep_keys(left, keys, ["k"])) == [("a",)]
    assert rows(joins.drop_keys(left, keys, ["k"])) == [("b",)]


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "k string, ord int, v string")
    assert rows(dedupe.keep_first(df, ["k"], ["ord"]), "k") == [("a", 1, "x"), ("b", 3, "z")]
    assert rows(dedupe.duplicate_keys(df, ["k"])) == [("a", 2)]
    assert dedupe.duplicate_count(df, ["k"]) == 1
    assert rows(dedupe.distinct_values(df, "k"), "k") == [("a",), ("b",)]
    assert dedupe.union_names(["b", "a"], ["a", "c"]) == ["a", "b", "c"]
    wide = dedupe.union_all([df, df.select("k").withColumn("w", F.lit(1))])
    assert wide.columns == ["k", "ord", "v", "w"] and wide.count() == 6


def test_summaries(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5, True), (1, 0.0, 0.5, False), (2, 0.0, 0.1, False)],
                               "s int, t double, p double, w boolean")
    assert rows(summary.conditional_counts(df, {"won": F.col("w")})) == [(3, 1)]
    assert rows(summary.periods_with(df, "s", F.col("w"))) == [(1,)]
    mae, mse, top = rows(summary.error_metrics(df, "t", "p"))[0]
    assert mae == pytest.approx(1.1 / 3) and mse == pytest.approx(0.51 / 3) and top == 0.5
    assert rows(summary.column_range(df, "t")) == [(0.0, 1.0, 3)]
