import pytest
from pyspark.sql import functions as F

from paneloom.functions import dates, maths, text
from conftest import rows


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_names_and_keys(spark):
    got = one(
        spark,
        text.clean_name(F.lit("Luka D. O'Neal*_x")),
        text.letters_only(F.lit("Philadelphia 76ers")),
        text.entity_key(F.lit("A B"), F.lit(2001), F.lit("BOS")),
        text.entity_key(F.lit("A B"), F.lit(None).cast("int"), F.lit("BOS")),
    )
    assert got == ("LukaDONealx", "PHILADELPHIAERS", "AB_2001_BOS", None)


@pytest.mark.parametrize("given, expected", [("1T", 1), ("2", 2), ("T-14", 14)])
def test_place(spark, given, expected):
    assert one(spark, text.place(F.lit(given))) == (expected,)


def test_place_without_digits_is_an_error(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("T",)], "r string").select(text.place(F.col("r"))).collect()


def test_labels(spark):
    got = one(
        spark,
        text.conference_label(F.lit("Western Conference")),
        text.conference_label(F.lit("East")),
        text.feature_label(F.lit("WS/48_advanced")),
        text.feature_label(F.lit("FG_per_game")),
        text.dash_as_zero(F.lit("—")),
        text.dash_as_zero(F.lit("3.5")),
    )
    assert got == ("WESTERN_CONF", "EASTERN_CONF", "WS/48", "FG per game", 0.0, 3.5)
    assert text.feature_label_text("PER_advanced") == "PER"


def test_percent_text(spark):
    assert one(spark, text.percent_text(F.lit(1234.567))) == ("1,234.57%",)
    assert one(spark, text.percent_value(F.lit("1,234.57%"))) == (1234.57,)


def test_season_rolls_over_after_september(spark):
    df = spark.createDataFrame([("2023-09-30",), ("2023-10-01",)], "d string").select(F.to_date("d").alias("d"))
    assert rows(df.select(dates.season_of(F.col("d")).alias("s")), "s") == [(2023,), (2024,)]
    assert str(one(spark, dates.history_date(F.lit("05-11-2024")))[0]) == "2024-11-05"


def test_maths(spark):
    got = one(
        spark, maths.log_transform(F.lit(0.0)), maths.exp_transform(F.lit(0.0)),
        maths.clamp_at_zero(F.lit(-1.0)), maths.clamp_at_zero(F.lit(None).cast("double")),
        maths.nan_to_null(F.lit(float("nan"))),
    )
    assert got == (0.0, 1.0, 0.0, None, None)
