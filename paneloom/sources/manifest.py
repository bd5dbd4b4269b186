"""The feature manifest: lists of categorical, numerical and model columns as one JSON row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from paneloom.schema import FEATURES


@dataclass(frozen=True)
class Features:
    """Column lists that training hands to scoring."""

    cat: list[str]
    num: list[str]
    model: list[str]


def write_features(spark: SparkSession, features: Features, path: str) -> None:
    """Write the lists as one JSON row."""
    row = [(features.cat, features.num, features.model)]
    spark.createDataFrame(row, FEATURES).coalesce(1).write.mode("overwrite").json(path)


def read_features_table(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as a one-row table."""
    return spark.read.schema(FEATURES).json(path, multiLine=True)


def read_features(spark: SparkSession, path: str) -> Features:
    """The manifest as lists."""
    return Features(**read_features_table(spark, path).first().asDict())
