"""Shapley attribution of predictions to features, against a background population."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.operators.dedupe import union_all
from paneloom.operators.spread import attach, settle

#: Explained rows carried to every task in one pass over the background; more rows mean more passes.
ROWS_PER_PASS = 200


def linear_shapley(df: DataFrame, key: str, weights: dict[str, float], background: DataFrame | None = None) -> DataFrame:
    """``key, feature, phi`` of a linear model: weight times distance from the background mean."""
    population = df if background is None else background
    names = list(weights)
    means = population.agg(*[F.avg(F.col(f"`{c}`").cast("double")) for c in names]).first()
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            ((F.col(f"`{c}`").cast("double") - F.lit(means[i])) * F.lit(float(weights[c]))).alias("phi"),
        )
        for i, c in enumerate(names)
    ]
    return df.select(key, F.inline(F.array(*entries)))


def linear_shapley_long(long: DataFrame, weights: DataFrame, value: str = "value") -> DataFrame:
    """The same on a long table ``key, feature, value`` with a table ``feature, weight``."""
    means = long.groupBy("feature").agg(F.avg(value).alias("_mean"))
    joined = attach(long, means.join(weights, "feature"), ["feature"], "inner")
    phi: Column = F.col("weight") * (F.col(value) - F.col("_mean"))
    return joined.select(*[c for c in long.columns if c != value], phi.alias("phi"))


def _orders(key: str, p: int, first: int, last: int, seed: int) -> list[np.ndarray]:
    """Feature orders number ``first`` to ``last`` of one row, each followed by its reverse; key and seed decide."""
    rng = np.random.default_rng([seed, zlib.crc32(key.encode())])
    orders = [rng.permutation(p) for _ in range(last)][first:]
    return [o for order in orders for o in (order, order[::-1])]


def shapley(
    rows: DataFrame,
    background: DataFrame,
    key: str,
    features: Sequence[str],
    predict: Callable[[np.ndarray], np.ndarray],
    *,
    permutations: int = 10,
    seed: int = 0,
    rows_per_pass: int = ROWS_PER_PASS,
    tolerance: float | None = None,
    most: int = 640,
) -> DataFrame:
    """``key, feature, phi, error`` for every row of ``rows`` by walking random feature orders.

    The whole background streams through the tasks; what travels with them is a bounded set of explained rows.
    For each background row, feature values are switched one by one to the explained row's, and the change of
    the prediction is credited to the feature. Tasks return sums per (row, feature, order). The attributions of a row
    add up to its prediction minus the mean prediction of the background.

    An order and its reverse are one sample of a feature's attribution, taken over the whole background. ``error`` is the
    standard error of ``phi`` over the samples (null for a single one; exactly 0 where all agree). Without ``tolerance``
    every row gets ``permutations`` samples. With it, sampling is sequential: a row whose largest error is within the
    tolerance stops, and only the others get more orders, twice as many in total each time, up to ``most``.
    """
    names = list(features)
    values = [F.col(f"`{c}`").cast("double") for c in names]
    x = rows.select(F.col(f"`{key}`").cast("string").alias("key"), F.array(*values).alias("x"))
    population = background.select(F.array(*values).alias("b"))
    first, last, samples = 0, permutations, []
    while True:
        samples.append(_samples(x, population, names, predict, first, last, seed, rows_per_pass))
        if tolerance is None:
            break
        samples[-1] = settle(samples[-1])
        found = _estimates(union_all(samples))
        if last >= most:
            break
        open_ = found.groupBy("key").agg(F.max(F.coalesce("error", F.lit(float("inf")))).alias("_worst"))
        x = settle(x.join(open_.where(F.col("_worst") > tolerance).select("key"), "key", "left_semi"))
        if x.isEmpty():
            break
        first, last = last, min(2 * last, most)
    estimates = _estimates(union_all(samples))
    return estimates.select(F.col("key").alias(key), "feature", "phi", "error")


def _samples(x, population, names, predict, first, last, seed, rows_per_pass) -> DataFrame:
    """``key, feature, sample, value``: the attribution by each order and its reverse, over the whole background."""
    passes = max(math.ceil(x.count() / rows_per_pass), 1)
    parts = []
    for k in range(passes):
        chunk = x.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k).collect()
        explained = [(r.key, np.array(r.x, dtype=float)) for r in chunk]
        parts.append(
            population.mapInPandas(
                _walker(explained, names, predict, first, last, seed),
                "key string, feature string, sample int, change double, weight double",
            )
        )
    sums = union_all(parts).groupBy("key", "feature", "sample").agg(F.sum("change").alias("s"), F.sum("weight").alias("w"))
    return sums.select("key", "feature", "sample", (F.col("s") / F.col("w")).alias("value"))


def _estimates(samples: DataFrame) -> DataFrame:
    """``key, feature, phi, error``: the mean of the samples and its standard error."""
    equal = F.min("value") == F.max("value")
    error = F.when(equal, 0.0).otherwise(F.stddev_samp("value") / F.sqrt(F.count("value")))
    return samples.groupBy("key", "feature").agg(
        F.avg("value").alias("phi"), F.when(F.count("value") > 1, error).alias("error")
    )


def _walker(explained, names, predict, first, last, seed):
    p = len(names)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        change, weight = np.zeros((len(explained), last - first, p)), 0.0
        orders = [_orders(k, p, first, last, seed) for k, _ in explained]
        for batch in batches:
            base = np.array(batch["b"].tolist(), dtype=float).reshape(len(batch), p)
            start = predict(base)
            weight += len(base) * 2
            for i, (_, x) in enumerate(explained):
                for number, order in enumerate(orders[i]):
                    mixed, before = base.copy(), start
                    for j in order:
                        mixed[:, j] = x[j]
                        after = predict(mixed)
                        change[i, number // 2, j] += float(np.sum(after - before))
                        before = after
        if weight and explained:
            samples = last - first
            yield pd.DataFrame(
                {
                    "key": np.repeat([k for k, _ in explained], p * samples),
                    "feature": np.tile(names, len(explained) * samples),
                    "sample": np.tile(np.repeat(np.arange(first, last), p), len(explained)),
                    "change": change.ravel(),
                    "weight": weight,
                }
            )

    return walk
