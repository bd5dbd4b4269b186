"""A regressor with one hidden layer, trained by Spark jobs; several held-out fits run as one.

Each iteration is one job: every task adds up loss and gradients over its blocks of rows for all weight sets at
once, the partial sums are added in Spark, and the driver applies the optimiser step to the few weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Size of the hidden layer, step size, seed and the usual defaults of the optimiser.
HIDDEN = 8
LEARNING_RATE = 0.065
SEED = 0
L2 = 1e-4
MAX_ITER = 200
TOLERANCE = 1e-4
PATIENCE = 10
BETAS = (0.9, 0.999)
EPSILON = 1e-8

#: Rows per block, and partial sums fetched by the driver per iteration.
BLOCK_ROWS = 8192
FAN_IN = 32

#: Bytes of the hidden layer's arrays that a task holds at once; weight sets are run in groups that fit.
LAYER_BYTES = 64 << 20


def _split(flat: np.ndarray, p: int, h: int):
    """Views of flat weight vectors (…, D) as (W, b, v, c)."""
    w = flat[..., : p * h].reshape(*flat.shape[:-1], p, h)
    b = flat[..., p * h : p * h + h]
    v = flat[..., p * h + h : p * h + 2 * h]
    c = flat[..., -1]
    return w, b, v, c


def _forward(x: np.ndarray, flat: np.ndarray, h: int) -> np.ndarray:
    """Outputs of one weight set for the rows of ``x``."""
    w, b, v, c = _split(flat, x.shape[1], h)
    return np.maximum(x @ w + b, 0.0) @ v + c


def _gradients(x, y, used, weights, h):
    """Sums of loss and gradient over the rows of a block; ``used`` is a (sets, rows) 0/1 mask."""
    p = x.shape[1]
    w, b, v, c = _split(weights, p, h)
    z = np.matmul(x, w) + b[:, None, :]
    a = np.maximum(z, 0.0)
    error = (np.einsum("kmh,kh->km", a, v) + c[:, None] - y) * used
    da = error[:, :, None] * v[:, None, :] * (z > 0)
    grad = np.concatenate(
        [
            np.matmul(x.T, da).reshape(len(weights), -1),
            da.sum(axis=1),
            np.einsum("kmh,km->kh", a, error),
            error.sum(axis=1)[:, None],
        ],
        axis=1,
    )
    return 0.5 * (error * error).sum(axis=1), grad


@dataclass
class MLPModel:
    """Weight sets of fitted networks: one per held-out fold, or a single one."""

    features: list[str]
    hidden: int
    weights: np.ndarray
    #: (fold column, fold value) held out by each weight set; (None, None) for a fit on everything.
    held_out: list[tuple[str | None, object]]

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the first weight set for a rows x features array."""
        return _forward(np.asarray(x, dtype=float), self.weights[0], self.hidden)

    def predict_column(self) -> Column:
        """The first weight set as a built-in expression, so scoring stays in generated code."""
        w, b, v, c = _split(self.weights[0], len(self.features), self.hidden)
        x = [F.col(f"`{f}`").cast("double") for f in self.features]
        output = F.lit(float(c))
        for j in range(self.hidden):
            z = reduce(lambda s, t: s + t, [x[i] * F.lit(float(w[i, j])) for i in range(len(x))])
            z = z + F.lit(float(b[j]))
            output = output + F.when(z > 0, z * F.lit(float(v[j]))).otherwise(F.lit(0.0))
        return output

    def transform(self, df: DataFrame, out: str = "PRED") -> DataFrame:
        """Add the prediction of the first weight set; features must not be null."""
        return df.withColumn(out, self.predict_column())

    def transform_held_out(self, df: DataFrame, fold: str, out: str = "PRED") -> DataFrame:
        """Add to each row the prediction of the weight set that never saw the row's fold."""
        sets = {str(v): k for k, (f, v) in enumerate(self.held_out) if f == fold}
        weights, hidden = self.weights, self.hidden

        @F.pandas_udf("double")
        def predict(label: pd.Series, x: pd.Series) -> pd.Series:
            rows = np.array(x.tolist(), dtype=float).reshape(len(x), -1)
            found = np.full(len(rows), np.nan)
            for value, at in label.groupby(label, sort=False).indices.items():
                found[at] = _forward(rows[at], weights[sets[value]], hidden)
            return pd.Series(found)

        x = F.array(*[F.col(f"`{f}`").cast("double") for f in self.features])
        return df.withColumn(out, predict(F.col(f"`{fold}`").cast("string"), x))

    def transform_all(self, df: DataFrame, out: str) -> DataFrame:
        """Add the predictions of all weight sets as an array."""
        weights, hidden = self.weights, self.hidden

        @F.pandas_udf("array<double>")
        def predict(x: pd.Series) -> pd.Series:
            rows = np.array(x.tolist(), dtype=float).reshape(len(x), -1)
            return pd.Series(list(np.stack([_forward(rows, w, hidden) for w in weights], axis=1)))

        return df.withColumn(out, predict(F.array(*[F.col(f"`{f}`").cast("double") for f in self.features])))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the weights as a small Parquet table."""
        rows = [
            (k, f, None if v is None else str(v), self.features, self.hidden, self.weights[k].tolist())
            for k, (f, v) in enumerate(self.held_out)
        ]
        spark.createDataFrame(
            rows,
            "set int, fold string, value string, features array<string>, hidden int, weights array<double>",
        ).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MLPModel:
        """Read what :meth:`save` wrote."""
        rows = spark.read.parquet(path).orderBy("set").collect()
        return cls(
            list(rows[0].features),
            rows[0].hidden,
            np.array([r.weights for r in rows]),
            [(r.fold, r.value) for r in rows],
        )


class MLPRegressor:
    """Rectified hidden layer, squared loss with an L2 term, Adam steps on the whole data."""

    def __init__(
        self,
        hidden: int = HIDDEN,
        learning_rate: float = LEARNING_RATE,
        seed: int = SEED,
        *,
        l2: float = L2,
        max_iter: int = MAX_ITER,
        tolerance: float = TOLERANCE,
        patience: int = PATIENCE,
    ):
        self.hidden = hidden
        self.learning_rate = learning_rate
        self.seed = seed
        self.l2 = l2
        self.max_iter = max_iter
        self.tolerance = tolerance
        self.patience = patience

    def fit(self, df: DataFrame, features: Sequence[str], target: str, fold_cols: Sequence[str] = ()) -> MLPModel:
        """Fit on all rows, or once per value of each fold column with that fold left out."""
        features, p, h = list(features), len(features), self.hidden
        held_out: list[tuple[str | None, object]] = [(None, None)]
        if fold_cols:
            held_out = [
                (f, v) for f in fold_cols for v in sorted(r[0] for r in df.select(f).distinct().collect())
            ]
        blocks = _blocks(df, features, target, fold_cols, held_out)
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            wide = blocks.rdd.getNumPartitions() > FAN_IN
            return MLPModel(features, h, self._descend(blocks, p, held_out, wide), held_out)
        finally:
            blocks.unpersist()

    def start(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """The weights before the first step, for ``p`` features, and which of them the L2 term penalises."""
        h = self.hidden
        rng = np.random.default_rng(self.seed)
        bounds = np.sqrt(6.0 / (p + h)), np.sqrt(6.0 / (h + 1))
        start = np.concatenate(
            [rng.uniform(-bounds[0], bounds[0], p * h + h), rng.uniform(-bounds[1], bounds[1], h + 1)]
        )
        penalised = np.zeros(len(start))
        penalised[: p * h] = 1.0
        penalised[p * h + h : p * h + 2 * h] = 1.0
        return start, penalised

    def _descend(self, blocks: DataFrame, p: int, held_out: list, wide: bool) -> np.ndarray:
        h, sets = self.hidden, len(held_out)
        start, penalised = self.start(p)
        weights = np.tile(start, (sets, 1))
        first, second = np.zeros_like(weights), np.zeros_like(weights)
        best, stale = np.full(sets, np.inf), np.zeros(sets, dtype=int)
        active = np.ones(sets, dtype=bool)

        for step in range(1, self.max_iter + 1):
            loss, grad, n = _summed(blocks, weights, p, h, wide, _left_out(held_out), active)
            n = np.maximum(n, 1.0)
            loss = loss / n + 0.5 * self.l2 * ((weights * penalised) ** 2).sum(axis=1) / n
            grad = (grad + self.l2 * weights * penalised) / n[:, None]
            stale = np.where(loss > best - self.tolerance, stale + 1, 0)
            best = np.minimum(best, loss)
            active &= stale <= self.patience
            if not active.any():
                break
            first = BETAS[0] * first + (1 - BETAS[0]) * grad
            second = BETAS[1] * second + (1 - BETAS[1]) * grad * grad
            rate = self.learning_rate * np.sqrt(1 - BETAS[1] ** step) / (1 - BETAS[0] ** step)
            weights = np.where(
                active[:, None], weights - rate * first / (np.sqrt(second) + EPSILON), weights
            )
        return weights


def _left_out(held_out: list[tuple[str | None, object]]) -> np.ndarray:
    """Per weight set the fold column and the value's number that it leaves out, or -1 and -1 for none."""
    columns = list(dict.fromkeys(f for f, _ in held_out if f is not None))
    seen = dict.fromkeys(columns, 0)
    out = []
    for f, _ in held_out:
        out.append((-1, -1) if f is None else (columns.index(f), seen[f]))
        if f is not None:
            seen[f] += 1
    return np.array(out, dtype=np.int64)


def set_groups(sets: np.ndarray, rows: int, hidden: int, bytes_: int = LAYER_BYTES) -> list[np.ndarray]:
    """The weight sets in groups whose hidden layers over ``rows`` rows (three arrays) fit in ``bytes_``."""
    fit = max(1, bytes_ // (3 * 8 * max(rows, 1) * hidden))
    return [sets[i:i + fit] for i in range(0, len(sets), fit)]


def _blocks(df, features, target, fold_cols, held_out) -> DataFrame:
    """Rows packed as numeric blocks: features, target and, per fold column, the number of the row's value.

    A row stores one number per fold column, however many weight sets leave something out. A row without a value
    (number -1) is used by all sets.
    """
    p, folds = len(features), list(fold_cols)
    numbers: dict[str, dict] = {f: {} for f in folds}
    for f, v in held_out:
        if f is not None:
            numbers[f][v] = len(numbers[f])
    values = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    names = [f"f{i}" for i in range(len(folds))]
    narrow = df.select(
        values.alias("x"), F.col(f"`{target}`").cast("double").alias("y"),
        *[F.col(f"`{f}`").alias(n) for f, n in zip(folds, names)],
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[at : at + BLOCK_ROWS]
                x = np.array(part["x"].tolist(), dtype=float).reshape(len(part), p)
                y = part["y"].to_numpy(dtype=float)
                if np.isnan(x).any() or np.isnan(y).any():
                    raise ValueError("features and target must not be null when fitting")
                codes = [[numbers[f].get(v, -1) for v in part[n].tolist()] for f, n in zip(folds, names)]
                u = np.array(codes, dtype=np.int32).reshape(len(folds), len(part))
                yield pd.DataFrame({"x": [x.tobytes()], "y": [y.tobytes()], "u": [u.tobytes()]})

    return narrow.mapInPandas(pack, "x binary, y binary, u binary")


def _summed(
    blocks: DataFrame, weights: np.ndarray, p: int, h: int, wide: bool, left_out: np.ndarray, active: np.ndarray
):
    """Loss, gradient and row count per active weight set over all blocks."""
    sets, d = weights.shape
    running = np.flatnonzero(active)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((sets, d + 2))
        for batch in batches:
            for x, y, u in zip(batch["x"], batch["y"], batch["u"]):
                rows = np.frombuffer(y)
                codes = np.frombuffer(u, dtype=np.int32).reshape(-1, len(rows))
                for group in set_groups(running, len(rows), h):
                    column, value = left_out[group].T
                    used = np.ones((len(group), len(rows)))
                    some = column >= 0
                    used[some] = codes[column[some]] != value[some, None]
                    loss, grad = _gradients(np.frombuffer(x).reshape(len(rows), p), rows, used, weights[group], h)
                    total[group, 0] += loss
                    total[group, 1] += used.sum(axis=1)
                    total[group, 2:] += grad
        yield pd.DataFrame({"part": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((sets, d + 2))
        for batch in batches:
            for part in batch["part"]:
                total += np.frombuffer(part).reshape(total.shape)
        yield pd.DataFrame({"part": [total.tobytes()]})

    parts = blocks.mapInPandas(partial, "part binary")
    if wide:
        # Two levels: the driver never fetches more than FAN_IN partial sums.
        parts = parts.repartition(FAN_IN).mapInPandas(add, "part binary")
    total = sum(np.frombuffer(r.part).reshape(sets, d + 2) for r in parts.collect())
    return total[:, 0], total[:, 2:], total[:, 1]
