"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model: the risk of calling a text bad is estimated from
unlabelled text minus what positives contribute to it, given the share of positives (the class prior), and that part of
the risk is kept from falling below zero (the non-negative unbiased estimator). Where it does, the step goes the other
way, which undoes overfitting to the unlabelled sample. The class prior is the share of positives in the unlabelled text,
estimated from positives and unlabelled rows alone (``estimated_prior``): labels of bad rows are never read, and the
share of good ones among the labelled does not matter. The model is fitted on a bounded sample (``sample_rows`` positives and as many
unlabelled rows, chosen by a hash of id and text, copies once); every row is scored.

Features come from the whole text alone: the share of each byte, of hashed pairs of bytes, and a few statistics of
words and lines.

Null and empty texts have all features 0 and get a score like any other. Rows with a null id are never held out. An id
with several labels counts as good when all are 1. Without any usable positive all scores are 0.5. Repeated rows get
equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import small_batches
from paneloom.operators.spread import attach, settle

#: Rows of either kind in the training sample.
SAMPLE_ROWS = 8_000

PAIRS, STATISTICS = 512, 12
WIDTH = 256 + PAIRS + STATISTICS

#: Bytes whose neighbours are counted at a time, to bound memory on very long texts.
PIECE = 1 << 20


def features(text: bytes) -> np.ndarray:
    """The feature vector of a UTF-8 text."""
    out = np.zeros(WIDTH, dtype=np.float32)
    if not text:
        return out
    data = np.frombuffer(text, dtype=np.uint8)
    single, pairs = np.zeros(256), np.zeros(PAIRS)
    for low in range(0, len(data), PIECE):
        part = data[low:low + PIECE + 1].astype(np.uint32)
        single += np.bincount(part[:PIECE], minlength=256)
        code = (part[:-1] * np.uint32(256) + part[1:]) * np.uint32(2654435761)
        pairs += np.bincount(code >> np.uint32(23), minlength=PAIRS)
    out[:256] = np.sqrt(single / len(data))
    out[256:256 + PAIRS] = np.sqrt(pairs / max(1, len(data) - 1))
    words, lines = text.lower().split(), text.split(b"\n")
    n = max(1, len(words))
    twice = sum(map(operator.eq, words, words[1:]))
    kinds = len(set(words))
    upper, lower = single[65:91].sum(), single[97:123].sum()
    marks = sum(single[ord(c)] for c in "#*$%&|<>!?")
    plain = sum(map(bytes.isalpha, words))
    out[-STATISTICS:] = (
        np.log1p(len(words)) / 10, np.log1p(len(data) / n) / 3, twice / n, min(1.0, 3 * twice / n),
        kinds / n, np.log1p(kinds) / np.log1p(n), upper / max(1.0, upper + lower), min(1.0, marks / n),
        min(1.0, 10 * marks / len(data)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 10, plain / n,
    )
    return out


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    text = F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(text), F.lit(3)) == 1


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.05,
        decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the model with the least non-negative unbiased logistic risk (Adam, all rows each step)."""
    middle, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-2
    p, u = (positive - middle) / scale, (unlabelled - middle) / scale
    w, b = np.zeros(p.shape[1]), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # Of the loss log(1 + e^-z) for good and log(1 + e^z) for bad: risks and slopes in z.
        bad_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        good = prior * (sp - 1) / len(p)
        bad_p, bad_u = -prior * sp / len(p), su / len(u)
        if bad_risk >= 0:
            slope_p, slope_u = good + bad_p, bad_u
        else:
            slope_p, slope_u = -bad_p, -bad_u
        slope = np.append(p.T @ slope_p + u.T @ slope_u + decay * w, slope_p.sum() + slope_u.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w / scale, float(b - middle @ (w / scale))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, *, steps: int = 150, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled rows.

    A classifier of positives against unlabelled rows is fitted on every second row of both. Among the other rows, the
    part of the unlabelled with a score of at least t is at least the share times that part of the positives; so the
    share is at most the ratio of the two, for every t, and close to it where hardly any bad row scores t. The t is
    taken where the ratio's upper confidence bound is least, which keeps away from tails with few rows. One half without
    rows gives 0.5.
    """
    p, u, test_p, test_u = positive[::2], unlabelled[::2], positive[1::2], unlabelled[1::2]
    if not len(test_p) or not len(test_u):
        return 0.5
    # With as much weight for either kind, the risk of the model with a prior of one half and no correction.
    middle, scale = u.mean(axis=0), u.std(axis=0) + 1e-2
    p, u = (p - middle) / scale, (u - middle) / scale
    w, b = np.zeros(p.shape[1]), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        slope_p, slope_u = (1 / (1 + np.exp(-(p @ w + b))) - 1) / len(p), 1 / (1 + np.exp(-(u @ w + b))) / len(u)
        slope = np.append(p.T @ slope_p + u.T @ slope_u + 1e-2 * w, slope_p.sum() + slope_u.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    of_p, of_u = (np.sort(((x - middle) / scale) @ w + b) for x in (test_p, test_u))
    cuts = of_p  # the ratio only falls as a cut moves up to the next positive
    part_p = 1 - np.arange(len(of_p)) / len(of_p)
    part_u = 1 - np.searchsorted(of_u, cuts) / len(of_u)
    slack = sum(np.sqrt(np.log(4 / doubt) / (2 * n)) for n in (len(of_p), len(of_u)))
    at = int(np.argmin((part_u + slack) / part_p))
    return float(min(0.99, max(0.01, part_u[at] / part_p[at])))


def chance(column: Column, salt: int) -> Column:
    """A number in [0, 1) that a hash of the column decides."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def trained(
    docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_id: str, label_col: str, sample_rows: int
) -> tuple[np.ndarray, float] | None:
    """Weights and bias, or nothing when there is no usable positive."""
    usable = settle(
        labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(label_id)))
        .groupBy(F.col(label_id).alias("id")).agg(F.min(label_col).alias("good"))
    )
    good = usable.where("good = 1").select("id", F.lit(True).alias("good"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.where(~held_out(F.col("id"))).withColumns(
        {"key": F.xxhash64(F.col("id").isNull(), "id"), "tie": F.xxhash64("text")}
    )
    # Drawn by id and text, once for all copies: an id with many rows is no larger a part of the sample than of the table.
    keys = settle(attach(rows.select("id", "key", "tie").distinct(), good, ["id"]))
    total, matched = keys.agg(F.count(F.lit(1)), F.count("good")).first()
    one = F.xxhash64("key", "tie")
    picks = keys.select(
        "key", "tie", (F.col("good").isNotNull() & (chance(one, 1) < sample_rows / max(1, matched))).alias("trusted"),
        (chance(one, 2) < sample_rows / max(1, total)).alias("drawn"),
    ).where("trusted OR drawn")
    chosen = attach(rows, picks, ["key", "tie"], "inner").select("id", "text", "trusted", "drawn", "key", "tie")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(vectors, pa.binary())],
                ["id", "trusted", "drawn", "key", "tie", "vector"],
            )

    vectors = chosen.mapInArrow(scan, "id long, trusted boolean, drawn boolean, key long, tie long, vector binary")
    sample = sorted(
        (tuple(r) for r in vectors.dropDuplicates(["key", "tie"]).drop("key", "tie").collect()),
        key=lambda r: (r[0] is None, r[0] or 0, r[3]),
    )
    if not any(r[1] for r in sample):
        return None
    matrix = np.frombuffer(b"".join(r[3] for r in sample), dtype=np.float32).reshape(-1, WIDTH)
    positive = matrix[[r[1] for r in sample]]
    unlabelled = matrix[[r[2] for r in sample]]
    if not len(unlabelled):
        unlabelled = positive
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled))


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
    label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    model = trained(
        docs, labels, id_col=id_col, text_col=text_col, label_id=label_id, label_col=label_col, sample_rows=sample_rows
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            if known is None:
                z = np.zeros(batch.num_rows)
            else:
                z = np.array([features(t.as_py()) @ known[0] + known[1] for t in batch.column(2)])
            scores = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])

    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    scored = rows.mapInArrow(scan, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
