"""Quality model: held-out accuracy, the risk's gradient behaviour, features, edge rows."""

import random
import zlib

import numpy as np
import pytest

from paneloom.llm import quality_model
from paneloom.llm.quality_model import WIDTH, estimated_prior, features, fit, quality_scores

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_scores(docs, labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    assert all(r.predicted == int(r.score >= 0.5) for r in scored)
    judged = [(r.predicted, known[r.doc_id]) for r in scored if r.held_out and r.doc_id in known]
    good = [p for p, q in judged if q == 1]
    bad = [p for p, q in judged if q == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.15


def test_held_out_labels_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = spark.createDataFrame(
        [(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.quality) for r in labels.collect()],
        "doc_id long, quality int",
    )
    assert sorted(quality_scores(docs, labels).collect()) == sorted(quality_scores(docs, turned).collect())


def test_prior_corrects_the_unlabelled_share():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
    unlabelled = np.concatenate([good[2000:], bad[:500]])
    w, b = fit(good[:2000], unlabelled, 0.8)
    assert ((good @ w + b) > 0).mean() > 0.97 and ((bad[500:] @ w + b) > 0).mean() < 0.08


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(1)
    positive = rng.normal(1.5, 1, (3000, 4))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (int(4000 * share), 4)), rng.normal(-1.5, 1, (int(4000 * (1 - share)), 4))])
    assert abs(estimated_prior(positive, rng.permutation(unlabelled)) - share) < 0.06
    assert estimated_prior(positive[:1], unlabelled) == 0.5


def test_labelled_share_does_not_matter(spark, monkeypatch):
    """Nine tenths of the labels are bad, and so is a quarter of the documents: the prior is three quarters."""
    priors = []
    monkeypatch.setattr(quality_model, "fit", lambda good, rest, prior: priors.append(prior) or fit(good, rest, prior))
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcde " if i % 4 else "vwxyz#") for _ in range(300)) for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    good, bad = [i for i in range(3000) if i % 4][:300], [i for i in range(3000) if not i % 4]
    labels = spark.createDataFrame([(i, 1) for i in good] + [(i, 0) for i in bad * 4], "doc_id long, quality int")
    scored = quality_scores(docs, labels).collect()
    assert abs(priors[0] - 0.75) < 0.06
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in scored) > 0.98 * len(scored)


def slope_by_differences(positive, unlabelled, prior, w, b):
    """The derivative of the non-negative risk, by differences, from its definition."""
    def risk(w, b):
        zp, zu = positive @ w + b, unlabelled @ w + b
        return prior * np.log1p(np.exp(-zp)).mean() + np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()

    step, out = 1e-6, []
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i] += step
        down[i] -= step
        out.append((risk(up, b) - risk(down, b)) / (2 * step))
    return np.array(out)


def test_first_step_follows_the_risk():
    """One step of Adam moves each weight against the sign of the risk's derivative, computed by differences."""
    rng = np.random.default_rng(3)
    positive, unlabelled = rng.normal(1, 1, (200, 3)), rng.normal(0, 2, (300, 3))
    w, b = fit(positive, unlabelled, 0.6, steps=1, decay=0.0)
    middle, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-2
    slope = slope_by_differences((positive - middle) / scale, (unlabelled - middle) / scale, 0.6, np.zeros(3), 0.0)
    assert np.array_equal(np.sign(w), -np.sign(slope)) and np.allclose(np.abs(w * scale), 0.05, atol=1e-4)


def test_features_cover_the_whole_text():
    assert features(b"").shape == (WIDTH,) and not features(b"").any()
    long = b"word " * 600_000
    assert not np.array_equal(features(long), features(long + b"#" * 400_000))
    rng = random.Random(1)
    text = bytes(rng.randrange(1, 256) for _ in range(3000))
    assert abs((features(text)[:256] ** 2).sum() - 1) < 1e-4


@pytest.mark.parametrize("labelled", [[], [(1, 0)], [(None, 1), (2, None)]])
def test_edge_rows(spark, labelled):
    rows = [(1, None, "x"), (1, "", "x"), (2, "some text", "y"), (2, "some text", "y"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    assert [r.score for r in quality_scores(docs, labels).collect()] == [0.5] * 5
    assert quality_scores(docs.limit(0), labels).count() == 0
    one = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id long, quality int")
    found = quality_scores(docs, one).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)


def test_repeated_ids_keep_the_sample_bounded(spark, monkeypatch):
    """One trusted id holds 2,000 rows, half of them copies; the driver gets about the sample's size all the same."""
    sizes = []
    monkeypatch.setattr(quality_model, "fit", lambda good, rest, prior: sizes.append((len(good), len(rest))) or fit(good, rest, prior))
    i = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(i, f"text {k}") for k in range(1000)] + [(i, "copy")] * 1000 + [(1000 + k, f"other {k}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1), (1000, 0), (1001, 0)], "doc_id long, quality int")
    assert quality_scores(docs, labels, sample_rows=100).count() == len(rows)
    assert 50 <= sizes[0][0] <= 200 and 50 <= sizes[0][1] <= 200
