"""SpotSigs: signatures, successors, edits and searches against plain Python, edge rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from paneloom.llm.queries import spot_columns
from paneloom.llm.spotsigs import ANCHORS, compare_with_next, fingerprints, likeness, signatures, similar, similar_sets

SCHEMA = "doc_id long, text string, fingerprint string, _range int, signatures int"


def plain_chains(text):
    words = re.findall(r"[^\W_]+", text.lower())
    found = set()
    for i, w in enumerate(words):
        if w in ANCHORS:
            rest = [x for x in words[i + 1:i + 11] if x not in ANCHORS][:3]
            if len(rest) == 3:
                found.add((w, *rest))
    return found or {("whole", text)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def texts(n, seed=3):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ANCHORS[:12] * 3 + ["Über", "été.", "x-y", "THE", "😀"]
    out = [None, "", " ", "the", "the cat", "no anchors here", "the the the a b c", "A.B,c", "the " * 3 + "one two three"]
    return out + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 90))) for _ in range(n)]


def test_signatures(spark):
    given = [t or "" for t in texts(80)]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    found = {r.doc_id: r.s for r in df.select("doc_id", signatures(F.col("text")).alias("s")).collect()}
    chains = [plain_chains(t) for t in given]
    for i, t in enumerate(given):
        assert len(found[i]) == len(chains[i]) and found[i] == sorted(found[i])
    for i in range(len(given)):
        for j in range(i):
            assert len(set(found[i]) & set(found[j])) == len(chains[i] & chains[j])


@pytest.mark.parametrize("ranges", [1, 7, 500])
def test_compare_with_next(spark, ranges):
    rows = [(i * 3, t) for i, t in enumerate(texts(120))]
    rng = random.Random(ranges)
    docs = spark.createDataFrame([(i, t, "f", 1, 2) for i, t in rng.sample(rows, len(rows))], SCHEMA)
    found = {r.doc_id: r for r in spot_columns(compare_with_next(docs, ranges=ranges)).collect()}
    assert len(found) == len(rows)
    chain = sorted(rows, reverse=True)
    printed = {}
    for (i, text), (_, following) in zip(chain, chain[1:] + chain[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edit = text[:len(text) - half] + following[:half]
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(plain_chains(text), plain_chains(edit))) < 1e-12
        assert abs(r.near_next - jaccard(plain_chains(text), plain_chains(following))) < 1e-12
        assert printed.setdefault(text, r.fingerprint) == r.fingerprint
        assert printed.setdefault(edit, r.edited_fingerprint) == r.edited_fingerprint


def test_edge_rows(spark):
    rows = [(None, "b"), (None, None), (4, "same text"), (4, "same text"), (4, "other"), (9, "the end " * 30_000)]
    docs = spark.createDataFrame([(i, t, "f", 1, 2) for i, t in rows], SCHEMA)
    found = spot_columns(compare_with_next(docs, ranges=50)).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((i for i, _ in rows), key=str)
    assert 1.0 in [r.near_next for r in found if r.doc_id == 4]
    assert spot_columns(compare_with_next(docs.limit(0))).count() == 0
    alone = spot_columns(compare_with_next(docs.where("doc_id = 9"))).first()
    assert alone.near_next == 1.0


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(25):
        base = [rng.choice([*ANCHORS[:8], *[f"w{i}" for i in range(200)]]) for _ in range(rng.randint(20, 120))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "new"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = fingerprints(docs)
    found = {(r["query"], r.doc_id): r.likeness for r in similar(sets.where("doc_id % 5 = 0"), sets, 0.7).collect()}
    chains = [plain_chains(t) for _, t in rows]
    want = {(q, d): jaccard(chains[q], chains[d]) for q, _ in rows if q % 5 == 0 for d, _ in rows}
    want = {k: v for k, v in want.items() if v >= 0.7}
    assert found.keys() == want.keys() and len(want) > len(rows) / 5
    assert all(abs(found[k] - v) < 1e-12 for k, v in want.items())


def test_pruned_likeness(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1]), ([1, 2], [1, 2])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(likeness(F.col("a"), F.col("b"), 0.5)).collect()] == [0.0, 1.0]
    assert [r[0] for r in df.select(likeness(F.col("a"), F.col("b"))).collect()] == [0.25, 1.0]


def test_copies_are_compared_once(spark):
    docs = spark.createDataFrame([(i, "the cat sat on a mat of one two three") for i in range(200)], "doc_id long, text string")
    sets = fingerprints(docs)
    keyed = sets.withColumn("_key", F.xxhash64("signatures"))
    assert similar_sets(keyed, keyed).count() == 1
    assert similar(sets, sets).where("likeness = 1").count() == 200 * 200
