"""The pipeline against brute-force versions of its stages, each on that stage's own input."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_line_dedup import brute
from tests.llm.test_mixing import plain_targets
from tests.llm.test_pieces import expected
from tests.llm.test_quality_rules import plain
from tests.llm.test_simhash import plain_classes, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The first documents of the smallest table, before and after each stage."""
    source = str(tmp_path_factory.mktemp("source"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120 AND n_chars < 6000")
    docs.write.parquet(f"{source}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{source}/labels.parquet")
    found = [spark.read.parquet(f"{source}/documents.parquet")]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], source).write.parquet(f"{source}/{number}")
        found.append(spark.read.parquet(f"{source}/{number}"))
    return source, found


def test_stages_keep_the_columns(tables):
    _, found = tables
    assert len(corpus_pipeline.STAGES) == 5
    for df in found[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rules_and_lines_and_copies(tables):
    _, (docs, ruled, lined, unique, *_) = tables
    # So few labels certify no cutoff, so only the fixed floor rejects.
    assert {r.doc_id for r in ruled.collect()} == {r.doc_id for r in docs.collect() if not plain(r.text)[-1]}
    assert {r.doc_id: r.text for r in lined.collect()} == brute([(r.doc_id, r.text) for r in ruled.collect()])
    assert lined.where(F.col("n_chars") != F.length("text")).count() == 0
    rows = lined.collect()
    root = plain_classes([plain_fingerprint(r.text) for r in rows], 3)
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(root[plain_fingerprint(r.text)], r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(first.values())


def test_mix_and_pieces(tables):
    _, (_, _, _, unique, mixed, done) = tables
    size = {r.doc_id: len(r.text.split()) for r in unique.collect()}
    source = {r.doc_id: r.source for r in unique.collect()}
    total, taken = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
    rows = mixed.collect()
    for r in rows:
        taken[r.source] += size[r.doc_id]
    for s, target in plain_targets(total).items():
        assert abs(taken[s] - target) <= max(n for i, n in size.items() if source[i] == s) / 2 + 0.001
    assert max(Counter(r.doc_id for r in rows).values()) <= 2
    want = []
    for r in rows:
        ids, text = expected(r.text)
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, done.collect())) == sorted(want)


def test_run(spark, tables):
    source, found = tables
    assert sorted(corpus_pipeline.run(spark, source).collect()) == sorted(found[-1].collect())


def test_empty(spark, tables, tmp_path):
    source, _ = tables
    spark.read.parquet(f"{source}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
