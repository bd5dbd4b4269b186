"""Quality rules against plain Python, the exact binomial tail, and edge rows."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from paneloom.llm.quality_rules import GRID, binomial_tail, certified_cutoffs, keep_good, quality_rules, text_measures

SCHEMA = "doc_id long, text string, lang string, n_words string, _row int"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i:i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def texts():
    rng = random.Random(3)
    made = [
        " ".join(rng.choice(["a", "b", "é", "#x", "\n", "😀"]) for _ in range(rng.randint(0, 80))) for _ in range(60)
    ]
    phrase = "one two three four five six seven eight nine"
    return [
        None, "", " \t\n\x0b\f\r ", "x", "a b c d", phrase, f"{phrase} {phrase}", f"{phrase} x {phrase} y {phrase}",
        "a " * 5000, "l\nl\n\nl \nm", "w" * 100_000, *made,
    ]


def test_measures_equal_plain_python(spark):
    given = list(enumerate(texts())) + [(3, "x"), (3, "x"), (None, "x")]
    df = spark.createDataFrame([(i, t, None if i == 5 else "en", "n", 1) for i, t in given], SCHEMA)
    found = text_measures(df).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    ).collect()
    want = sorted(((i, *plain(t)) for i, t in given), key=str)
    assert sorted((tuple(r) for r in found), key=str) == want


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (3, 1000), (19, 2000), (7, 7), (0, 0), (30, 5000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for k, n, p in df.select("k", "n", binomial_tail(F.col("k"), F.col("n"), 0.01)).collect():
        exact = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
        assert p == 1.0 if k >= n * 0.01 else abs(p - exact) < 1e-9


def labelled(spark, good, bad):
    body = " ".join(f"w{i}" for i in range(40))
    junk = " ".join(f"w{i}###" for i in range(40))
    rows = [(i, body, "en", "n", 1) for i in range(good)] + [(good + i, junk, "en", "n", 1) for i in range(bad)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < good)) for i in range(good + bad)], "doc_id long, quality int")
    return docs, labels


def test_cutoffs_need_enough_labels(spark):
    docs, labels = labelled(spark, 2400, 30)
    few = certified_cutoffs(text_measures(docs), labels.where("doc_id < 300")).first()
    many = certified_cutoffs(text_measures(docs), labels).first()
    assert few["symbol_rate_cutoff"] is None
    assert many["symbol_rate_cutoff"] == GRID["symbol_rate"][0]
    kept = quality_rules(docs, labels)
    assert kept.where("kept").count() == 2400
    assert keep_good(docs, labels).count() == 2400
    assert keep_good(docs, labels).columns == docs.columns


def test_a_rule_that_hits_good_documents_gets_no_strict_cutoff(spark):
    docs, labels = labelled(spark, 2400, 0)
    loud = docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.regexp_replace("text", r"w(\d)", "w!!$1"))
                           .otherwise(F.col("text")))
    cut = certified_cutoffs(text_measures(loud), labels).first()["mark_rate_cutoff"]
    assert cut is None  # 2 % of the good ones exceed every cutoff, and one rule may reject 0.4 %


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "a", 1), (1, "", None, "a", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    assert [r.kept for r in quality_rules(docs, labels).collect()] == [False] * 3
    assert quality_rules(docs.limit(0), labels.limit(0)).count() == 0
    assert keep_good(docs.limit(0), labels).columns == docs.columns
