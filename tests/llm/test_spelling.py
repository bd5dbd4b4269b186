"""Spelling variants against brute force: all pairs, counts, forms and roots."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paneloom.llm.spelling import Acceptor, near_pairs, roots, spelling_variants, vocabulary

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows, drop_one_in=31, shortest=7, least=2):
    count = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_one_in and h % drop_one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= shortest and n >= least}


def plain_variants(words, ratio=10):
    out, form = [], {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out.append((w, form[w], n, len(others)))
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, f, root(w), n, k, words[f] if f else None) for w, f, n, k in out)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", min_size=3, max_size=4)), st.booleans())
def test_composition(words, skip):
    short, long = [w for w in words if len(w) == 3], [w for w in words if len(w) == 4]
    want = [(False, *sorted((x, y))) for i, x in enumerate(short) for y in short[:i] if near(x, y)]
    want += [(True, x, y) for x in short for y in long if near(x, y) and not (skip and y[:-1] == x)]
    found = [(k, *(sorted((x, y)) if not k else (x, y))) for k, x, y in near_pairs(short, long, skip)]
    assert sorted(found) == sorted(want)


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("pl", "st", "br", "cl") for b in ("ing", "ost", "and"))
    assert len(Acceptor(words).arcs) == 12  # a tree has 41
    assert Acceptor([]).arcs == [{}]


def table(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n long")


@pytest.mark.parametrize("seed, letters, group", [(1, "ab", 4096), (2, "ab", 5), (3, "abcdefgé", 3), (4, "aé", 1)])
def test_equals_brute_force(spark, seed, letters, group):
    rng = random.Random(seed)
    words = {}
    for _ in range(400):
        w = "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 7, 7, 8, 8, 9, 12))))
        words[w] = rng.choice((2, 3, 30, 30, 400, 5000))
    words |= {"a" * k: 10 ** k for k in range(5, 16)}
    found = spelling_variants(table(spark, words), group_words=group)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == plain_variants(words)


def test_very_long_words(spark):
    long = "ab" * 20_000
    words = {long: 500, long + "a": 2, long[:9] + "c" + long[10:]: 3, "x" + long: 40, "abcdefg": 2}
    found = spelling_variants(table(spark, words))
    assert sorted(map(tuple, found.collect())) == plain_variants(words)


def test_long_chains(spark):
    forms = spark.createDataFrame([(str(i), str(i + 1)) for i in range(37)] + [("x", "37")], "word string, form string")
    assert {tuple(r) for r in roots(forms).collect()} == {(str(i), "37") for i in range(37)} | {("x", "37")}


def test_from_texts(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeéÿ×") for _ in range(rng.randint(6, 12))) for _ in range(25)]
    rows = [(i, " ".join(rng.choice(base).title() for _ in range(60))) for i in range(40)]
    rows += [(None, "Señoritas señoritas SEÑORITAS"), (3, None), (3, ""), (7, rows[7][1]), (8, "x" * 30_000 + "1" + "X" * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    words = vocabulary(docs, drop_one_in=31)
    assert {r.word: r.n for r in words.collect()} == plain_words(rows)
    assert {r.word: r.n for r in vocabulary(docs).collect()} == plain_words(rows, None)
    found = spelling_variants(words)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == plain_variants(plain_words(rows))
    assert spelling_variants(vocabulary(docs.limit(0), drop_one_in=31)).count() == 0
