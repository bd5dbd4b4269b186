"""SimHash: fingerprints and components against brute force, hot keys in chunks, edge rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from paneloom.llm.simhash import classes, fingerprint, forest, links, segments, simhash_components, simhash_dedup
from tests.llm.test_components import plain

SCHEMA = "doc_id long, text string, fp string, key int, component_id int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def plain_fingerprint(text, k=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps, bits):
    fps = sorted(set(fps))
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if bin((a ^ b) % 2**64).count("1") <= bits]
    return {x: plain(pairs).get(x, x) for x in fps}


def groups(label_of):
    found = {}
    for x, label in label_of.items():
        found.setdefault(label, set()).add(x)
    return sorted(map(sorted, found.values()))


def test_fingerprint():
    rng = random.Random(5)
    texts = ["", " \x0b\n", "One", "one TWO", "Ünï code É x a b", "a b c", "a b c " * 40_000]
    texts += [" ".join(rng.choice(["The", "cat", "sat", "é", "ÀB"]) for _ in range(rng.randint(1, 60))) for _ in range(50)]
    for text in texts:
        assert fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)


def clustered(rng, n):
    made = []
    while len(made) < n:
        center = rng.getrandbits(64)
        made.append(center)
        for _ in range(rng.randint(0, 60)):
            center = rng.choice([center, center ^ 1 << rng.randrange(64)])
            made.append(center ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))))
    return [x % 2**64 - (x % 2**64 >> 63) * 2**64 for x in made]


@pytest.mark.parametrize(("bits", "chunk"), [(3, 4096), (3, 5), (1, 4096), (2, 7), (5, 4096)])
def test_links_connect_what_brute_force_connects(spark, bits, chunk):
    fps = sorted(set(clustered(random.Random(bits), 700)))
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = [tuple(r) for r in links(nodes, max_bits=bits, chunk=chunk).collect()]
    assert all(bin((a ^ b) % 2**64).count("1") <= bits for a, b in found)
    own = plain(found)
    assert groups({x: own.get(x, x) for x in fps}) == groups(plain_classes(fps, bits))


def test_segments_cover_the_bits():
    assert segments(3) == [(0, 32), (32, 32)]
    for bits in range(1, 9):
        cut = segments(bits)
        assert bits // len(cut) <= 1 and sum(w for _, w in cut) == 64


def test_forest_spans():
    fps = np.array(clustered(random.Random(9), 400)[:400], dtype=np.int64)
    fps = np.unique(fps)
    found = plain([(int(fps[a]), int(fps[b])) for a, b in forest(fps, 3)])
    assert groups({int(x): found.get(int(x), int(x)) for x in fps}) == groups(plain_classes(fps.tolist(), 3))


def corpus():
    rng = random.Random(6)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 300))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, "hot copy of one text") for i in range(200)]
    return rows + [(2000, None), (2001, ""), (2002, " "), (None, "alone without an id"), (5, rows[5][1]), (2003, "y " * 60_000)]


def test_components_and_dedup(spark):
    rows = corpus()
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_classes(fps, 3)
    first = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            first[root[f]] = min(first.get(root[f], i), i)
    want = sorted(((i, f"{f:016x}", first.get(root[f])) for (i, _), f in zip(rows, fps)), key=str)
    docs = table(spark, rows)
    assert sorted(map(tuple, simhash_components(docs).collect()), key=str) == want
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for _, _, c in want}, key=str)


def test_empty(spark):
    docs = table(spark, [(1, "a")]).limit(0)
    assert simhash_components(docs).count() == 0
    assert simhash_dedup(docs).count() == 0
    assert classes(docs.selectExpr("doc_id", "1L AS tie", "1L AS fp")).count() == 0
