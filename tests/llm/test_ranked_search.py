"""Ranked search against a full scan, and the pruning itself."""

import math
import random
import re
from collections import Counter

import pytest

from paneloom.llm import ranked_search as R
from paneloom.operators.spread import settle

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def plain_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(docs, items, k=50):
    """(item_id, rank, doc_id, score) by scoring everything."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, t) for i, t in items}:
        hits = []
        for i, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n) // total if bag else 0
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m))
                for t in set(plain_terms(text)) & bag.keys()
            )
            if score > 0:
                hits.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=600):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["Été", "ÉTÉ", "日本", "x-y", "Don't"]
    rows = []
    for i in range(n):
        size = rng.choice((0, 1, 5, 30, 30, 200))
        rows.append((i, " ".join(words[min(int(rng.expovariate(0.03)), len(words) - 1)].upper() for _ in range(size))))
    rows += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, rows[5][1]), (7, None), (8, ""), (9, "w299 " * 3000)]
    rows += [(10_000 + i, "w7 w8 w9") for i in range(80)]  # ties beyond the 50th place
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(25)]
    return rows, [*items, (0, items[0][1]), (1, "w7 w9"), (None, "w7 w8 w9"), (50, None), (51, ""), (52, "unheard of")]


@pytest.mark.parametrize("seed, options", [
    (1, {}), (2, {"shard_docs": 37}), (3, {"shard_docs": 64, "shard_cells": 300}), (4, {"query_terms": 20, "first_shards": 1}),
])
def test_equals_full_scan(spark, seed, options):
    rows, items = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "t") for i, t in rows], "doc_id long, text string, n int, terms string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    size = R.corpus_size(docs)
    build = {k: v for k, v in options.items() if k.startswith("shard")}
    index = settle(R.build_index(docs, size, **build))
    found = R.search(index, size, asked, **{k: v for k, v in options.items() if k not in build})
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(rows, items)
    assert R.search(index, size, asked, k=3).count() == len(plain_search(rows, items, 3))


def shard(rows):
    bags = [(i, R.terms_of(t.encode())) for i, t in rows]
    own = R.Shard(len(bags), sum(len(b) for _, b in bags))
    for i, b in bags:
        own.add(i, b)
    batch = own.row(0)
    return R.Lists(batch.to_pylist()[0])


def test_blocks_hold_the_lists():
    rng = random.Random(1)
    lists = shard([(i, "a " * rng.choice((1, 2, 300)) + "b" * (i % 7 == 0)) for i in range(3000)])
    docs, gain = lists.whole(lists.place["a"])
    assert docs.tolist() == list(range(3000))
    assert lists.bound(lists.place["a"]) == gain.max()
    docs, _ = lists.whole(lists.place["b"])
    assert docs.tolist() == list(range(0, 3000, 7))


def test_pruning_opens_few_blocks_and_keeps_the_best():
    rng = random.Random(2)
    rows = [(i, "common " * rng.randint(1, 3) + ("rare" if i in (5, 2900) else "")) for i in range(4000)]
    lists = shard(rows)
    weights = {"common": 5, "rare": 7000}
    docs, scores = R.best_of_shard(lists, weights, 1)
    everything, lists.opened = dict(zip(docs.tolist(), scores.tolist())), 0
    floor = min(everything[5], everything[2900])
    docs, scores = R.best_of_shard(lists, weights, floor)
    assert dict(zip(docs.tolist(), scores.tolist())) == {d: s for d, s in everything.items() if s >= floor}
    assert lists.opened <= 3  # of 64
    lists.opened = 0
    assert len(R.best_of_shard(lists, weights, 10 ** 15)[0]) == 0 and lists.opened == 0


def test_block_maxima_reject_before_opening():
    rows = [(i, ("rare " if i % 64 == 0 else "") + ("common common common" if i == 64 else "common x y")) for i in range(4096)]
    lists = shard(rows)
    weights = {"common": 1000, "rare": 3000}
    docs, scores = R.best_of_shard(lists, weights, 1)
    best, lists.opened = int(scores.max()), 0
    found, _ = R.best_of_shard(lists, weights, best)
    # The one block of the essential list, and the one of 64 whose maximum allows the best score.
    assert found.tolist() == [64] and lists.opened == 2 and len(docs) == 4096


def test_empty(spark):
    rows, items = corpus(1, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert R.ranked_search(docs.limit(0), asked).count() == 0
    assert R.ranked_search(docs, asked.limit(0)).count() == 0
    assert R.ranked_search(docs.where("text = ''"), asked).count() == 0
    assert R.ranked_search(docs, asked).columns == ["item_id", "rank", "doc_id", "score"]
