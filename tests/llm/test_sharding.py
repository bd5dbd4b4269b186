"""Sharding: the heap rule, the tree of blocks, groups kept together, slots and edge rows."""

import random
import zlib
from collections import defaultdict

from paneloom.llm.sharding import longest_first, schedule_groups, shard_rows, write_shards

SCHEMA = "doc_id long, text string, shard string, slot int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)


def test_heap_equals_plain_search():
    rng = random.Random(0)
    sizes = sorted((rng.randint(1, 99) for _ in range(500)), reverse=True)
    loads, want = [0] * 7, []
    for s in sizes:
        b = loads.index(min(loads))
        loads[b] += s
        want.append(b)
    assert longest_first(sizes, 7) == want


def test_tree_balances_and_keeps_a_giant_alone(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 5000)) for i in range(6000)] + [(10_000, 20_000_000)]
    out = schedule_groups(spark.createDataFrame(rows, "item long, weight long"), 8, block_items=1024).collect()
    weight, loads = dict(rows), defaultdict(int)
    assert sorted(r.item for r in out) == sorted(weight)
    for r in out:
        loads[r.shard] += weight[r.item]
    rest = sorted(loads.values())[:-1]
    assert max(loads.values()) < 20_000_000 + 5000 and len(rest) == 7
    assert max(rest) - min(rest) < 0.03 * max(rest)


def test_rows(spark):
    rng = random.Random(2)
    given = [(i, "é" * rng.randint(0, 40) + str(rng.randint(0, 300))) for i in range(2000)]
    given += [(i, "same text") for i in range(5000, 5700)] + [(7, None), (None, None), (None, ""), (9, "x" * 90_000)]
    out = shard_rows(table(spark, given), 8, block_items=64).collect()
    text_of = defaultdict(list)
    for i, t in given:
        text_of[i].append(t)
    assert len(out) == len(given)
    loads, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in out:
        loads[r.shard] += r.size
        slots[r.shard].append((r.slot, r.doc_id))
        homes[r.text_crc32, r.size].add(r.shard)
        assert (r.size, r.text_crc32) in {
            (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in text_of[r.doc_id]
        }
    assert all(len(s) == 1 for s in homes.values())
    for taken in slots.values():
        assert [s for s, _ in sorted(taken)] == list(range(len(taken)))
    light = sorted(loads.values())[:-1]
    assert max(light) - min(light) <= 0.05 * max(light)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, shard_rows(table(spark, given[::-1]), 8, block_items=64).collect()), key=str)


def test_empty_and_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 50}", None) for i in range(200)], "doc_id long, text string, extra int")
    assert shard_rows(docs.limit(0)).count() == 0
    back = write_shards(docs, str(tmp_path / "out"), 4)
    assert back.count() == 200 and set(back.columns) == {"doc_id", "text", "extra", "shard"}
    assert back.select("text", "shard").distinct().count() == 50


def test_clashing_columns_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 5}", i, "old") for i in range(40)] + [(None, None, 1, "old")], "doc_id long, text string, _item int, shard string")
    back = write_shards(docs, str(tmp_path / "out"), 2)
    assert sorted(back.columns) == ["_item", "doc_id", "shard", "text"] and back.count() == 41
    assert {r.shard for r in back.collect()} == {0, 1}
    assert sorted(r["_item"] for r in back.collect()) == sorted([*range(40), 1])
