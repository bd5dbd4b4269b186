"""Balanced shards by longest-processing-time scheduling, with rows that must stay together in one shard.

Groups (equal texts) are summed before anything is scheduled. Scheduling is a tree: the groups are dealt into blocks
of bounded size; in each block a heap gives every group, largest first, to the least-loaded of a few bundles; the
bundles of many blocks are the items of the next level, and the last level schedules onto the shards themselves. So no
task sees more than one block, and a group of any size is one item. Below the last level there are several bundles for
each shard, which keeps the items of the next level fine.

A shard can exceed the mean by no more than one item of the last level, so a group that holds much of the data fills
its shard and the others share the rest. Numbers within a shard come from a distributed running count.

Null texts form one group, as do empty ones; an empty table gives an empty result; repeated rows stay together as their
texts are equal, and each has its own slot; ties are broken by a hash of the group, so reruns agree; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import attach
from paneloom.operators.spread import running_total, settle

#: Items that one task schedules at most, on average.
BLOCK_ITEMS = 4096

#: Bundles for each shard below the last level.
BUNDLES = 8


def longest_first(sizes: list[int], bins: int) -> list[int]:
    """The bin of each item of a list sorted by falling size: always the least-loaded, the first of equals."""
    loads = [(0, b) for b in range(bins)]
    taken = []
    for size in sizes:
        load, b = loads[0]
        heapq.heapreplace(loads, (load + size, b))
        taken.append(b)
    return taken


def level(items: DataFrame, blocks: int, bins: int) -> DataFrame:
    """(block, item, weight, bin): longest-first within each of ``blocks`` blocks."""
    def schedule(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "item"], ascending=[False, True], kind="stable")
        return pdf.assign(bin=longest_first(pdf["weight"].tolist(), bins))

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(schedule, "item long, weight long, block int, bin int")


def schedule_groups(groups: DataFrame, shards: int, *, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item, shard) for a table (item long, weight long) with one row per item."""
    bundles = shards * BUNDLES
    block_items = max(block_items, 4 * bundles)
    todo, found = settle(groups), []
    while True:
        n = todo.count()
        blocks = math.ceil(n / block_items)
        if blocks <= 1:
            found.append(level(todo, 1, shards))
            break
        placed = settle(level(todo, blocks, bundles))
        found.append(placed)
        code = (F.col("block").cast("long") * bundles + F.col("bin")).alias("item")
        todo = settle(placed.groupBy(code).agg(F.sum("weight").alias("weight")))
    shard_of = found.pop().select("item", F.col("bin").alias("shard"))
    for placed in reversed(found):
        coded = placed.select("item", (F.col("block").cast("long") * bundles + F.col("bin")).alias("_code"))
        shard_of = attach(coded, shard_of.withColumnRenamed("item", "_code"), ["_code"]).select("item", "shard")
    return shard_of


def item_of(text_col: str) -> Column:
    """The group of a text: a 64-bit hash, null and empty texts alike."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def shard_rows(
    docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; shards of nearly equal size, equal texts together.

    The size is the UTF-8 length plus 1. A null text counts as an empty one: size 1, checksum 0, the same group. Slots
    number a shard's rows from 0 by id. Texts meet by a 64-bit hash; the texts themselves are not shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), item_of(text_col).alias("item"),
    )
    rows = settle(rows)
    groups = rows.groupBy("item").agg(F.sum("size").alias("weight"))
    placed = attach(rows, schedule_groups(groups, shards, block_items=block_items), ["item"])
    counted = running_total(
        placed, ["shard"], [F.col("doc_id"), F.col("item")], F.lit(1).cast("long"), "slot"
    )
    return counted.select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, *, rows_per_file: int = 1_000_000,
                 text_col: str = "text") -> DataFrame:
    """Write every row of ``docs`` into one folder per shard (``shard=0`` ...) and read them back.

    All columns are written, but for one that is called ``shard``: the folder's number takes its place.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]
    assigned = docs.select(
        F.struct(*kept).alias("_row"), item_of(text_col).alias("_item"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1).alias("_size"),
    )
    groups = assigned.groupBy(F.col("_item").alias("item")).agg(F.sum("_size").alias("weight"))
    shard_of = schedule_groups(groups, shards).withColumnRenamed("item", "_item")
    attach(assigned.drop("_size"), shard_of, ["_item"]).select("_row.*", "shard").write.option(
        "maxRecordsPerFile", rows_per_file
    ).partitionBy("shard").mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)
