"""Ranked lexical search by Block-Max MaxScore over an index of document shards.

1. ``corpus_size`` counts documents and terms in one pass.
2. ``build_index`` turns each run of at most ``SHARD_DOCS`` rows (or ``SHARD_CELLS`` postings) of an input partition into a
   shard: one row with its ids, lengths and, per term, a list of blocks of ``BLOCK`` postings. A block holds document
   gaps and frequencies in the narrowest bytes that fit, and beside it, uncompressed, its last document and its largest
   impact. No text is shuffled. The index is a table, so shards survive lost executors and serve any number of queries.
3. Document frequencies are sums over the shards; only those of the items' terms leave Spark.
4. ``search`` sends blocks of items (a fixed number of terms at most) to all shards. Per item the lists are ordered by
   their global bound, weight times largest impact. Lists whose bounds together cannot reach the item's threshold are not
   essential: only documents of the essential lists become candidates. They meet the other lists from the highest bound
   down, and a candidate whose score, block maximum and remaining bounds stay below the threshold goes before that
   block is decompressed. A task keeps a heap of the best per item over its shards, which raises the threshold; a sample of
   shards sets the first one, which is safe because it is the score of real documents.
5. The heaps of all tasks are merged: at most ``k`` rows per item and task.

Scores are whole numbers; equal scores go by ascending id, null ids last. An item with the same id and text as another one
is the same item; items with the same id and other texts are ranked each by itself. Null and empty texts of documents or
items have no terms and no rows. Repeated rows are documents of their own. Empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.common import small_batches
from paneloom.operators.spread import settle

#: What separates terms: all ASCII but digits and letters.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
TERMS = re.compile(TERM.encode()).findall

#: Postings in a block, documents and postings in a shard.
BLOCK, SHARD_DOCS, SHARD_CELLS = 64, 4096, 2_000_000

#: Different terms of the items that are searched for at once; one item alone may have more.
QUERY_TERMS = 100_000

#: Shards that are searched first for the thresholds.
FIRST_SHARDS = 2

INDEX = (
    "shard long, ids array<bigint>, nones binary, m binary, terms array<string>, n_docs array<bigint>, first_block binary, "
    "last_doc binary, top binary, start binary, widths binary, data binary"
)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text; only A-Z are lower-cased."""
    return TERMS(text.lower())


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms all have together."""
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(TERM))
    row = docs.select(n.cast("long").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    return row[0] or 0, row[1] or 0


def damping(n: int, documents: int, total: int) -> int:
    """A document's m from its length."""
    return 100 - 50 + (50 * n * documents) // total


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Non-negative numbers in the fewest bytes that hold the largest; and how many those are."""
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return width, values.astype(f"<u{width}").tobytes()


class Shard:
    """Documents on their way into the index."""

    def __init__(self, documents: int, total: int):
        self.documents, self.total = documents, total
        self.ids: list[int | None] = []
        self.m: list[int] = []
        self.postings: dict[bytes, tuple[list[int], list[int]]] = {}
        self.cells = 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        at = len(self.ids)
        self.ids.append(doc_id)
        self.m.append(damping(len(terms), self.documents, self.total))
        counts = Counter(terms)
        self.cells += len(counts)
        for term, tf in counts.items():
            found = self.postings.get(term)
            if found is None:
                self.postings[term] = ([at], [tf])
            else:
                found[0].append(at)
                found[1].append(tf)

    def row(self, number: int) -> pa.RecordBatch:
        """The shard as one row of the index."""
        terms = sorted(self.postings)
        m = np.array(self.m, dtype=np.int64)
        sizes = np.array([len(self.postings[t][0]) for t in terms], dtype=np.int64)
        places = np.concatenate([np.array(self.postings[t][0], dtype=np.int64) for t in terms])
        tfs = np.concatenate([np.array(self.postings[t][1], dtype=np.int64) for t in terms])
        gain = impacts(tfs, m[places])
        n_blocks = -(-sizes // BLOCK)
        first_block = np.r_[0, np.cumsum(n_blocks)]
        # Each block begins where its list does, or BLOCK postings after the one before it.
        ends = np.cumsum(sizes)
        steps = np.arange(first_block[-1]) - np.repeat(first_block[:-1], n_blocks)
        begins = np.repeat(ends - sizes, n_blocks) + steps * BLOCK
        stops = np.minimum(begins + BLOCK, np.repeat(ends, n_blocks))
        gaps = np.diff(places, prepend=0)
        gaps[begins] = places[begins]
        data, widths, start = [], [], []
        at = 0
        if len(begins):
            wide, tall = np.maximum.reduceat(gaps, begins), np.maximum.reduceat(tfs, begins)
            gap_bytes = {w: gaps.astype(f"<u{w}") for w in (1, 2)}
            tf_bytes = {w: tfs.astype(f"<u{w}") for w in (1, 4)}
            for b, e, gap, tf in zip(begins.tolist(), stops.tolist(), wide.tolist(), tall.tolist()):
                a, c = 1 if gap < 1 << 8 else 2, 1 if tf < 1 << 8 else 4
                block = gap_bytes[a][b:e].tobytes() + tf_bytes[c][b:e].tobytes()
                start.append(at)
                widths.append(a << 4 | c)
                data.append(block)
                at += len(block)
        top = np.maximum.reduceat(gain, begins) if len(begins) else gain
        columns = [
            pa.array([number]), pa.array([[i or 0 for i in self.ids]], pa.list_(pa.int64())),
            pa.array([np.array([i is None for i in self.ids], dtype="u1").tobytes()], pa.binary()),
            pa.array([m.astype("<i8").tobytes()], pa.binary()),
            pa.array([[t.decode() for t in terms]], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int64())),
            *[pa.array([a.astype("<i4").tobytes()], pa.binary()) for a in (first_block, places[stops - 1], top)],
            pa.array([np.array([*start, at], dtype="<i8").tobytes()], pa.binary()),
            pa.array([np.array(widths, dtype="u1").tobytes()], pa.binary()), pa.array([b"".join(data)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])


def build_index(
    docs: DataFrame, size: tuple[int, int], *, id_col: str = "doc_id", text_col: str = "text",
    shard_docs: int = SHARD_DOCS, shard_cells: int = SHARD_CELLS,
) -> DataFrame:
    """The index: one row per shard, documents without terms left out. No shuffle."""
    small_batches(docs.sparkSession)
    documents, total = size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = Shard(documents, total), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = terms_of(text.as_py() or b"")
                if terms:
                    shard.add(doc_id, terms)
                if len(shard.ids) >= shard_docs or shard.cells >= shard_cells:
                    yield shard.row(number)
                    shard, number = Shard(documents, total), number + 1
        if shard.ids:
            yield shard.row(number)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, INDEX)


class Lists:
    """The posting lists of one row of the index; blocks are decompressed one by one, on demand."""

    def __init__(self, row: dict):
        self.number = row["shard"]
        self.ids = np.array(row["ids"], dtype=np.int64)
        self.nones = np.frombuffer(row["nones"], "u1")
        self.m = np.frombuffer(row["m"], "<i8")
        self.place = {t: i for i, t in enumerate(row["terms"])}
        self.first_block, self.last_doc, self.top = (
            np.frombuffer(row[c], "<i4") for c in ("first_block", "last_doc", "top")
        )
        self.start, self.widths, self.data = np.frombuffer(row["start"], "<i8"), row["widths"], row["data"]
        self.opened = 0

    def bound(self, place: int) -> int:
        """The largest impact in a list."""
        return int(self.top[self.first_block[place]:self.first_block[place + 1]].max())

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block."""
        self.opened += 1
        low, high = int(self.start[number]), int(self.start[number + 1])
        gap, tf = self.widths[number] >> 4, self.widths[number] & 15
        n = (high - low) // (gap + tf)
        docs = np.cumsum(np.frombuffer(self.data, f"<u{gap}", n, low), dtype=np.int64)
        tfs = np.frombuffer(self.data, f"<u{tf}", n, low + gap * n).astype(np.int64)
        return docs, impacts(tfs, self.m[docs])

    def whole(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(b) for b in range(self.first_block[place], self.first_block[place + 1])]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def best_of_shard(lists: Lists, weights: dict[str, int], floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard that may reach ``floor``: no other document does."""
    order = sorted((w * lists.bound(lists.place[t]), lists.place[t], w) for t, w in weights.items() if w and t in lists.place)
    reach, essential = 0, 0  # the lists before this one cannot reach the floor together
    while essential < len(order) and reach + order[essential][0] < floor:
        reach += order[essential][0]
        essential += 1
    if essential == len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts = [(d, g * w) for _, p, w in order[essential:] for d, g in [lists.whole(p)]]
    score = np.zeros(len(lists.ids), dtype=np.int64)
    for d, g in parts:
        score[d] += g  # a list names a document once
    docs = np.flatnonzero(score)
    score = score[docs]
    for bound, place, weight in reversed(order[:essential]):
        keep = score + reach >= floor
        docs, score = docs[keep], score[keep]
        if not len(docs):
            break
        reach -= bound
        low, high = int(lists.first_block[place]), int(lists.first_block[place + 1])
        at = np.searchsorted(lists.last_doc[low:high], docs)
        inside = at < high - low
        most = np.zeros(len(docs), dtype=np.int64)
        most[inside] = lists.top[low:high][at[inside]].astype(np.int64) * weight
        # The block's own maximum instead of the list's: who still falls short goes before the block is opened.
        keep = score + most + reach >= floor
        docs, score, at, inside = docs[keep], score[keep], at[keep], inside[keep]
        for b in np.unique(at[inside]).tolist():
            own, gain = lists.block(low + b)
            mine = np.flatnonzero(at == b)
            spot = np.minimum(np.searchsorted(own, docs[mine]), len(own) - 1)
            hit = own[spot] == docs[mine]
            score[mine[hit]] += gain[spot[hit]] * weight
    keep = score >= max(floor, 1)
    return docs[keep], score[keep]


def searcher(sent, k: int):
    """The scan of index rows: (item, doc_id, score) of a task's best ``k`` per item of ``sent`` (items, floors)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors = sent.value
        heaps: dict[int, list] = {i: [] for i, _ in items}
        for batch in batches:
            for at in range(batch.num_rows):
                lists = Lists({name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns)})
                for item, weights in items:
                    heap = heaps[item]
                    floor = max(floors.get(item, 1), heap[0][0] if len(heap) == k else 1)
                    docs, scores = best_of_shard(lists, weights, floor)
                    if len(docs) > k:  # ties at the edge stay: ids decide about them
                        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                        docs, scores = docs[scores >= edge], scores[scores >= edge]
                    for d, score in zip(docs.tolist(), scores.tolist()):
                        # The least of the heap has the lowest score and, among those, the last id; null ids come last.
                        entry = (score, -int(lists.nones[d]), -int(lists.ids[d]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        rows = [(item, None if none else -less, score) for item, heap in heaps.items() for score, none, less in heap]
        columns = [pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[], [], []])]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return scan


def item_blocks(items: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple]]:
    """Lists of (item_id, terms) with ``most`` terms at most, one list at a time on the driver."""
    rows = items.select(F.col(item_col).alias("id"), F.col(text_col).cast("binary").alias("text")).distinct()
    block, held = [], 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        terms = sorted({t.decode() for t in terms_of(bytes(row.text or b""))})
        if block and held + len(terms) > most:
            yield block
            block, held = [], 0
        if terms:
            block.append((row.id, terms))
            held += len(terms)
    if block:
        yield block


def weights_of(index: DataFrame, documents: int, terms: set[str]) -> dict[str, int]:
    """The weight of each of ``terms`` that some document holds."""
    wanted = index.sparkSession.createDataFrame([(t,) for t in sorted(terms)], "term string")
    wanted = F.broadcast(wanted) if len(terms) <= QUERY_TERMS else wanted
    held = index.select(F.explode(F.arrays_zip("terms", "n_docs")).alias("_e")).select("_e.terms", "_e.n_docs")
    counted = held.join(wanted, F.col("terms") == F.col("term")).groupBy("term").agg(F.sum("n_docs").alias("df"))
    return {r.term: math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1))) for r in counted.collect()}


def search(
    index: DataFrame, size: tuple[int, int], items: DataFrame, *, k: int = 50, item_col: str = "item_id",
    text_col: str = "text", query_terms: int = QUERY_TERMS, first_shards: int = FIRST_SHARDS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, from a settled index."""
    spark = index.sparkSession
    kind = f"number long, {item_col} {items.schema[item_col].dataType.simpleString()}"
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    hits_of = "item long, doc_id long, score long"
    found = spark.createDataFrame([], f"{kind}, rank int, doc_id long, score long").drop("number")
    for block in item_blocks(items, item_col, text_col, query_terms):
        weights = weights_of(index, size[0], {t for _, terms in block for t in terms})
        sent = [(i, {t: weights[t] for t in terms if t in weights}) for i, (_, terms) in enumerate(block)]
        # One task's first shards; the others do not move.
        few = index.where((F.spark_partition_id() == 0) & (F.col("shard") < first_shards))
        first = few.mapInArrow(searcher(spark.sparkContext.broadcast((sent, {})), k), hits_of)
        full = first.groupBy("item").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        floors = {r.item: r.floor for r in full.collect()}
        hits = index.mapInArrow(searcher(spark.sparkContext.broadcast((sent, floors)), k), hits_of)
        ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], kind)
        found = found.unionByName(
            ranked.join(names, F.col("item") == F.col("number")).select(item_col, "rank", "doc_id", "score")
        )
    return found


def ranked_search(
    docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The best ``k`` of ``docs`` for each of ``items``, by an index that is built, settled and searched."""
    size = corpus_size(docs, text_col)
    return search(settle(build_index(docs, size, id_col=id_col, text_col=text_col)), size, items, k=k, **options)
