"""Near-duplicate documents by SimHash and deletion-variant signatures.

A fingerprint has 64 bits: bit ``i`` is set when more than half of the hashes of the text's word shingles have it set.
Two fingerprints are linked when they differ in ``max_bits`` bits at most. To find all such pairs, the 64 bits are cut
into so few segments that one of them must differ by one bit at most; of each segment every variant with one bit
deleted is indexed, and fingerprints that share a variant are compared in full. Equal fingerprints are one node, so
copies add nothing.

The index is range-partitioned on (variant, fingerprint), so a variant that very many fingerprints share is cut into
chunks over many tasks; each task links its own chunk, and pairs of chunks of one variant meet in a second join. What
leaves a chunk is a spanning forest of its links, never all pairs.

Null, empty and blank texts have fingerprint 0, linked like any other. A text shorter than a shingle is one shingle.
Null ids stay in the result; the id of a component is its smallest id (null when it has none). Repeated rows each get a
row. An empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import attach
from paneloom.llm.components import components
from paneloom.operators.spread import settle, slices_of

BITS = 64

#: Fingerprints of one variant that are compared with one another in one go.
CHUNK = 4096

#: Shingle hashes added up at a time.
HASHES = 65_536


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text as a signed integer."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    starts, ends, at = [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    ends = ends[shingle - 1:] or [len(joined)]
    hashed, n = xxhash.xxh64_intdigest, len(ends)
    counts = np.zeros(BITS, dtype=np.int64)
    for low in range(0, n, HASHES):
        part = [hashed(joined[s:e], seed) for s, e in zip(starts[low:low + HASHES], ends[low:low + HASHES])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, tie, fp) of every row; ``tie`` is a hash of the text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fps = pa.array((fingerprint(t.as_py() or b"", shingle) for t in texts), pa.int64(), size=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "tie", "fp"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).isNull(), F.col(text_col)).alias("tie"),
        F.col(text_col).cast("binary").alias("text"),
    )
    return rows.mapInArrow(scan, "doc_id long, tie long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of as few segments as make one of them differ by one bit at most."""
    n = (max_bits + 2) // 2
    edges = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(fp: Column, max_bits: int) -> Column:
    """The keys of a fingerprint: each segment with each one of its bits deleted."""
    def of_segment(first: int, width: int) -> Column:
        mask = (1 << width) - 1
        part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(mask if width < BITS else -1).cast("long"))

        def key(bit: Column) -> Column:
            one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
            rest = part.bitwiseAND(F.bitwise_not(one))
            place = (bit + first).cast("long")
            if width > BITS - 7:
                return F.xxhash64(place, rest)  # does not fit beside its place; a clash only adds a comparison
            return F.shiftleft(place, width).bitwiseOR(rest)

        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), key)

    return F.concat(*[of_segment(first, width) for first, width in segments(max_bits)])


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what ``max_bits`` connects among ``fps``: each found node links to the one that found it."""
    fps = fps.view(np.uint64)
    left = np.ones(len(fps), dtype=bool)
    out = []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            others = np.flatnonzero(left)
            if not len(others):
                return out
            near = others[np.bitwise_count(fps[others] ^ fps[at]) <= max_bits]
            left[near] = False
            queue.extend(near.tolist())
            out.extend((at, i) for i in near.tolist())
    return out


LINKS = pa.schema([
    ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("chunk", pa.int64()), ("fps", pa.list_(pa.int64())),
])


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, LINKS[4].type)],
        schema=LINKS,
    )


def scan_index(max_bits: int, chunk: int):
    """Links within the runs of one key of a sorted partition; runs that may go on elsewhere also come out as chunks."""
    def whole(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Complete runs: short ones are compared at growing distance, all at once; long ones one by one."""
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts, sizes = np.r_[0, edges], np.diff(np.r_[0, edges, len(keys)])
        short = np.repeat(sizes <= 32, sizes)
        at, step, a, b = np.flatnonzero(short), 1, [], []
        while len(at):
            at = at[at + step < len(keys)]
            at = at[keys[at] == keys[at + step]]
            near = at[np.bitwise_count((fps[at] ^ fps[at + step]).view(np.uint64)) <= max_bits]
            a.append(fps[near])
            b.append(fps[near + step])
            step += 1
        for s, n in zip(starts[sizes > 32], sizes[sizes > 32]):
            links = forest(fps[s:s + n], max_bits)
            a.append(fps[[s + i for i, _ in links]])
            b.append(fps[[s + j for _, j in links]])
        if sum(map(len, a)):
            yield _batch(np.concatenate(a), np.concatenate(b))

    def piece(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A part of a run that may have other parts: its own links, and the part itself, known by its first entry."""
        yield from whole(keys, fps)
        row = {"key": int(keys[0]), "chunk": int(fps[0]), "fps": fps.tolist()}
        yield pa.RecordBatch.from_pylist([row], schema=LINKS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        parted = None  # the key whose run has other parts, here or in the partition before
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            while len(keys):
                parted = keys[0] if parted is None else parted
                run = int(np.searchsorted(keys, keys[0], side="right"))
                if keys[0] == parted or run == len(keys):
                    if run == len(keys) and run < chunk:
                        break  # it may go on in the next batch
                    parted, n = keys[0], min(run, chunk)
                    yield from piece(keys[:n], fps[:n])
                else:
                    n = int(np.searchsorted(keys, keys[-1], side="left"))
                    yield from whole(keys[:n], fps[:n])
                keys, fps = keys[n:], fps[n:]
        if len(keys):
            yield from piece(keys, fps)  # it may go on in the next partition

    return scan


def scan_pairs(max_bits: int):
    """Links between the two chunks of each row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                fps = np.concatenate([left.values.to_numpy(), right.values.to_numpy()])
                links = np.array(forest(fps, max_bits), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(fps[links[:, 0]]), pa.array(fps[links[:, 1]])], ["a", "b"])

    return scan


def links(nodes: DataFrame, *, max_bits: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` of ``nodes`` that connect all that differ little."""
    index = (
        nodes.select(F.explode(variants(F.col("fp"), max_bits)).alias("key"), "fp")
        .repartitionByRange(slices_of(nodes), "key", "fp").sortWithinPartitions("key", "fp")
    )
    found = settle(index.mapInArrow(
        scan_index(max_bits, chunk), "a long, b long, key long, chunk long, fps array<bigint>"
    ))
    parts = found.where("key is not null")
    left = parts.select("key", F.col("chunk").alias("_left"), F.col("fps").alias("_a"))
    right = parts.select("key", F.col("chunk").alias("_right"), F.col("fps").alias("_b"))
    pairs = left.join(right, "key").where("_left < _right").select("_a", "_b")
    across = pairs.mapInArrow(scan_pairs(max_bits), "a long, b long")
    return found.where("key is null").select("a", "b").unionByName(across).distinct()


def classes(fps: DataFrame, *, max_bits: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(fp, first, component): for each distinct fingerprint its smallest and its component's smallest (doc_id, tie)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    nodes = settle(fps.groupBy("fp").agg(F.min(order).alias("first")))
    roots = settle(components(links(nodes, max_bits=max_bits, chunk=chunk)).withColumnRenamed("node", "fp"))
    joined = attach(nodes, roots, ["fp"])
    firsts = joined.where("root is not null").groupBy("root").agg(F.min("first").alias("component"))
    return attach(joined, firsts, ["root"]).select(
        "fp", "first", F.coalesce("component", "first").alias("component")
    )


def simhash_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3,
    chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row."""
    fps = settle(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    found = classes(fps, max_bits=max_bits, chunk=chunk).select("fp", F.col("component.doc_id").alias("component_id"))
    return attach(fps, found, ["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3,
) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id. Columns unchanged; texts move once."""
    fps = settle(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    chosen = classes(fps, max_bits=max_bits).where("first = component").select(
        F.xxhash64(F.col("first.doc_id").isNull(), F.col("first.doc_id")).alias("_key"), F.col("first.tie").alias("_tie")
    )
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.xxhash64(F.col(id_col).cast("long").isNull(), F.col(id_col).cast("long")).alias("_key"),
        F.xxhash64(F.col(text_col).isNull(), F.col(text_col)).alias("_tie"),
    )
    # Rows that repeat the same id and text are copies of one another too.
    return keyed.join(chosen, ["_key", "_tie"], "left_semi").dropDuplicates(["_key", "_tie"]).select("_row.*")
