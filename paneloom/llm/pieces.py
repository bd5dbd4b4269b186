"""Encoding and decoding with a SentencePiece model, by a table of distinct chunks.

In a model whose pieces never hold a white-space marker after another character (``chunkable`` checks this), no piece
crosses from one marked word into the next, so a text's ids are the ids of its chunks in order: each chunk is a run of
markers and the characters up to the next one. Each task keeps a table of the distinct chunks that it has met: a chunk
is segmented by the library once, and its ids and its decoded text are joined back to every position that holds it. The
table is bounded; a chunk that falls out is segmented again. A table for the whole corpus would need all word positions
shuffled twice, with a third of them under a few frequent words; the task's own table meets those words first.

The model travels as bytes, so executors need no file. Any other model is applied to whole texts instead.

A null text is an empty one: its ids are only the begin and end ids. Rows keep their own result when ids repeat; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import small_batches

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")

#: Chunks in a task's table, and code points of the longest one that is kept there.
TABLE_CHUNKS, TABLE_LENGTH = 200_000, 64


def read_model(path: str) -> bytes:
    """A model file's bytes (a tokenizer's vocabulary, of fixed size)."""
    with open(path, "rb") as f:
        return f.read()


class Chunks:
    """A model with its table of distinct chunks."""

    def __init__(self, model: bytes, *, kept: int = TABLE_CHUNKS):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.kept = kept
        self.table: dict[str, tuple[bytes, str]] = {}
        self.whole = not self.chunkable()

    def chunkable(self) -> bool:
        """Whether texts can be cut before every run of markers without changing their ids."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        rule = proto.normalizer_spec
        plain = rule.name == "identity" and not rule.precompiled_charsmap and rule.escape_whitespaces
        usual = rule.add_dummy_prefix and not rule.remove_extra_whitespaces
        own = any(p.type == p.USER_DEFINED for p in proto.pieces)
        crossing = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)
        return bool(plain and usual and not own and not crossing and not proto.trainer_spec.treat_whitespace_as_suffix)

    def _segment(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of chunks; the library itself puts the first marker before each."""
        lone = self.library.piece_to_id(MARK)
        ids = [i if c != MARK else [lone] for c, i in zip(chunks, self.library.encode([c[1:] for c in chunks]))]
        return [(packed(i), " " + t) for i, t in zip(ids, self.library.decode(ids))]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers with begin and end, decoded text) of each text."""
        begin, end = packed([self.library.bos_id()]), packed([self.library.eos_id()])
        if self.whole:
            ids = self.library.encode(texts)
            return [(begin + packed(i) + end, t) for i, t in zip(ids, self.library.decode(ids))]
        cut = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.table
        new = list({c for chunks in cut for c in chunks if c not in known})
        if len(known) + len(new) > self.kept:
            known = self.table = {}
            new = list({c for chunks in cut for c in chunks})
        known |= zip(new, self._segment(new)) if new else ()
        out = []
        for chunks in cut:
            found = [known[c] for c in chunks]
            out.append((begin + b"".join([f[0] for f in found]) + end, "".join([f[1] for f in found])[1:]))
        if len(known) > self.kept:
            self.table = {}
        else:
            for c in new:
                if len(c) > TABLE_LENGTH:
                    del known[c]
        return out


def packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def encode_texts(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string) of every row, without any shuffle."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(sent.value)
        for batch in batches:
            done = chunks.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, ids binary, decoded string")


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
