"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

1. Spark counts the words of all texts; the most frequent ones, ``LEXICON_WORDS`` at most, go to the driver.
2. They are compiled into a minimal acyclic automaton over their bytes: equal suffixes are stored once. Each arc says how
   many accepted words come before it, so the outputs along a word's path add up to its number, which finds its ids.
3. The automaton travels as bytes of a few MB; each Python worker maps them from an unlinked file of its own and reads
   only the pages that it needs.
4. A task cuts texts at special tokens and white space and cuts each distinct chunk into words as the tokeniser does. All
   distinct words of a batch's new chunks walk through the automaton at once; words that the lexicon lacks go through
   the tokeniser's own merges, which gives the same ids. Ids are joined back by position; a bounded table keeps the chunks already met.

Which words are in the lexicon changes the speed only, never an id. Tokenisers of another build than the one described
in ``cuttable`` are applied to whole texts by the library. Decoding is the tokens joined by blanks where the tokeniser has
no decoder.

A null or empty text has no ids and decodes to an empty text. Repeated rows each keep their result; null ids stay; an
empty table gives an empty result (and an empty lexicon); other columns are ignored.
"""

from __future__ import annotations

import json
import mmap
import re
import struct
import tempfile
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import small_batches
from paneloom.operators.spread import settle

#: Words that are compiled at most, and bytes of the longest of them.
LEXICON_WORDS, LONGEST = 131_072, 64

#: What the tokeniser's white-space rule matches (fixed values: the Unicode property White_Space).
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[^{WHITE}]+")

#: How the words of a chunk are told apart after the endings, and what those branches are by themselves.
BRANCHES = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Below this code point all characters are composed, and their classes are the same in every version of Unicode.
NEAR = 0x250
FAR = re.compile("[\u0130\u0250-\U0010ffff]").search

#: Chunks in a task's table, and code points of the longest one that is kept there.
TABLE_CHUNKS, TABLE_LENGTH = 400_000, 64

#: Steps of a histogram of counts for each factor of e: some thousand for any corpus.
STEPS = 100

#: The JVM's approximation of the pre-tokeniser, for counting only.
COUNTED = r"\p{L}+|[^\s\p{L}\p{N}]+"

#: Sections of a compiled lexicon: arc keys, targets and outputs, then which states accept, then the ids of each word.
SECTIONS = [("keys", "<i8"), ("targets", "<i4"), ("outputs", "<i4"), ("accepts", "u1"), ("offsets", "<i4"), ("ids", "<u4")]


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The minimal automaton of the words, with their ids, as one block of bytes; the root is the last state."""
    entries = sorted(entries)
    arcs: list[dict[int, int]] = []
    accepts: list[bool] = []
    counts: list[int] = []
    known: dict[tuple, int] = {}
    path: list[tuple[dict[int, int], list[bool]]] = [({}, [False])]

    def close(last: bytes, depth: int) -> None:
        """Replace the open states below ``depth`` by closed ones, equal ones by the same."""
        while len(path) > depth + 1:
            own, final = path.pop()
            key = (final[0], *own.items())
            if key not in known:
                known[key] = len(arcs)
                arcs.append(own)
                accepts.append(final[0])
                counts.append(final[0] + sum(counts[t] for t in own.values()))
            path[-1][0][last[len(path) - 1]] = known[key]

    last = b""
    for word, _ in entries:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(last, shared)
        path.extend(({}, [False]) for _ in word[shared:])
        path[-1][1][0] = True
        last = word
    close(last, 0)
    arcs.append(path[0][0])
    accepts.append(path[0][1][0])
    keys, targets, outputs = [], [], []
    for state, own in enumerate(arcs):
        before = int(accepts[state])
        for label, target in own.items():  # labels ascend, as the words do
            keys.append(state << 8 | label)
            targets.append(target)
            outputs.append(before)
            before += counts[target]
    parts = {
        "keys": keys, "targets": targets, "outputs": outputs, "accepts": accepts,
        "offsets": np.cumsum([0] + [len(ids) for _, ids in entries]), "ids": [i for _, ids in entries for i in ids],
    }
    blocks = [np.asarray(parts[name]).astype(kind).tobytes() for name, kind in SECTIONS]
    head = np.array([len(b) for b in blocks], dtype="<i8").tobytes()
    return head + b"".join(b + bytes(-len(b) % 8) for b in blocks)


class Lexicon:
    """A compiled lexicon, mapped from a file without a name."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(compiled)
            file.flush()
            self.mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.mapped, "<i8", len(SECTIONS))
        at = sizes.nbytes
        for (name, kind), size in zip(SECTIONS, sizes.tolist()):
            setattr(self, name, np.frombuffer(self.mapped, kind, size // np.dtype(kind).itemsize, at))
            at += size + -size % 8

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1: all words take one step at a time together."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        out = np.full(len(words), -1, dtype=np.int64)
        live = np.flatnonzero(lengths <= LONGEST)
        if not len(live) or not len(self.keys):
            return out
        letters = np.array([words[i] for i in live], dtype=f"S{LONGEST}").view(np.uint8).reshape(len(live), LONGEST)
        state = np.full(len(live), len(self.accepts) - 1, dtype=np.int64)
        total = np.zeros(len(live), dtype=np.int64)
        rows = np.arange(len(live))
        for step in range(LONGEST + 1):
            ends = lengths[live[rows]] == step
            done = rows[ends]
            done = done[self.accepts[state[done]] == 1]
            out[live[done]] = total[done]
            rows = rows[~ends]
            if not len(rows):
                break
            wanted = state[rows] << 8 | letters[rows, step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[at] == wanted
            rows, at = rows[found], at[found]
            total[rows] += self.outputs[at]
            state[rows] = self.targets[at]
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.offsets[number]:self.offsets[number + 1]].tolist()


class Encoder:
    """A tokeniser with a compiled lexicon."""

    def __init__(self, tokenizer: str, compiled: bytes = b"", *, kept: int = TABLE_CHUNKS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_str(tokenizer)
        self.library.no_truncation()
        self.library.no_padding()
        self.spec = json.loads(tokenizer)
        self.whole = not self.cuttable()
        if self.whole:
            return
        self.merge = self.library.model.tokenize
        self.lexicon = Lexicon(compiled) if compiled else None
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.tokens = {i: t for t, i in self.spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        near = [chr(c) for c in range(NEAR)]
        letters, digits = (re.escape("".join(c for c in near if unicodedata.category(c)[0] == k)) for k in "LN")
        endings = self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].removesuffix(BRANCHES)
        self.near_words = re.compile(f"{endings}|[{letters}]+|[{digits}]|[^{letters}{digits}]+").findall
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {ord(c): level.pre_tokenize_str(c)[0][0] for c in near}
        self.kept = kept
        self.ids_table: dict[str, bytes] = {}
        self.text_table: dict[str, str] = {}

    def cuttable(self) -> bool:
        """Whether a text's ids are those of its white-space separated chunks, each cut into words and merged."""
        spec, model = self.spec, self.spec["model"]
        normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        usual = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        words = len(cuts) == 2 and cuts[0]["type"] == "Split" and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed"
        # The pattern's last branch takes no white space, and the others are letters, digits and endings.
        words = words and re.fullmatch(r"('[a-z]+\|)*'[a-z]+" + re.escape(BRANCHES), cuts[0]["pattern"].get("Regex", ""))
        level = words and cuts[1] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False,
        }
        plain = all(
            not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"]
        )
        if not (normal == usual and level and plain and spec["decoder"] is None and model["type"] == "BPE"):
            return False
        simple = not (model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"])
        from tokenizers.pre_tokenizers import ByteLevel

        letters = ByteLevel.alphabet()
        return simple and all(c in model["vocab"] and c + (model["end_of_word_suffix"] or "") in model["vocab"] for c in letters)

    def words_of(self, chunk: str) -> list[str]:
        """The words of a chunk without white space, in the alphabet of the merges."""
        if chunk.isascii() or not FAR(chunk):  # composed already, and lower case goes letter by letter
            words = self.near_words(chunk.lower())
            return words if chunk.isascii() and chunk.isprintable() else [w.translate(self.level) for w in words]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def merged(self, word: str) -> list[int]:
        """Ids of a word by the tokeniser's own merges."""
        return [t.id for t in self.merge(word)]

    def word_ids(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of distinct words: from the lexicon, or merged."""
        if self.lexicon is None:
            yield from map(self.merged, words)
            return
        for word, number in zip(words, self.lexicon.numbers([w.encode() for w in words]).tolist()):
            yield self.merged(word) if number < 0 else self.lexicon.ids_of(number)

    def look_up(self, chunks: list[str]) -> None:
        """Put distinct chunks into the tables."""
        cut = {c: self.words_of(c) for c in chunks if c not in self.special}
        words = list({w for own in cut.values() for w in own})
        ids, texts = {}, {}
        for word, found in zip(words, self.word_ids(words)):
            ids[word] = packed(found)
            texts[word] = " ".join([self.tokens[i] for i in found])
        for c, own in cut.items():
            if len(own) == 1:
                self.ids_table[c], self.text_table[c] = ids[own[0]], texts[own[0]]
            else:
                self.ids_table[c] = b"".join([ids[w] for w in own])
                self.text_table[c] = " ".join([texts[w] for w in own])
        for c, i in self.special.items():
            self.ids_table[c], self.text_table[c] = packed([i]), c

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        if self.whole:
            ids = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
            decoded = self.library.decode_batch(ids, skip_special_tokens=False)
            return [(packed(i), d) for i, d in zip(ids, decoded)]
        placed = []
        for text in texts:
            chunks = []
            for part in self.cut.split(text) if self.cut else [text]:
                chunks += [part] if part in self.special else CHUNK.findall(part)
            placed.append(chunks)
        needed = set().union(*placed)
        new = [c for c in needed if c not in self.ids_table]
        if len(self.ids_table) + len(new) > self.kept:
            self.ids_table, self.text_table, new = {}, {}, list(needed)
        self.look_up(new)
        ids_of, text_of = self.ids_table.__getitem__, self.text_table.__getitem__
        out = [(b"".join(map(ids_of, chunks)), " ".join(map(text_of, chunks))) for chunks in placed]
        if len(self.ids_table) > self.kept:
            self.ids_table, self.text_table = {}, {}
        else:
            for c in new:
                if len(c) > TABLE_LENGTH:
                    del self.ids_table[c], self.text_table[c]
        return out


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def frequent_words(docs: DataFrame, *, text_col: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, ``most`` at most, counted by Spark.

    A histogram of the counts, on a scale of logarithms, gives the least count that few enough words reach; words
    below it stay in Spark.
    """
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(COUNTED), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.octet_length("word") <= LONGEST)
    step = F.floor(F.log("n") * STEPS).cast("int")
    counts = settle(counts.where("n > 1").select("word", step.alias("step")))
    least, held = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        least = r.step
    return [] if least is None else sorted(r.word for r in counts.where(F.col("step") >= least).collect())


def lexicon_of(encoder: Encoder, words: Iterable[str]) -> bytes:
    """The compiled lexicon of the words, as the tokeniser cuts them."""
    cut = {w for word in words for w in encoder.words_of(word)}
    return compile_lexicon((w.encode(), encoder.merged(w)) for w in cut if len(w.encode()) <= LONGEST)


def read_tokenizer(path: str) -> str:
    """A tokeniser file's text (a vocabulary, of fixed size)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", most: int = LEXICON_WORDS
) -> DataFrame:
    """(doc_id, ids binary, decoded string) of every row; the words are counted first, then no shuffle follows."""
    spark = docs.sparkSession
    small_batches(spark)
    encoder = Encoder(tokenizer)
    compiled = b"" if encoder.whole else lexicon_of(encoder, frequent_words(docs, text_col=text_col, most=most))
    sent = spark.sparkContext.broadcast((tokenizer, compiled))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or Encoder(*sent.value)
            done = own.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, ids binary, decoded string")
