"""Spelling variants by finite-state composition: words that differ by one code point, and the usual form of each.

1. Spark counts the words of all texts (``vocabulary``); only words and counts go on.
2. Every word is dealt to partitions of the composed machine by the part that it has in common with its neighbours: words
   that differ by one code point have the first half of the shorter one in common, or the rest of it. The state after
   that part is the initial state of the partition. A word of length c goes by its own halves and, as the longer word of
   a pair, by the halves of a word of length c - 1. Partitions above ``GROUP_WORDS`` words are cut again in the same way
   at what is left of the words, so no task gets an unbounded one, and no pair is lost or found twice.
3. Each partition compiles the rests of its words into minimal acyclic acceptors (equal endings are one state), composes
   them with a one-edit transducer (a replaced or an inserted code point) and with the acceptor again, and enumerates the
   accepted pairs. Only a sum and a best neighbour per word leave it.
4. The form of a word is its neighbour of largest count (ties: the smallest in code-point order) where that has ``ratio``
   times the word's count; roots follow by doubling steps, as many as the logarithm of a chain of growing counts needs.

Null and empty texts have no words. Words are told apart by their text only, so repeated rows add to the counts. A null id
counts as an empty one in the edit of ``vocabulary``. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import attach, let
from paneloom.operators.spread import settle, slices_of

#: A word before it is lower-cased (A-Z only).
RUN = r"[A-Za-zÀ-ÿ]+"

#: Words of a partition that are composed in one go.
GROUP_WORDS = 4096


def vocabulary(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2,
    drop_one_in: int | None = None,
) -> DataFrame:
    """(word, n): the words of all texts with at least ``shortest`` code points and ``least`` occurrences.

    With ``drop_one_in``, a word whose crc32 with its row's id is divisible by it loses one code point first.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(RUN), F.lit(0))
    long = F.filter(runs, lambda r: F.length(r) >= shortest)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    words = docs.select(name.alias("_name"), F.explode(long).alias("_run")).select(
        "_name", F.translate("_run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word")
    )
    if drop_one_in is not None:
        words = words.withColumn("_h", F.crc32(F.concat("_name", F.lit(":"), "word").cast("binary")))
        at = (F.col("_h") % F.length("word")).cast("int")
        dropped = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("_h") % drop_one_in == 0, dropped).otherwise(F.col("word")).alias("word"))
        words = words.where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def entries(words: DataFrame) -> DataFrame:
    """Each word as a shorter (or equal) one of a pair and as the longer one; ``size`` is the shorter one's length."""
    length = F.length("word")
    as_longer = F.array(F.lit(False), F.lit(True))
    return words.select("word", "n", F.explode(as_longer).alias("longer")).select(
        F.when(F.col("longer"), length - 1).otherwise(length).alias("size"), "longer", F.lit(False).alias("skip"),
        F.col("word").alias("rest"), F.lit("").alias("key"), "word", "n",
    ).where("size > 0")


def cut(rows: DataFrame) -> DataFrame:
    """Entries by the first half of what is left and by the rest of it.

    ``skip`` marks partitions in which pairs that differ by a code point at the very end of the rest do not count: they
    have the first half in common and are found there.
    """
    half = F.floor(F.col("size") / 2).cast("int")
    back = F.col("size") - half

    def child(mark: str, common: Column, rest: Column, size: Column, skip: Column) -> Column:
        key = F.concat("key", F.lit(mark), size.cast("string"), F.lit("."), common)
        return F.struct(key.alias("key"), rest.alias("rest"), size.alias("size"), skip.alias("skip"))

    total = F.length("rest")
    first = child(">", F.substring("rest", F.lit(1), half), F.substring("rest", half + 1, total), back, F.col("skip"))
    second = child(
        "<", F.substring("rest", total - back + 1, back), F.substring("rest", F.lit(1), total - back), half, F.lit(True)
    )
    # A rest of one code point has an empty first half: its second part would only hold insertions before it.
    halves = F.array(first, second)
    return rows.select("word", "n", "longer", F.explode(halves).alias("_c")).select(
        "_c.size", "longer", "_c.skip", "_c.rest", "_c.key", "word", "n"
    )


class Acceptor:
    """The minimal acyclic acceptor of sorted words of one length: ``arcs[state]`` leads to states by code point."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        known: dict[tuple, int] = {}
        path: list[dict[str, int]] = [{}]
        last = ""
        for word in [*words, ""]:
            shared = 0
            if word:
                while shared < len(last) and word[shared] == last[shared]:
                    shared += 1
            while len(path) > shared + 1:
                own = path.pop()
                key = tuple(own.items())
                if key not in known:
                    known[key] = len(self.arcs)
                    self.arcs.append(own)
                path[-1][last[len(path) - 1]] = known[key]
            path.extend({} for _ in range(len(word) - shared))
            last = word
        self.start = len(self.arcs)
        self.arcs.append(path[0])


def common(a: Acceptor, s: int, b: Acceptor, t: int, but: str | None = None) -> Iterator[str]:
    """What both acceptors accept from the two states on, but for words that begin with ``but``."""
    left, right = a.arcs, b.arcs
    stack = [(s, t, "")]
    while stack:
        s, t, text = stack.pop()
        own, other = left[s], right[t]
        if not own:
            if not other:
                yield text
            continue
        for c in own.keys() & other.keys():
            if text or c != but:
                stack.append((own[c], other[c], text + c))


def replaced(a: Acceptor) -> Iterator[tuple[str, str]]:
    """Unordered pairs of accepted words that differ by one replaced code point."""
    stack = [(a.start, "")]
    while stack:
        state, text = stack.pop()
        arcs = list(a.arcs[state].items())
        for i, (c, s) in enumerate(arcs):
            stack.append((s, text + c))
            for d, t in arcs[:i]:
                for rest in common(a, s, a, t):
                    yield f"{text}{c}{rest}", f"{text}{d}{rest}"


def inserted(a: Acceptor, b: Acceptor) -> Iterator[tuple[str, str]]:
    """(x, y) of words x of ``a`` and y of ``b`` where y is x and one more code point.

    Of a run of equal code points the last one counts as the inserted one, so each pair comes once.
    """
    stack = [(a.start, b.start, "")]
    while stack:
        s, t, text = stack.pop()
        own = a.arcs[s]
        for c, u in b.arcs[t].items():
            for rest in common(a, s, b, u, but=c):
                yield f"{text}{rest}", f"{text}{c}{rest}"
            if c in own:
                stack.append((own[c], u, text + c))


def near_pairs(short: list[str], long: list[str], skip: bool) -> Iterator[tuple[bool, str, str]]:
    """(whether the second is a longer word, first, second) of the pairs among the rests of one partition."""
    if not short:
        return
    a = Acceptor(sorted(short))
    if len(short) > 1:
        for x, y in replaced(a):
            yield False, x, y
    if long:
        for x, y in inserted(a, Acceptor(sorted(long))):
            if not (skip and y[:-1] == x):
                yield True, x, y


def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best): sums over the partitions, which come one after the other."""
    key, skip, sides = None, False, ({}, {})
    out: dict[str, list] = {}

    def meet(word: tuple[str, int], other: tuple[str, int]) -> None:
        found = out.get(word[0])
        if found is None:
            out[word[0]] = [1, -other[1], other[0]]
        else:
            found[0] += 1
            if (-other[1], other[0]) < (found[1], found[2]):
                found[1], found[2] = -other[1], other[0]

    def finish() -> None:
        for longer, x, y in near_pairs(list(sides[0]), list(sides[1]), skip):
            a, b = sides[0][x], sides[longer][y]
            meet(a, b)
            meet(b, a)

    def flush() -> pa.RecordBatch:
        rows = list(out.values())
        columns = [
            pa.array(list(out), pa.string()), pa.array([r[0] for r in rows], pa.int64()),
            pa.array([-r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()),
        ]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])

    for batch in batches:
        for k, s, longer, rest, word, n in zip(*[c.to_pylist() for c in batch.columns]):
            if k != key:
                if len(sides[0]) + len(sides[1]) > 1:
                    finish()
                key, skip, sides = k, s, ({}, {})
            sides[longer][rest] = (word, n)
        if len(out) >= 10_000:
            yield flush()
    finish()
    yield flush()


def neighbours(words: DataFrame, *, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best_n, best): partial counts of near words, and the most frequent near word, of (word, n)."""
    found, rows = [], cut(entries(words))
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("size").alias("_size"))
        # A rest of one code point cannot be cut again; such a partition has as many words as the alphabet allows.
        large = settle(sizes.where((F.col("_n") > group_words) & (F.col("_size") > 1)).select("key"))
        last = large.isEmpty()
        small = rows if last else attach(rows, large.withColumn("_large", F.lit(True)), ["key"]).where("_large is null")
        dealt = small.select("key", "skip", "longer", "rest", "word", "n").repartition(slices_of(words), "key")
        found.append(dealt.sortWithinPartitions("key").mapInArrow(
            compose, "word string, n_near long, best_n long, best string"
        ))
        if last:
            break
        rows = cut(settle(attach(rows, large, ["key"], "left_semi")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form that a word leads to, by steps of doubling length."""
    known = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = settle(attach(known, further, ["root"]))
        if joined.where("_next is not null").isEmpty():
            return known
        known = joined.select("word", F.coalesce("_next", "root").alias("root"))


def spelling_variants(words: DataFrame, *, ratio: int = 10, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n)."""
    words = settle(words.select("word", "n"))
    none = F.lit(None)
    near = neighbours(words, group_words=group_words).select(
        "word", none.cast("long").alias("n"), "n_near",
        F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")).alias("best"),
    )
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("struct<less:long,form:string>").alias("best"))
    merged = own.unionByName(near).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best")
    )
    usual = -F.col("best.less") >= F.col("n") * ratio
    judged = settle(merged.select(
        "word", F.when(usual, F.col("best.form")).alias("form"), "n", "n_near", F.when(usual, -F.col("best.less")).alias("form_n")
    ))
    return attach(judged, roots(judged.where("form is not null")), ["word"]).select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
