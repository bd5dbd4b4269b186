"""Document fingerprints by SpotSigs: chains of content words behind common words (built-in functions only).

Each common word (an anchor) together with the next ``CHAIN`` words that are no anchors, within ``REACH`` words, is a
signature; the fingerprint is the set of a text's signatures as sorted 32-bit hashes. Words are runs of letters and
digits in lower case. A text without any signature (too short, another language, no words) has one signature for all of
it, so that equal texts always have equal fingerprints. The empty text is such a text.

Likeness is the Jaccard similarity of two sets, pruned by their lengths: it cannot exceed the shorter over the longer.
:func:`similar` finds all rows that are like a given set of queries: sets are partitioned into bands of length, so that
only neighbouring bands can hold matches, and meet through the first signatures of each set; then each pair is verified.

:func:`compare_with_next` compares every text with an edited copy and with the next text in falling order of ids. Rows
are dealt by ranges of the order and meet their successors inside a range; the first row of a range also visits the
range before it, so the texts move once and no window spans the table. Equal ids are ordered by a hash of the text, null
ids come last; a null text is an empty one; repeated rows each get a row and follow each other; a single row is its own
successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.common import let
from paneloom.operators.spread import settle, slices_of

#: Common words of four languages: fixed values.
ANCHORS = (
    "the of and to in is that it on for was with be as by this are at or from an not have has "
    "de la le les des du un une et en que qui est pour dans au sur par pas ou "
    "der die das und zu den mit von für auf ist ein eine im nicht sich dem es "
    "el los las del se con su por al lo para como"
).split()

CHAIN, REACH = 3, 10

#: Ranges for each shuffle partition, so that partitions are even although ranges are drawn at random.
RANGES = 8


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN, reach: int = REACH) -> Column:
    """The sorted distinct signature hashes (32 bits each, as longs) of a text that is not null."""
    def chains(words: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            def behind(rest: Column) -> Column:
                return F.when(F.size(rest) == chain, F.xxhash64(word, rest))

            content = F.filter(F.slice(words, i + 2, reach), lambda w: ~w.isin(anchors))
            return F.when(word.isin(anchors), let(F.slice(content, 1, chain), behind))

        return F.array_compact(F.transform(words, one))

    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    found = let(F.array_remove(F.split(plain, " "), ""), chains)
    short = F.transform(found, lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))
    return let(F.sort_array(F.array_distinct(short)), lambda s: F.when(F.size(s) > 0, s).otherwise(
        F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)))
    ))


def printed(sigs: Column) -> Column:
    """A fingerprint as a string: eight hex digits for each signature."""
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without a look at them when their lengths rule out ``floor``."""
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = let(F.size(F.array_intersect(a, b)), lambda n: n / (shorter + longer - n))
    return F.when(shorter >= longer * F.lit(floor), exact).otherwise(F.lit(0.0))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, signatures, fingerprint) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = rows.select("doc_id", signatures(F.col("text")).alias("signatures"))
    return sets.withColumn("fingerprint", printed(F.col("signatures")))


def similar(queries: DataFrame, rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(query, doc_id, likeness) of all pairs of tables (doc_id, signatures) at or above ``threshold``.

    Equal sets are merged for the search: a pair of sets is compared once, whatever number of rows has them.
    """
    left, right = (settle(df.select("doc_id", F.xxhash64("signatures").alias("_key"), "signatures")) for df in (queries, rows))
    pairs = similar_sets(left, right, threshold)
    found = pairs.join(left.select(F.col("_key").alias("_left"), F.col("doc_id").alias("query")), "_left")
    return found.join(right.select(F.col("_key").alias("_right"), "doc_id"), "_right").select("query", "doc_id", "likeness")


def similar_sets(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(_left, _right, likeness) of all pairs of distinct sets of tables (_key, signatures) at or above ``threshold``.

    Two sets that alike share one of the first ``n - ceil(threshold x n) + 1`` of their n sorted signatures, and their
    lengths differ by the factor ``threshold`` at most, so their bands are neighbours.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    width = -math.log(threshold) or 1.0

    def keyed(df: DataFrame, name: str, around: bool) -> DataFrame:
        n = F.size("signatures")
        band = F.floor(F.log(n.cast("double")) / width + 1e-9)
        first = F.slice("signatures", 1, (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int"))
        bands = F.array(band - 1, band, band + 1) if around else F.array(band)
        return df.groupBy("_key").agg(F.first("signatures").alias("signatures")).select(
            F.col("_key").alias(name), F.col("signatures").alias(f"{name}_set"), F.explode(first).alias("_sig"),
            bands.alias("_bands"),
        ).withColumn("_band", F.explode("_bands")).drop("_bands")

    pairs = keyed(left, "_left", True).join(keyed(right, "_right", False), ["_sig", "_band"])
    # A pair meets once for each shared first signature; only its smallest one counts.
    verified = pairs.where(F.col("_sig") == F.array_min(F.array_intersect("_left_set", "_right_set")))
    return verified.select(
        "_left", "_right", likeness(F.col("_left_set"), F.col("_right_set"), threshold).alias("likeness"),
    ).where(F.col("likeness") >= threshold - 1e-12)


def literal(values: list[int]) -> Column:
    """A constant array of longs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, value: Column, out: str, *, id_col: str = "doc_id", text_col: str = "text",
              ranges: int | None = None) -> DataFrame:
    """(doc_id, text, ``value`` as ``out``, next_text, next_``out``) of every row in falling order of ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({
        "_id": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), "_hash": F.xxhash64("text"),
    })
    keys = settle(rows.select("_id", "_hash"))
    total, top = keys.agg(F.count(F.lit(1)), F.max(F.struct("_id", "_hash"))).first()
    ranges = ranges or RANGES * slices_of(docs)
    drawn = F.pmod(F.xxhash64("_id", "_hash", F.lit(5)), F.lit(1 << 40)) < F.lit((1 << 40) * ranges // max(1, total))
    # Of all distinct rows about as many as ranges are wanted reach the driver: each begins a range.
    begun = {tuple(r) for r in keys.where(drawn).distinct().collect()} | {tuple(top) if top else (0, 0)}
    heads = sorted(begun, reverse=True)
    ids, hashes = literal([h[0] for h in heads]), literal([h[1] for h in heads])
    step = max(1, math.isqrt(len(heads)))

    def upto(i: Column) -> Column:
        """Whether range ``i`` begins at or before the row."""
        head = F.get(ids, i)
        return (head > F.col("_id")) | ((head == F.col("_id")) & (F.get(hashes, i) >= F.col("_hash")))

    coarse = F.size(F.filter(F.sequence(F.lit(0), F.lit(len(heads) - 1), F.lit(step)), upto)) - 1
    fine = F.sequence(F.lit(0), F.lit(step - 1))
    at = let(coarse * step, lambda base: base + F.size(F.filter(fine, lambda i: F.coalesce(upto(base + i), F.lit(False)))) - 1)
    placed = rows.withColumn("_range", at)
    begins = (F.get(ids, F.col("_range")) == F.col("_id")) & (F.get(hashes, F.col("_range")) == F.col("_hash"))
    home = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    visit = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(heads))).alias("range"), F.lit(True).alias("guest"))
    dealt = placed.select(
        "doc_id", "text", "_id", "_hash", F.explode(F.when(begins, F.array(home, visit)).otherwise(F.array(home))).alias("_at")
    ).select("*", F.col("_at.range").alias("_in"), F.col("_at.guest").alias("_guest")).drop("_at").repartition("_in")
    order = Window.partitionBy("_in").orderBy("_guest", F.desc("_id"), F.desc("_hash"))
    valued = dealt.withColumn(out, value)
    return valued.select(
        "doc_id", "text", out, "_guest", F.lead("text").over(order).alias("next_text"),
        F.lead(out).over(order).alias(f"next_{out}"),
    ).where(~F.col("_guest")).drop("_guest")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by as many first ones of ``following`` (or all of it)."""
    n = F.length(text)
    tail = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - tail), F.substring(following, F.lit(1), tail))


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      ranges: int | None = None) -> DataFrame:
    """(doc_id, text, edited_text, signatures, edited_signatures, near_edited, near_next) of every row."""
    pairs = with_next(
        docs, signatures(F.col("text")), "signatures", id_col=id_col, text_col=text_col, ranges=ranges
    )
    both = pairs.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    both = both.withColumn("edited_signatures", signatures(F.col("edited_text")))
    own = F.col("signatures")
    return both.select(
        "doc_id", "text", "edited_text", "signatures", "edited_signatures",
        likeness(own, F.col("edited_signatures")).alias("near_edited"),
        likeness(own, F.col("next_signatures")).alias("near_next"),
    )
