"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; a document's expected number of copies is its source's target over its
source's size, the same for all documents of a source. Whole copies are taken at once; what is left is a probability.
Two documents meet, and a random amount of mass moves from one probability to the other so that the expected words
(size times probability) of the pair stay the same, until one probability is 0 or 1. The one left open meets the next.
Documents are dealt into blocks of bounded size for this; each block leaves one open document per source, these are the
documents of the next level, and so on: a reduction tree. A source's total is kept exactly all along, and only its very
last document is rounded, to the nearer side, so a source misses its target by half of one document at most.

Within a block larger documents meet first: the one that stays open then tends to be small. On the last level, which
decides by how much a source misses its target, up to ``DRAWS`` draws are made, in different orders, and the one that
misses least is taken. All other levels have one draw. At most ``LAST_BLOCKS`` documents of a source reach the last
level, whatever the source's size.

Rows that repeat the same id, source and text share one decision (their sizes add up). Null sources form one source,
last in order; null, empty and blank texts have size 0 and are kept or not by a hash of their own. Random numbers are
seeded by block and level, so reruns agree. An empty table gives an empty result. Other columns are ignored, or kept
as they are by :func:`materialise`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import WORD, non_null_key
from paneloom.operators.spread import attach, running_total, settle

#: Documents that one task rounds at most, on average, and open documents that meet on the next level.
BLOCK_ROWS = 4096

#: Blocks of a source that are left before the last level, at every size: it has so many open documents at most.
LAST_BLOCKS = 64

#: Draws of the last level, and the share of the words at stake that a draw may miss without another one.
DRAWS, NEAR = 48, 0.001

#: Closer than this to 0 or 1 counts as whole.
TINY = 1e-9


def pivot_chain(sizes: Sequence[int], chances: Sequence[float], rng: np.random.Generator) -> list[float]:
    """Round all but at most one of ``chances`` to 0 or 1, keeping the sum of size x chance.

    When documents ``a`` and ``b`` meet, either ``up`` words move from ``b`` to ``a`` or ``down`` words the other way,
    with the chances that keep both expectations.
    """
    out = list(chances)
    draws = rng.random(len(out))
    open_at = -1
    for i, chance in enumerate(out):
        if chance <= TINY or chance >= 1 - TINY:
            out[i] = float(round(chance))
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = open_at, i
        up = min((1 - out[a]) * sizes[a], out[b] * sizes[b])
        down = min(out[a] * sizes[a], (1 - out[b]) * sizes[b])
        moved = up if draws[i] * (up + down) < down else -down
        out[a] += moved / sizes[a]
        out[b] -= moved / sizes[b]
        still = [k for k in (a, b) if TINY < out[k] < 1 - TINY]
        for k in (a, b):
            if k not in still:
                out[k] = float(round(out[k]))
        open_at = still[0] if still else -1
    return out


def best_draw(
    sizes: Sequence[int], chances: Sequence[float], seed: Sequence[int], draws: int
) -> list[float]:
    """The chain, or on a last level the draw whose rounded outcome is nearest to what was expected."""
    if draws == 1:
        return pivot_chain(sizes, chances, np.random.default_rng(seed))
    weights, at_stake = np.array(sizes, dtype=float), float(np.dot(sizes, chances))
    best, least = list(chances), math.inf
    for draw in range(draws):
        rng = np.random.default_rng([*seed, draw])
        order = rng.permutation(len(weights)) if draw else np.arange(len(weights))
        out = np.empty(len(weights))
        out[order] = pivot_chain(weights[order].tolist(), np.array(chances)[order].tolist(), rng)
        missed = abs(float(weights @ np.floor(out + 0.5)) - at_stake)
        if missed < least:
            best, least = np.floor(out + 0.5).tolist(), missed
        if least <= NEAR * at_stake:
            break
    return best


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source_key, source_size, target) from one row (source_key, source, source_size) per source.

    The sources take the weights in turn, by code point, null last. Together they get ``share`` of all words; a source
    gets ``most`` times its size at most, and what it cannot take is shared again by weight among the others. Only
    sums reach the driver.
    """
    if not weights or min(weights) <= 0 or share > most:
        raise ValueError("weights must be positive and share at most most")
    order = [F.col("source").isNull(), F.col("source")]
    ranked = running_total(
        sizes.select("source_key", "source", "source_size", F.col("source").isNull().alias("_none")),
        [], order, F.lit(1).cast("long"), "place",
    )
    turn = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
    ranked = settle(ranked.select(
        "source_key", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight")
    ))
    size, weight = F.col("source_size"), F.col("weight")
    total = ranked.agg(F.sum(size)).first()[0] or 0
    full, level = None, 0.0
    while True:
        capped = F.lit(False) if full is None else size * most <= weight * full
        row = ranked.agg(
            F.sum(F.when(capped, size)).alias("taken"), F.sum(F.when(~capped, weight)).alias("open")
        ).first()
        level = (share * total - most * (row["taken"] or 0)) / row["open"] if row["open"] else math.inf
        if full is not None and level <= full or math.isinf(level):
            break
        full = level
    target = size * most if math.isinf(level) else F.least(size * most, weight * level)
    return ranked.select("source_key", "source_size", target.cast("double").alias("target"))


def round_copies(units: DataFrame, *, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``copies`` (whole) to units (source_key, key, size > 0, expected), keeping each source's expected words."""
    fields = "source_key string, key long, tie long, size long, whole long, chance double, block long, blocks long"

    def fewer(count: Column) -> Column:
        return F.greatest(F.ceil(count / F.lit(float(block_rows))), F.lit(LAST_BLOCKS)).cast("long")

    units = units.select(
        "source_key", "key", "tie", "size", F.floor("expected").cast("long").alias("whole"),
        (F.col("expected") - F.floor("expected")).alias("chance"),
    )

    def meet(depth: int, draws: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "key", "tie"], ascending=[False, True, True], kind="stable")
            name = f"{pdf['source_key'].iat[0]}\0{pdf['block'].iat[0]}\0{depth}".encode()
            return pdf.assign(chance=best_draw(pdf["size"].tolist(), pdf["chance"].tolist(), [seed, *name], draws))

        return one

    counts = units.groupBy("source_key").agg(F.count(F.lit(1)).alias("_n"))
    todo = attach(units, counts, ["source_key"]).withColumn("blocks", fewer(F.col("_n"))).withColumn(
        "block", F.pmod(F.xxhash64("key", "tie"), F.col("blocks"))
    ).drop("_n")
    done, depth = [], 0
    while True:
        todo = settle(todo)
        met = settle(todo.groupBy("source_key", "block").applyInPandas(meet(depth, 1), fields))
        still = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(met.where(~still))
        todo = met.where(still)
        if not todo.where(F.col("blocks") > LAST_BLOCKS).limit(1).count():
            break
        # Neighbouring blocks meet; a source with few of them stays as it is.
        todo = todo.withColumn("_blocks", fewer(F.col("blocks"))).withColumn(
            "block", F.floor(F.col("block") * F.col("_blocks") / F.col("blocks")).cast("long")
        ).withColumn("blocks", F.col("_blocks")).drop("_blocks")
        depth += 1
    final = settle(todo.withColumn("block", F.lit(0).cast("long")))
    done.append(settle(final.groupBy("source_key", "block").applyInPandas(meet(-1, DRAWS), fields)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("copies", (F.col("whole") + F.col("chance")).cast("long"))


def decisions(
    docs: DataFrame, *, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float,
    most: float, seed: int, block_rows: int,
) -> tuple[DataFrame, DataFrame]:
    """The rows' keys and sizes, and (source_key, key, tie) -> source_size, target, copies."""
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col)).alias("key")
    rows = settle(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        non_null_key(F.col(source_col)).alias("source_key"), key, tie_of(text_col).alias("tie"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    ))
    sizes = rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(settle(sizes), weights, share, most))
    units = rows.groupBy("source_key", "key", "tie").agg(F.sum("size").alias("size"))
    rate = F.try_divide(F.col("target"), F.col("source_size"))
    expected = attach(units, targets, ["source_key"]).withColumn("expected", F.coalesce(rate, F.lit(0.0)))
    expected = settle(expected)
    rounded = round_copies(expected.where("size > 0"), seed=seed, block_rows=block_rows)
    own = F.pmod(F.xxhash64("key", "tie", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    blank = expected.where("size = 0").withColumn("copies", F.floor(F.col("expected") + own).cast("long"))
    columns = ["source_key", "key", "tie", "copies"]
    return rows, attach(
        rounded.select(*columns).unionByName(blank.select(*columns)), targets, ["source_key"]
    )


def tie_of(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col), F.lit(1))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row; no text is shuffled."""
    rows, decided = decisions(
        docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, share=share, most=most,
        seed=seed, block_rows=block_rows,
    )
    return rows.join(decided, ["source_key", "key", "tie"]).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def materialise(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say, columns unchanged. Texts move once."""
    _, decided = decisions(
        docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, share=share, most=most,
        seed=seed, block_rows=block_rows,
    )
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        non_null_key(F.col(source_col)).alias("source_key"),
        F.xxhash64(F.col(id_col).isNull(), F.col(id_col)).alias("key"), tie_of(text_col).alias("tie"),
    )
    chosen = decided.where("copies > 0").select("source_key", "key", "tie", "copies")
    joined = keyed.join(chosen, ["source_key", "key", "tie"])
    return joined.select(
        "_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    ).select("_row.*")
