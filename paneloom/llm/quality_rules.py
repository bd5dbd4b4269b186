"""Quality rules whose cutoffs are certified on labelled documents (built-in functions only).

Every document gets plain measures of its text. A fixed floor rejects very short and very repetitive texts; the other
rules compare a rate (symbols per word, share of repeated lines, ...) with a cutoff. The cutoffs are not guessed:
for each stratum (a language, say) and rule, a grid that is fixed in advance is tested on the documents labelled good.
With ``k`` of ``n`` good documents above a cutoff, the cutoff is certified when a binomial variable with the allowed
rate of false rejections would be ``k`` or less only with probability ``error / tests`` (the exact Clopper-Pearson
test, corrected for the number of strata x rules x cutoffs by Bonferroni). The strictest certified cutoff holds; a
rule without one rejects nothing in that stratum. The allowed rate is divided by the number of rules, so that with
probability ``1 - error`` all rules together wrongly reject at most ``false_rejection`` of any stratum's good documents.

Nulls and empty texts have no words and fall below the floor; a null stratum is a stratum of its own; a stratum without
labels has no cutoffs; repeated rows each get their own row; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import BLANKS, let, non_null_key, runs_of, words_of
from paneloom.operators.spread import attach, settle

#: Characters that count as symbols, as a regular expression.
SYMBOLS = "[#*$%&|<>]"

#: Share of a stratum's good documents that all rules together may reject, and the chance that they reject more.
FALSE_REJECTION, ERROR = 0.02, 0.05

#: Words in the windows whose repetition counts.
WINDOW = 8

#: Rates and the cutoffs tested for each, loosest last. They are fixed, so all labelled rows can serve as the holdout.
GRID = {
    "symbol_rate": [0.05, 0.1, 0.2, 0.4, 0.8],
    "dup_line_rate": [0.1, 0.2, 0.3, 0.5, 0.7],
    "repeat_rate": [0.05, 0.1, 0.15, 0.2, 0.25],
    "upper_rate": [0.1, 0.2, 0.3, 0.4, 0.6],
    "mark_rate": [0.05, 0.1, 0.2, 0.4, 0.8],
}


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more, the first one included.

    The windows are hashed and sorted inside the row, so a text of any length costs n log n.
    """
    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda s, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - s, F.lit(window)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def among(ranked: Column) -> Column:
        def twin(s: Column, i: Column) -> Column:
            return (F.get(ranked, i - 1)["w"].eqNullSafe(s["w"])) | (F.get(ranked, i + 1)["w"].eqNullSafe(s["w"]))

        return let(F.array_sort(F.transform(F.filter(ranked, twin), lambda s: s["at"])), covered)

    def count(found: Column) -> Column:
        placed = F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("at")))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(
            let(F.sort_array(placed), among)
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    enough = F.size(words) > window
    return F.when(enough, let(runs_of(hashes, window), count)).otherwise(F.lit(0)).cast("long")


def text_measures(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    carry: str | None = None,
) -> DataFrame:
    """(doc_id, stratum, counts, rates) of every row; one pass without any shuffle. ``carry`` names the whole row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(carry)] if carry else []
    base = docs.select(
        *whole,
        F.col(id_col).alias("doc_id"),
        non_null_key(F.col(stratum_col)).alias("stratum"),
        text.alias("text"),
        words_of(F.col(text_col)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
    )
    counted = base.select(
        *([carry] if carry else []),
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
    )
    def rate(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    return counted.withColumns({
        "symbol_rate": rate("n_symbols", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"),
        "mark_rate": rate("n_marks", "n_words"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k); 1 where ``k`` is at or above the mean, for no such count can certify anything."""
    odds = math.log(rate) - math.log1p(-rate)

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (state["total"] + F.exp(term)).alias("total"))

    first = (n * F.lit(math.log1p(-rate))).cast("double")
    start = F.struct(first.alias("term"), F.exp(first).alias("total"))
    upto = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.when(k >= n * F.lit(rate), F.lit(1.0)).otherwise(
        F.aggregate(upto, start, step, lambda state: state["total"])
    )


def certified_cutoffs(
    measures: DataFrame,
    labels: DataFrame,
    *,
    label_id: str = "doc_id",
    label_col: str = "quality",
    grid: dict[str, list[float]] = GRID,
    false_rejection: float = FALSE_REJECTION,
    error: float = ERROR,
) -> DataFrame:
    """One row per stratum with a column for each rule: its strictest certified cutoff, or null.

    ``measures`` holds a column for each rule of ``grid``; a document counts as good when all its labels are 1.
    """
    good = (
        labels.where(F.col(label_id).isNotNull())
        .groupBy(F.col(label_id).alias("doc_id")).agg(F.min(F.col(label_col)).alias("_good"))
        .where(F.col("_good") == 1).select("doc_id")
    )
    held = measures.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    above = {
        f"{rule}_{i}": F.count_if(F.col(rule) > cutoff)
        for rule, cutoffs in grid.items() for i, cutoff in enumerate(cutoffs)
    }
    counts = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("_n"), *[c.alias(f"_{name}") for name, c in above.items()]
    )
    strata = measures.select("stratum").distinct().count()
    level = error / max(1, strata * len(above))
    allowed = false_rejection / len(grid)

    def strictest(rule: str, cutoffs: list[float]) -> Column:
        return F.coalesce(*[
            F.when(binomial_tail(F.col(f"_{rule}_{i}"), F.col("_n"), allowed) <= level, F.lit(cutoff))
            for i, cutoff in sorted(enumerate(cutoffs), key=lambda x: x[1])
        ]).cast("double").alias(f"{rule}_cutoff")

    return counts.select("stratum", *[strictest(rule, cutoffs) for rule, cutoffs in grid.items()])


def judge(measures: DataFrame, cutoffs: DataFrame, grid: dict[str, list[float]] = GRID) -> DataFrame:
    """Adds ``kept``: above the floor and above no cutoff of the row's stratum."""
    over = [F.coalesce(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(False)) for rule in grid]
    kept = ~F.col("base_failed")
    for rejected in over:
        kept = kept & ~rejected
    return attach(measures, cutoffs, ["stratum"]).withColumn("kept", kept)


def quality_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    label_col: str = "quality", false_rejection: float = FALSE_REJECTION, error: float = ERROR,
) -> DataFrame:
    """Measures, rates, cutoffs and verdict of every row of ``docs``.

    The measures are computed once into the shared folder: they are needed for the cutoffs and for the verdicts.
    """
    measures = settle(text_measures(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col))
    cutoffs = certified_cutoffs(
        measures, labels, label_col=label_col, false_rejection=false_rejection, error=error
    )
    return judge(measures, cutoffs)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    The cutoffs are fitted first; then each row is measured and judged where it lies, so no text is shuffled.
    """
    names = {"id_col": id_col, "text_col": text_col, "stratum_col": stratum_col}
    cutoffs = certified_cutoffs(settle(text_measures(docs, **names)), labels)
    judged = judge(text_measures(docs, **names, carry="_row"), cutoffs)
    return judged.where("kept").select("_row.*")
