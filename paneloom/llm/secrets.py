"""Secrets in texts: fixed patterns, and Markov models of random strings against ordinary identifiers (built-ins only).

Three patterns (``KINDS``) give the base spans. Beyond them every long run of token characters is a candidate. Two
first-order Markov models over characters, one of random strings and one of ordinary identifiers, are counted from three
quarters of labelled samples. A candidate's log-likelihood ratio per character pair is compared with a cutoff fitted on
the other quarter: the least one at which no shape of ordinary identifier is flagged more often than ``allowed``. A
candidate above it is a span of kind ``random``, unless it touches a base span.

The labelled samples may be any table (text, random, and a shape where there are several). The default ones,
:func:`own_samples`, are made by rule: ordinary identifiers of the shapes in :func:`identifiers` out of the lower-case
words of a bounded sample of rows (``SAMPLE_ROWS`` and ``PER_ROW``), so no token of the texts is judged by its own pairs,
``ORDINARY`` and numbers; random ones are ``random_tokens``, drawn from six alphabets. Strings of digits and separators are
ordinary (dates, amounts, card-like numbers), and so is a candidate in the form of a UUID: both name things. The counts
are over all samples; the two tables have a fixed size (pairs of 67 states), which is all that reaches the driver.

Positions count code points. They come from the lengths of the matches and of what lies between them, summed up by
doubling, so a text with k matches costs k log k.

A null text is an empty one and has no spans; repeated rows each get a row; an empty table gives an empty result;
columns of the input other than the id and the text are ignored. If the given samples lack random or ordinary strings, no
span is added.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import let
from paneloom.operators.spread import settle

#: Fixed patterns, in the order in which they are listed: kind, pattern, group whose length counts, least length.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
]

#: Characters of tokens; the end of the list stands for the start of a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
STATES = len(ALPHABET) + 1

#: A candidate: a whole run of ``LEAST`` token characters or more.
LEAST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{LEAST},}}"

#: A candidate that is an identifier by its form.
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"

#: Ordinary strings that words do not make: rules, hosts, paths, dates and versions.
ORDINARY = [c * n for c in "+/_=.-" for n in (20, 40, 80)] + """
www.provider.com docs.provider.org/index.html /usr/local/share/doc/readme.txt src/main/java/util/List.java
../images/logo-small.png //cdn.example.net/assets/js/main.min.js content-type-options getElementById readFileAsText
HttpServletRequest 2024-01-31T12:45:00 2019-12-05_backup.tar.gz version-1.2.3 release-2.10.0-rc1 1.000.000.000
192.168.1.254 01/02/2023-28/02/2023 page=1 name=value and/or 3.14159265358979 ---+---+---
""".split()

#: Rows whose words make identifiers (about so many, whatever the size of the corpus), and identifiers per row.
SAMPLE_ROWS, PER_ROW = 4000, 32

#: A word that makes identifiers.
WORD_PART = "(?<![A-Za-z])[a-z]{3,11}(?![A-Za-z])"

#: One in so many samples is kept for the cutoff, and the share of a shape's identifiers that may be flagged.
HELD_OUT, ALLOWED = 4, 0.005

#: Alphabets of the random tokens of the labelled sample, and how many of which length there are of each.
LETTERS = string.ascii_letters + string.digits
RANDOM = [LETTERS, LETTERS + "+/", LETTERS + "-_", "0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567"]
TOKENS, TOKEN = 800, (20, 24, 32, 40)

#: Weight, in pairs, of what a character's followers are expected to be before any is counted: for random strings all
#: characters alike, for ordinary ones as frequent as they are anywhere (``UNSEEN`` for one that never occurred).
RANDOM_START, ORDINARY_START, UNSEEN = float(STATES), 4.0, 0.1

SPANS = "array<struct<start:int,end:int,value:string>>"


def running_sum(values: Column) -> Column:
    """Sums of an array up to each place, by doubling: each round adds the sum that lies one step back."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1)

    def step(sums: Column, j: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), j)
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0)))

    return F.aggregate(rounds, values, step)


def spans_of(text: Column, pattern: str, group: int = 0) -> Column:
    """Start, end and one group of all matches from left to right, as an array."""
    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            widths = F.transform(found, lambda f, i: F.length(f) + F.length(F.get(gaps, i)))
            return let(let(widths, running_sum), with_ends)

        def with_ends(ends: Column) -> Column:
            return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda values: F.transform(
                found, lambda f, i: F.struct(
                    (F.get(ends, i) - F.length(f)).alias("start"), F.get(ends, i).alias("end"),
                    F.get(values, i).alias("value"),
                )
            ))

        return let(F.split(text, pattern, -1), with_gaps)

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(
        F.array().cast(SPANS)
    )


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one array of spans per kind, candidates) of every row; one pass over the texts."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select(
        "doc_id",
        *[long_enough(spans_of(text, pattern, group), least).alias(kind) for kind, pattern, group, least in KINDS],
        spans_of(text, CANDIDATE).alias("candidates"),
    )


def long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


def base_spans() -> Column:
    """All base spans of a scanned row as (start, place of the kind, end), sorted."""
    parts = [F.transform(F.col(kind), tagged(place)) for place, (kind, *_) in enumerate(KINDS)]
    return F.sort_array(F.concat(*parts))


def tagged(place: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end"))


def free_candidates() -> Column:
    """The candidates of a scanned row that touch no base span."""
    def free(c: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    return F.filter("candidates", free)


def random_tokens() -> list[str]:
    """The random strings of the labelled sample; always the same ones."""
    rng = random.Random(5)
    return ["".join(rng.choice(letters) for _ in range(rng.choice(TOKEN))) for letters in RANDOM for _ in range(TOKENS)]


def identifiers(words: Column, number: Column) -> dict[str, Column]:
    """Ordinary identifiers of each shape out of four words and a number."""
    w = [F.get(words, i) for i in range(4)]
    upper = [F.initcap(x) for x in w]
    digits = F.abs(number).cast("string")
    part = [F.substring(digits, i, 2) for i in (1, 3, 5, 7)]
    return {
        "camel": F.concat(*upper[:3]), "lower_camel": F.concat(w[0], *upper[1:]), "snake": F.concat_ws("_", *w),
        "constant": F.upper(F.concat_ws("_", *w[:3])), "kebab": F.concat_ws("-", *w),
        "dotted": F.concat_ws(".", *w[:3]), "path": F.concat(F.lit("/"), F.concat_ws("/", *w[:3])),
        "file": F.concat(w[0], F.lit("/"), w[1], F.lit("_"), w[2], F.lit("."), F.substring(w[3], 1, 3)),
        "host": F.concat(F.lit("www."), w[0], w[1], F.lit("."), F.substring(w[2], 1, 3), F.lit("/"), w[3]),
        "compound": F.concat(*w[:3]), "upper_compound": F.upper(F.concat(*w[:3])), "capital": F.concat(upper[0], *w[1:]),
        "numbered": F.concat(F.concat_ws("_", *w[:2]), F.lit("_"), part[0], part[1]),
        "version": F.concat(F.concat_ws("-", *w[:2]), F.lit("-"), F.concat_ws(".", *part[:3])),
        "setting": F.concat(w[0], F.lit("_"), w[1], F.lit("="), w[2], upper[3]),
        "date": F.concat(F.lit("20"), part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit("T"), part[3], F.lit(".000")),
        "number": F.substring(F.concat(digits, F.reverse(digits)), 1, 16),
        "amount": F.concat_ws(".", *[F.concat(p, F.substring(digits, 9, 1)) for p in part], F.lit("00")),
    }


def own_samples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, random, shape): identifiers out of the words of a sample of rows, the fixed ones, and random tokens."""
    every = max(1, docs.count() // SAMPLE_ROWS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    seed = F.xxhash64(F.col(id_col), text)
    rows = docs.where(F.pmod(seed, F.lit(every)) == 0).select(
        seed.alias("seed"), F.regexp_extract_all(text, F.lit(WORD_PART), F.lit(0)).alias("words")
    ).where("size(words) >= 4").dropDuplicates(["seed"])
    drawn = rows.select("seed", "words", F.explode(F.sequence(F.lit(0), F.lit(PER_ROW - 1))).alias("j"))
    first = F.pmod(F.xxhash64("seed", "j"), F.size("words") - 3).cast("int")
    drawn = drawn.select("seed", "j", F.slice("words", first + 1, 4).alias("words"))
    shapes = identifiers(F.col("words"), F.xxhash64("j", "seed"))
    made = F.array(*[F.struct(c.alias("text"), F.lit(shape).alias("shape")) for shape, c in shapes.items()])
    one = F.get(made, F.pmod(F.xxhash64("j", "seed", F.lit(1)), F.lit(len(shapes))).cast("int"))
    samples = drawn.select(one.alias("_s")).select("_s.text", F.lit(0).alias("random"), "_s.shape")
    for kind, shape, fixed in ((0, "fixed", ORDINARY * 20), (1, "random", random_tokens())):
        given = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(" ".join(fixed)), " ")).alias("text"))
        samples = samples.unionByName(given.select("text", F.lit(kind).alias("random"), F.lit(shape).alias("shape")))
    return samples


def code(character: Column) -> Column:
    """The place of a token character in the alphabet; the last state for any other."""
    at = F.instr(F.lit(ALPHABET), character) - 1
    return F.when(at >= 0, at).otherwise(STATES - 1)


def pairs(token: Column) -> Column:
    """The numbers of a token's pairs of neighbours, the start counting as a neighbour."""
    codes = F.transform(F.split(token, ""), code)
    return let(codes, lambda c: F.transform(
        c, lambda x, i: F.coalesce(F.get(c, i - 1), F.lit(STATES - 1)) * STATES + x
    ))


def ratios(samples: DataFrame) -> list[float]:
    """Log of P(next | character) among random strings over the same among ordinary ones, for all pairs in order."""
    tokens = samples.where("text IS NOT NULL AND text <> '' AND random IS NOT NULL").groupBy("text", "random").count()
    counts = tokens.select("random", "count", F.explode(pairs(F.col("text"))).alias("pair")).groupBy(
        "random", "pair"
    ).agg(F.sum("count").alias("n"))
    cells = [[0.0] * STATES * STATES for _ in range(2)]
    for kind, pair, n in counts.collect():  # at most 2 x STATES x STATES rows
        cells[kind][pair] = float(n)
    if not any(cells[0]) or not any(cells[1]):
        return [0.0] * STATES * STATES
    followers = [sum(cells[0][b::STATES]) + UNSEEN for b in range(STATES)]
    usual = [[n / sum(followers) for n in followers], [1 / STATES] * STATES]
    logs = []
    for own, start, expected in zip(cells, (ORDINARY_START, RANDOM_START), usual):
        totals = [sum(own[s * STATES:(s + 1) * STATES]) + start for s in range(STATES)]
        logs.append([math.log((n + start * expected[i % STATES]) / totals[i // STATES]) for i, n in enumerate(own)])
    return [r - o for o, r in zip(*logs)]


def mean_ratio(token: Column, table: list[float]) -> Column:
    """A token's log-likelihood ratio per pair, so that long and short ones compare."""
    lookup = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # folded into one constant
    return let(pairs(token), lambda ps: F.aggregate(
        ps, F.lit(0.0), lambda total, p: total + F.get(lookup, p)
    ) / F.greatest(F.size(ps), F.lit(1)))


def fitted(samples: DataFrame, allowed: float = ALLOWED) -> tuple[list[float], float]:
    """The ratios from most of the samples, and the cutoff from the held-out ones: at least 0."""
    shape = F.col("shape") if "shape" in samples.columns else F.lit("")
    kept = samples.where("text IS NOT NULL AND random IS NOT NULL").select(
        "text", "random", shape.alias("shape"), (F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0).alias("held")
    )
    kept = settle(kept)
    table = ratios(kept.where("NOT held OR shape = 'fixed'"))
    judged = kept.where(f"held AND random = 0 AND length(text) >= {LEAST}").select(
        "shape", mean_ratio(F.col("text"), table).alias("ratio")
    )
    # One row per shape.
    least = judged.groupBy("shape").agg(F.percentile("ratio", 1 - allowed).alias("least")).agg(F.max("least")).first()[0]
    return table, max(least or 0.0, 0.0)


def with_random(scanned: DataFrame, table: list[float], cutoff: float) -> DataFrame:
    """Adds ``added``: the free candidates whose ratio is above ``cutoff`` and that are no UUIDs, as sorted structs."""
    found = F.filter("free", lambda c: (mean_ratio(c["value"], table) > cutoff) & ~c["value"].rlike(UUID))
    return scanned.withColumn("added", F.transform(found, tagged(len(KINDS))))


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(kind) for kind, *_ in KINDS], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def find_secrets(
    docs: DataFrame, samples: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    allowed: float = ALLOWED,
) -> DataFrame:
    """(doc_id, assign, access, hex, base, added) of every row; all spans as arrays of structs.

    One pass over the texts looks for everything; what it finds is kept in the shared folder for scoring.
    """
    scanned = scan(docs, id_col=id_col, text_col=text_col).withColumn("base", base_spans())
    scanned = settle(scanned.withColumn("free", free_candidates()).drop("candidates"))
    given = own_samples(docs, id_col=id_col, text_col=text_col) if samples is None else samples
    return with_random(scanned, *fitted(given, allowed)).drop("free")
