"""The registered queries of this subpackage and, where SQL can say it, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm.common import table
from paneloom.llm.html_text import extract_text
from paneloom.llm.lexicon import bpe_encode, read_tokenizer
from paneloom.llm.line_dedup import dedup_lines
from paneloom.llm.mixing import mix
from paneloom.llm.pieces import encode_texts, read_model, token_count
from paneloom.llm.quality_model import quality_scores
from paneloom.llm.quality_rules import ERROR, FALSE_REJECTION, GRID, quality_rules
from paneloom.llm.ranked_search import ranked_search
from paneloom.llm.secrets import KINDS, find_secrets, joined
from paneloom.llm.sharding import shard_rows
from paneloom.llm.simhash import simhash_components
from paneloom.llm.spelling import spelling_variants, vocabulary
from paneloom.llm.spotsigs import compare_with_next, printed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def piece_model() -> str:
    """Where the public SentencePiece model lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_tokenizer() -> str:
    """Where the public word-end BPE tokeniser lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rules_sql() -> str:
    """The SQL of the quality rules: measures, exact binomial tails and strictest certified cutoffs per language."""
    rules, allowed = list(GRID), FALSE_REJECTION / len(GRID)
    cells = [(r, i, c) for r in rules for i, c in enumerate(GRID[r])]
    grid = ", ".join(f"('{r}', {c}::DOUBLE)" for r, _, c in cells)
    rates = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {r} AS rate FROM measured" for r in rules)
    return f"""
WITH texts AS (
  SELECT doc_id, '=' || lang AS lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, words[i:i + 7] AS gram FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM texts WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM grams JOIN (SELECT doc_id, gram FROM grams GROUP BY ALL HAVING count(*) > 1) USING (doc_id, gram)
), covered AS (
  SELECT doc_id, count(DISTINCT i + step) AS n FROM twice, range(8) AS steps(step) GROUP BY doc_id
), counted AS (
  SELECT t.doc_id, coalesce(lang, '') AS stratum, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '[!?]')) AS n_marks
  FROM texts t LEFT JOIN covered c ON c.doc_id = t.doc_id
), measured AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbol_rate,
    coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_rate,
    coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_rate,
    coalesce(n_upper::DOUBLE / nullif(word_chars, 0), 0) AS upper_rate,
    coalesce(n_marks::DOUBLE / nullif(n_words, 0), 0) AS mark_rate
  FROM counted
), rates AS ({rates}),
good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), tests AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (rate > cutoff) AS k
  FROM rates JOIN good USING (doc_id) JOIN measured m USING (doc_id, stratum)
  JOIN (VALUES {grid}) AS g(rule, cutoff) USING (rule)
  WHERE NOT base_failed GROUP BY ALL
), tails AS (
  SELECT stratum, rule, cutoff, CASE WHEN k >= n * {allowed} THEN 1.0 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({allowed}) + (n - i) * ln(1 - {allowed})))
    FROM range(k + 1) AS r(i)) END AS p
  FROM tests
), cutoffs AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM tails
  WHERE p <= {ERROR} / ((SELECT count(DISTINCT stratum) FROM measured) * {len(cells)}) GROUP BY ALL
), rejected AS (
  SELECT DISTINCT doc_id FROM rates JOIN cutoffs USING (stratum, rule) WHERE rate > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM measured
"""


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document; cutoffs certified on the labels, per language."""
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document so that the sources meet weights 5, 2, 1 and share 150 % of all words."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of nearly equal bytes; equal texts share a shard."""
    return shard_rows(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at three differing bits or fewer."""
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of packed ids and decoded texts."""
    return encoded.select(
        "doc_id", token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return digests(encode_texts(table(spark, sf_dir, "documents"), read_model(piece_model())))


@query
def op12_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document by a compiled lexicon and exact merges, as digests."""
    return digests(bpe_encode(table(spark, sf_dir, "documents"), read_tokenizer(word_tokenizer())))


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from labels outside the held-out third."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def secret_columns(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans."""
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in KINDS]
    every = F.sort_array(F.concat("base", "added"))
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the Markov models are trained on short runs and a fixed labelled sample."""
    return secret_columns(find_secrets(table(spark, sf_dir, "documents")))


def spot_columns(compared: DataFrame) -> DataFrame:
    """Lengths, digests and printed fingerprints of compared texts."""
    return compared.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("signatures")).alias("fingerprint"),
        printed(F.col("edited_signatures")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


@query
def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike the neighbours are."""
    return spot_columns(compare_with_next(table(spark, sf_dir, "documents")))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are near-duplicates of an earlier line of any document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select("doc_id", "text", "n_lines", "n_dropped")


#: One code point less, one replaced or one more; crc32 from its polynomial, over the bytes of Latin-1 letters.
SPELLING_SQL = """
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda a, step:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS tab
  FROM range(256) AS t(b)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS name,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT name, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(name || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
        ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END))),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM counted, bits
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT))
      || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole,
    substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.less = w.word
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.less = w.word
), best AS (
  SELECT word, count(*) AS n_near, min({'less': -other_n, 'form': encode(other)}) AS top FROM near GROUP BY word
), judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN -b.top.less >= 10 * w.n THEN decode(b.top.form) END AS form,
    CASE WHEN -b.top.less >= 10 * w.n THEN -b.top.less END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), walk AS (
  SELECT word, word AS root FROM judged
  UNION ALL SELECT k.word, j.form FROM walk k JOIN judged j ON j.word = k.root WHERE j.form IS NOT NULL
)
SELECT j.word, j.form, k.root, j.n, CAST(j.n_near AS BIGINT) AS n_near, CAST(j.form_n AS BIGINT) AS form_n
FROM judged j JOIN (
  SELECT k.word, k.root FROM walk k JOIN judged l ON l.word = k.root WHERE l.form IS NULL) k ON k.word = j.word
"""


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with one code point dropped here and there; near words, usual form and root of each."""
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents"), drop_one_in=31))


RANKED_SQL = r"""
WITH docs AS (
  SELECT rowid AS place, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), size AS (
  SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs
), postings AS (
  SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, size GROUP BY term, n_docs
), lengths AS (
  SELECT place, doc_id, 100 - 50 + (50 * len(terms) * n_docs) // n_terms AS m FROM docs, size WHERE len(terms) > 0
), items AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scores AS (
  SELECT item_id, text, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (place) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank,
  doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) <= 50
"""


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item, from a block-max index of all documents."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op8_quality_rules"] = rules_sql()
ORACLES["op13_ranked_search"] = RANKED_SQL
ORACLES["op11_spelling"] = SPELLING_SQL
