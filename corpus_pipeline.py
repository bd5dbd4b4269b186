"""A training-data pipeline over ``documents``: rules, line dedup, document dedup, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet
and read back as the next one's ``docs``. All stages but the last return the columns of ``documents``; where a text
changes, ``n_chars`` follows. The last one returns one row per copy in the mix with its ids as digests.

A repeated document is repeated in the result, as the mix says. Null and empty texts do not pass the quality rules; a
text that loses all its lines is empty from then on, and one such document stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm.common import table
from paneloom.llm.line_dedup import dedup_lines
from paneloom.llm.mixing import materialise
from paneloom.llm.pieces import encode_texts, read_model
from paneloom.llm.quality_rules import keep_good
from paneloom.llm.queries import digests, piece_model
from paneloom.llm.simhash import simhash_dedup
from paneloom.session import configure, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    configure(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are near-duplicates of an earlier line."""
    configure(spark)
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: 3-word shingles, three differing bits at most."""
    configure(spark)
    return simhash_dedup(docs, shingle=3, max_bits=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    configure(spark)
    return materialise(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document of the mix, as digests."""
    configure(spark)
    return digests(encode_texts(docs, read_model(piece_model())))


STAGES = [
    ("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mix), ("SentencePiece", pieces),
]

#: SQL has no MinHash components, SimHash links, pivotal rounding or SentencePiece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
