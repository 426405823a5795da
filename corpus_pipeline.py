"""The document pipeline: stages from DataFrame to DataFrame, each written and read again.

Language ID, exact dedup, near dedup (five-word shingles, Jaccard 0.8 or more), packing.  Each stage works on all that the
one before kept; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.jaccard_join import jaccard_dedup
from millrace.llm.language_id import keep_identified, train_languages
from millrace.llm.packing import pack_documents
from millrace.llm.plans import vocabulary
from millrace.llm.text import short_batches
from millrace.session import materialise

LEAST_SCORE = 0.1  # below, words and spans tell next to nothing
SEQUENCE = 2048

#: Word statistics and token ids can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents with a language; drop those without a letter or with languages all mixed."""
    with short_batches(spark):
        return materialise(keep_identified(docs, train_languages(docs.filter(F.col("lang").isNotNull())), LEAST_SCORE))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    return jaccard_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence."""
    with short_batches(spark):
        return pack_documents(docs, vocabulary("word_bpe_49k.json"), SEQUENCE)


STAGES = [("language ID", identify), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
