"""Registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import round_trip_digests
from .embedding_dedup import near_duplicate_components
from .exact_dedup import exact_groups
from .hard_negatives import mine_hard_negatives
from .jaccard_join import jaccard_components
from .language_id import fold, identify_languages, train_languages
from .lm_scoring import score_documents
from .packing import pack_documents
from .runs import periodic_runs, run_digests
from .sharding import shard_documents
from .token_counts import encoded_lengths, length_histogram
from .url_filter import url_verdicts
from .word_bpe import word_bpe_digests

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; every machine has the package."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# DuckDB's lower() follows Unicode; replacing the letters A-Z one by one does not
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


ORACLES["op1_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, {_LOW} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""


@_query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


@_query
def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents")).withColumn("law", F.lit("key"))


@_query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(_table(spark, sf_dir, "embeddings"))


@_query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1, order=3)


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train_languages(docs.filter(~held_out))
    return identify_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@_query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


@_query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
w AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same
  WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3"""


@_query
def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe_digests(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    return run_digests(periodic_runs(_table(spark, sf_dir, "documents"), F.when(h % 10 == 0, g)))
