"""Embeddings and retrieval over the driver tables (VEC-1..8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import retrieval as vec
from ..session import scratch_path
from ..tables import ctes, label_queries, table
from .registry import query

NORM_SQL = """normed AS (SELECT vec_id, CASE WHEN n = 0 THEN x ELSE list_transform(x, lambda v: v / n) END AS x FROM (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n FROM (
    SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)))"""
TOPK_SQL = ctes("label_queries") + ", " + NORM_SQL + """, hits AS (
SELECT query_id, vec_id, list_inner_product(embedding, x) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(embedding, x) DESC, vec_id) AS rank
FROM label_queries, normed)
"""


WORDS_SQL = """words AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(n * n)) AS z FROM words GROUP BY doc_id)"""


@query("embed_documents", "WITH " + WORDS_SQL + """
SELECT e.doc_id, list(round(coalesce(n / z, 0.0), 6) ORDER BY d) AS embedding
FROM (SELECT doc_id, unnest(range(64)) AS d FROM documents) e LEFT JOIN norms ON norms.doc_id = e.doc_id
LEFT JOIN words ON words.doc_id = e.doc_id AND words.b = e.d GROUP BY e.doc_id""")
def embed_documents(spark, sf):
    return vec.embed_words(table(spark, sf, "documents"), "doc_id", "text", 64) \
        .select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("l2_normalize", "WITH " + NORM_SQL + " SELECT vec_id, list_transform(x, lambda v: round(v, 6) + 0.0) AS x FROM normed")
def l2_normalize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(
        vec.l2_normalize(F.col("embedding")), lambda v: rnd(v)).alias("x"))


@query("exact_topk_inner_product", TOPK_SQL + "SELECT query_id, vec_id, round(score, 6) + 0.0 AS score, rank FROM hits WHERE rank <= 3")
def exact_topk_inner_product(spark, sf):
    hits = vec.exact_topk(table(spark, sf, "embeddings"), label_queries(spark, sf), 3)
    return hits.withColumn("score", rnd(F.col("score"))).withColumn("rank", F.col("rank").cast("long"))


MANY_SQL = "WITH " + NORM_SQL + """, hits AS (
SELECT q.vec_id AS query_id, n.vec_id, list_inner_product(list_transform(q.embedding, lambda v: CAST(v AS DOUBLE)), n.x) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(list_transform(q.embedding, lambda v: CAST(v AS DOUBLE)), n.x) DESC, n.vec_id) AS rank
FROM embeddings q, normed n WHERE q.vec_id % 10 = 0)
SELECT query_id, vec_id, round(score, 6) + 0.0 AS score, rank FROM hits WHERE rank <= 3"""


@query("exact_topk_many_queries", MANY_SQL)
def exact_topk_many_queries(spark, sf):
    """Every tenth embedding as a query, with text keys, which always meet the documents on the grid."""
    e = table(spark, sf, "embeddings").withColumn("vec_id", F.format_string("%020d", "vec_id"))
    q = e.filter(F.col("vec_id").cast("long") % 10 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    hits = vec.exact_topk(e, q, 3)
    return hits.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec_id").cast("long").alias("vec_id"),
                       rnd(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


def _documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@query("build_index_table", """
SELECT 'hashed-words' AS embedding_model, 64 AS dimension, count(*) AS num_documents, 'flat_inner_product' AS index_type, 'float' AS dtype,
  '[' || count(*) || ',64]' AS shape, '2024-01-01T00:00:00' AS created_at FROM documents""")
def build_index_table(spark, sf):
    docs = _documents(spark, sf)
    return vec.build_index_table(docs, vec.embed_words(docs, "id", "text", 64), scratch_path(spark, "index"), "hashed-words", "2024-01-01T00:00:00")


@query("assemble_context", TOPK_SQL + """
SELECT query_id, 'Based on the following context, answer the question.' || chr(10) || chr(10) || 'Context:' || chr(10) ||
  string_agg(text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: What is label ' || query_id || '?' ||
  chr(10) || chr(10) || 'Answer:' AS prompt
FROM hits JOIN documents ON doc_id = vec_id WHERE rank <= 5 GROUP BY query_id""")
def assemble_context(spark, sf):
    docs = _documents(spark, sf)
    q = label_queries(spark, sf)
    hits = vec.exact_topk(table(spark, sf, "embeddings"), q, 5)
    questions = q.select("query_id", F.concat(F.lit("What is label "), F.col("query_id").cast("string"), F.lit("?")).alias("question"))
    return vec.assemble_context(hits, docs, questions)


@query("index_integrity", """
WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 256 AS block FROM documents),
whole AS (SELECT 'whole' AS state, count(*) AS vectors, 64 AS min_dim, 64 AS max_dim, 0 AS without_vector, 0 AS without_document, 0 AS bad_blocks, true AS valid FROM d),
damaged AS (SELECT 'damaged', count(*) FILTER (doc_id % 97 <> 3), min(CASE WHEN doc_id % 89 = 4 AND doc_id % 97 <> 3 THEN 63 ELSE 64 END), 64,
  count(*) FILTER (doc_id % 97 = 3 AND doc_id % 101 <> 5), count(*) FILTER (doc_id % 101 = 5 AND doc_id % 97 <> 3),
  count(DISTINCT block) FILTER (doc_id % 97 = 3 OR doc_id % 89 = 4 OR doc_id % 83 = 6), false FROM d)
SELECT * FROM whole UNION ALL SELECT * FROM damaged""")
def index_integrity(spark, sf):
    """The index of all documents, and a copy that lost documents and vectors, has short vectors and vectors that changed."""
    path, docs = scratch_path(spark, "index"), _documents(spark, sf)
    vec.build_index_table(docs, vec.embed_words(docs, "id", "text", 64), path, "hashed-words", "2024-01-01T00:00:00")
    docs, vectors, config, manifest = vec.open_index(spark, path)
    changed = F.when(F.col("id") % 89 == 4, F.slice("embedding", 1, 63)) \
        .when(F.col("id") % 83 == 6, F.transform("embedding", lambda x: x + F.lit(0.5))).otherwise(F.col("embedding"))
    torn = vectors.filter("id % 97 <> 3").withColumn("embedding", changed)
    whole = vec.index_integrity(docs, vectors, config, manifest).withColumn("state", F.lit("whole"))
    damaged = vec.index_integrity(docs.filter("id % 101 <> 5"), torn, config, manifest).withColumn("state", F.lit("damaged"))
    return whole.unionByName(damaged)


@query("domain_classifier")
def domain_classifier(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("label", (F.col("label") >= 5).cast("int"))
    return vec.chosen_probability(vec.domain_classifier(e), e).select("vec_id", "label", F.round("p", 4).alias("p"))


@query("density_ratio_weight", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  round(least(greatest(p / (1.0 - p + 1e-8), 0.5), 10.0), 6) AS weight
FROM (SELECT *, (l_discount + 0.0) * 9.5 AS p FROM lineitem)""")
def density_ratio_weight(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.round(vec.density_ratio_weight((F.col("l_discount") + F.lit(0.0)) * F.lit(9.5)), 6).alias("weight"))
