"""Embedding, exact retrieval, index tables and the domain classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CONTEXT_PROMPT, fill
from ..functions.tokens import bind
from ..session import materialise

QUERY_BLOCK = 1024  # queries that travel to the documents
BLOCK_ROWS = 65_536  # rows of either side in one task of a grid, and
BLOCK_BYTES = 64 << 20  # bytes of their vectors
TILE = 4_000_000  # scores a task holds at once
INDEX_BLOCKS = 256  # parts of an index that have a checksum each


def l2_normalize(v: Column) -> Column:
    """The vector over its L2 norm; a zero vector stays zero."""
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return bind(norm, lambda n: F.transform(v, lambda x: F.when(n == 0, x).otherwise(x / n)))


def embed_documents(df: DataFrame, text: str, dim: int = 256, encoder=None) -> DataFrame:
    """``embedding`` per document by a user's encoder (pandas UDF, see
    ``batched_udf``), or by hashed word counts on the JVM."""
    if encoder is not None:
        return df.withColumn("embedding", encoder(F.col(text)))
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array
    words = df.withColumn("_w", F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    counted = HashingTF(numFeatures=dim, inputCol="_w", outputCol="_tf").transform(words)
    return counted.withColumn("embedding", l2_normalize(vector_to_array("_tf"))).drop("_w", "_tf")


def md5_bucket(c: Column, buckets: int) -> Column:
    """A bucket that any engine can compute: the first 8 hex digits of the MD5 of a string."""
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def embed_words(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """(key, embedding): word counts in MD5 buckets, normalised.  Words are counted as rows, combined per task, so a very
    long text needs no room of its own.  Keys are unique; a text without words (or null) has zeros."""
    words = df.select(key, F.explode_outer(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")).alias("w"))
    counts = words.groupBy(key, md5_bucket(F.col("w"), dim).alias("b")).agg(F.count("w").cast("double").alias("n"))
    held = counts.groupBy(key).agg(F.map_from_entries(F.filter(
        F.collect_list(F.struct("b", "n")), lambda e: e["b"].isNotNull())).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return held.select(key, l2_normalize(dense).alias("embedding"))


def _best_k(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores per row with their ids, the lower id first among equals."""
    n = s.shape[1]
    if n > k:
        cut = np.partition(s, n - k, axis=1)[:, n - k]
        keep = [np.flatnonzero(row >= c) for row, c in zip(s, cut)]  # k entries, more on ties
        order = [x[np.lexsort((ids[x], -row[x]))[:k]] for x, row, ids in zip(keep, s, i)]
        top = np.array(order)
    else:
        top = np.lexsort((i, -s), axis=1)
    return np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)


def _scan_block(docs: DataFrame, queries: list, k: int, key: str, vec: str, normalize: bool) -> DataFrame:
    """Candidates of one block of queries: every task keeps its own best ``k``
    rows per query while it streams over its documents, so no pair of query and
    document is ever written out."""
    ids = np.array([q[0] for q in queries], dtype=np.int64)
    mat = docs.sparkSession.sparkContext.broadcast(np.array([q[1] for q in queries], dtype=np.float64))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = mat.value
        held_s = np.empty((len(q), 0))
        held_i = np.empty((len(q), 0), dtype=np.int64)
        for b in batches:
            if not len(b):
                continue
            m = np.vstack(b[vec].to_numpy()).astype(np.float64)
            if normalize:
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
            s = np.hstack([held_s, q @ m.T])
            i = np.hstack([held_i, np.broadcast_to(b[key].to_numpy(dtype=np.int64), (len(q), len(b)))])
            held_s, held_i = _best_k(s, i, k)
        if held_s.shape[1]:
            yield pd.DataFrame({"query_id": np.repeat(ids, held_s.shape[1]), key: held_i.ravel(), "score": held_s.ravel()})

    return docs.select(key, vec).mapInPandas(best, f"query_id long, {key} long, score double")


def exact_topk(docs: DataFrame, queries: DataFrame, k: int = 3, key: str = "vec_id", vec: str = "embedding",
               normalize: bool = True) -> DataFrame:
    """Exact inner-product search: (query_id, key, score, rank).  Keys and query ids may be of any type that can be ordered.

    One block of queries (``QUERY_BLOCK`` vectors at most, integer keys) travels to the documents, which are neither shuffled nor
    copied.  More queries meet the documents on a grid: each task has one block of either and keeps k rows per query of its
    block; those are ranked.  Documents move once per block of queries (up to ``BLOCK_ROWS``)."""
    n = queries.count()
    keys = docs.schema[key].dataType
    ids = queries.schema["query_id"].dataType
    if n == 0:
        schema = f"query_id {ids.simpleString()}, {key} {keys.simpleString()}, score double, rank int"
        return docs.sparkSession.createDataFrame([], schema)
    if n <= QUERY_BLOCK and isinstance(keys, T.IntegralType) and isinstance(ids, T.IntegralType):
        rows = [(r[0], r[1]) for r in queries.select("query_id", "embedding").collect()]
        found = _scan_block(docs, rows, k, key, vec, normalize)
    else:
        found = _grid(docs, queries, n, k, key, vec, normalize)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _grid(docs: DataFrame, queries: DataFrame, n: int, k: int, key: str, vec: str, normalize: bool) -> DataFrame:
    m, dim = docs.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim or 1))))
    down, across = -(-n // most), max(1, -(-m // most))

    def cell(c: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(blocks))

    def all_of(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    q = queries.select("query_id", F.col("embedding").alias("_v"), cell("query_id", down).alias("_r")).withColumn("_c", all_of(across))
    d = docs.select(F.col(key).alias("_key"), F.col(vec).alias("_v"), cell(key, across).alias("_c")).withColumn("_r", all_of(down))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("_key")  # the column decides ties
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            a, b = _vectors(left.column("_v")), _vectors(right.column("_v"))
            if normalize:
                norm = np.linalg.norm(b, axis=1, keepdims=True)
                b = np.divide(b, norm, out=np.zeros_like(b), where=norm > 0)
            step = max(1, TILE // len(b))
            order = np.arange(len(b))
            for i in range(0, len(a), step):
                s = a[i:i + step] @ b.T
                s, at = _best_k(s, np.broadcast_to(order, s.shape), k)
                found.append((np.repeat(np.arange(i, i + len(s)), s.shape[1]), at.ravel(), s.ravel()))
        i, at, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=int),) * 3
        return pa.table({"query_id": pc.take(left.column("query_id"), pa.array(i)), key: pc.take(right.column("_key"), pa.array(at)),
                         "score": pa.array(s, pa.float64())})
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {docs.schema[key].dataType.simpleString()}, score double"
    return q.groupBy("_r", "_c").cogroup(d.groupBy("_r", "_c")).applyInArrow(best, kinds)


def index_blocks(vectors: DataFrame, blocks: int = INDEX_BLOCKS) -> DataFrame:
    """Per block of ids: number of vectors, least and greatest dimension, and a checksum of ids and vectors in any order."""
    row = F.xxhash64(F.col("id").cast("string"), "embedding")
    return vectors.groupBy(md5_bucket(F.col("id"), blocks).alias("block")).agg(
        F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"),
        F.bit_xor(row).alias("mixed"), F.sum(F.shiftright(row, 16)).alias("summed"))


def build_index_table(docs: DataFrame, vectors: DataFrame, path: str, model: str, created_at: str,
                      mode: str = "overwrite") -> DataFrame:
    """Write ``documents`` (id, text), ``vectors`` (id, normalised embedding), ``manifest`` (``index_blocks``) and the one-row
    ``config``; returns the config.  Manifest and config are read off the written vectors."""
    spark = docs.sparkSession
    docs.select("id", "text").write.mode(mode).parquet(f"{path}/documents")
    vectors.select("id", l2_normalize(F.col("embedding")).alias("embedding")).write.mode(mode).parquet(f"{path}/vectors")
    index_blocks(spark.read.parquet(f"{path}/vectors")).write.mode(mode).parquet(f"{path}/manifest")
    cfg = spark.read.parquet(f"{path}/manifest").agg(
        F.max("most_dim").alias("dimension"), F.coalesce(F.sum("vectors"), F.lit(0)).alias("num_documents")).select(
        F.lit(model).alias("embedding_model"), "dimension", "num_documents", F.lit("flat_inner_product").alias("index_type"),
        F.lit("float").alias("dtype"), F.concat(F.lit("["), F.concat_ws(",", "num_documents", "dimension"), F.lit("]")).alias("shape"),
        F.lit(created_at).alias("created_at"))
    cfg.write.mode(mode).parquet(f"{path}/config")
    return spark.read.parquet(f"{path}/config")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, vectors, config and manifest."""
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("documents", "vectors", "config", "manifest"))


def assemble_context(hits: DataFrame, docs: DataFrame, questions: DataFrame, key: str = "vec_id",
                     template: str = CONTEXT_PROMPT) -> DataFrame:
    """Prompt per query: the hit texts in rank order between blank lines, then the
    question.  A query has at most k hits, so its list is short; the few hits
    are what gets broadcast to the documents."""
    texts = docs.join(hits, docs["id"] == hits[key]).select("query_id", "rank", "text")
    ctx = texts.groupBy("query_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "\n\n").alias("context"))
    return ctx.join(questions, "query_id").select(
        "query_id", fill(template, {"context": F.col("context"), "question": F.col("question")}).alias("prompt"))


def index_integrity(docs: DataFrame, vectors: DataFrame, config: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row of counts and the overall verdict.

    ``bad_blocks`` of the index have not the number, dimension and checksum that the manifest, written with the index,
    names; so a vector that changed, moved to another id, went or came is found without a second copy of the vectors."""
    now = materialise(index_blocks(vectors))
    v = now.agg(F.coalesce(F.sum("vectors"), F.lit(0)).alias("vectors"), F.min("least_dim").alias("min_dim"), F.max("most_dim").alias("max_dim"))
    parts = [c for c in now.columns if c != "block"]
    both = now.select("block", F.struct(*parts).alias("now")).join(manifest.select("block", F.struct(*parts).alias("then")), "block", "full")
    bad = both.agg(F.count_if(~F.col("now").eqNullSafe(F.col("then"))).alias("n"))
    no_vec = docs.join(vectors.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    no_doc = vectors.join(docs.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    c = config.select(F.struct("dimension", "num_documents")).scalar()
    out = v.withColumn("without_vector", no_vec.scalar()).withColumn("without_document", no_doc.scalar()) \
        .withColumn("bad_blocks", bad.scalar()).withColumn("_c", c)
    same_dim = (F.col("vectors") == 0) | ((F.col("min_dim") == F.col("_c.dimension")) & (F.col("max_dim") == F.col("_c.dimension")))
    ok = (F.col("vectors") == F.col("_c.num_documents")) & same_dim \
        & (F.col("without_vector") == 0) & (F.col("without_document") == 0) & (F.col("bad_blocks") == 0)
    return out.withColumn("valid", ok).drop("_c")


def domain_classifier(df: DataFrame, vec: str = "embedding", label: str = "label"):
    """Balanced logistic regression on embeddings.  The penalty equals an L2
    penalty with C = 1 on the summed loss: weights sum to n, hence 1/n here."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    counts = {int(r[0]): r[1] for r in df.groupBy(F.col(label).cast("int")).count().collect()}
    n = sum(counts.values())
    w = F.when(F.col(label).cast("int") == 1, n / (2.0 * counts.get(1, 1))).otherwise(n / (2.0 * counts.get(0, 1)))
    train = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"),
                      F.col(label).cast("double").alias("label"), w.alias("w"))
    return LogisticRegression(weightCol="w", regParam=1.0 / n, standardization=False, maxIter=100, tol=1e-8).fit(train)


def chosen_probability(model, df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Probability of the desirable class per row."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    scored = model.transform(df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>"))))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def density_ratio_weight(p: Column, lo: float = 0.5, hi: float = 10.0) -> Column:
    return F.least(F.greatest(p / (F.lit(1.0) - p + F.lit(1e-8)), F.lit(lo)), F.lit(hi))
