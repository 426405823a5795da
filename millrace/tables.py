"""Driver tables and the log-prob, reward and catalog tables derived from them.

Each derived table has a DataFrame form and the equal SQL text (``SQL``), which
the oracles use as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scale import rank_within, with_group_stats

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _token_columns() -> list:
    q = F.col("l_quantity") / F.lit(50.0)
    return [
        (F.col("l_partkey") % 50).alias("token_id"),
        (-q).alias("logp"),
        (-q - (F.col("l_discount") + F.lit(0.0)) + F.lit(0.05)).alias("old_logp"),
        (-q + (F.col("l_tax") + F.lit(0.0)) - F.lit(0.04)).alias("ref_logp"),
        (F.col("l_extendedprice") / F.lit(100000.0)).alias("entropy"),
        (F.col("l_quantity") / F.lit(25.0) - F.lit(1.0)).alias("value"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"),
    ]


def token_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per generated token: sequence = order, token = order line."""
    li = rank_within(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER, "rn")
    return li.select(F.col("l_orderkey").alias("seq_id"), (F.col("rn") - 1).alias("pos"), *_token_columns())


def tokens_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_logps`` for uses that need no position."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq_id"), *_token_columns())


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sampled completion of a prompt with two reward functions."""
    t = token_logps(spark, sf_dir)
    return t.select(
        F.col("seq_id").alias("prompt_id"), F.col("pos").alias("gen"), (F.col("logp") + F.lit(1.0)).alias("r1"),
        F.when(F.col("mask") != 0, F.col("entropy")).alias("r2"), "token_id", "logp", "old_logp", "ref_logp")


def pair_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen and rejected log-probs: completions 0 and 1, 2 and 3, ... of each sequence.

    The odd last completions of a batch's sequences are paired with each other by the order of the sequences; a pair is
    named by its first completion.  One that is still left has no rejected side (nulls)."""
    t = token_logps(spark, sf_dir).withColumn("pair_no", F.floor(F.col("pos") / 2))
    first = F.col("pos") % 2 == 0
    wide = t.groupBy("seq_id", "pair_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(first, F.col("logp"))).alias("cl"), F.max(F.when(~first, F.col("logp"))).alias("rl"),
        F.max(F.when(first, F.col("ref_logp"))).alias("cr"), F.max(F.when(~first, F.col("ref_logp"))).alias("rr")) \
        .withColumn("batch_id", F.col("seq_id") % 64)
    odd = rank_within(wide.filter("n = 1"), ["batch_id"], ["seq_id"], "rn")
    chosen = F.col("rn") % 2 == 1
    paired = odd.groupBy("batch_id", F.floor((F.col("rn") - 1) / 2).alias("two")).agg(
        *[F.max(F.when(chosen, F.col(c))).alias(c) for c in ("seq_id", "pair_no", "cl", "cr")],
        F.max(F.when(~chosen, F.col("cl"))).alias("rl"), F.max(F.when(~chosen, F.col("cr"))).alias("rr"))
    names = ["seq_id", "pair_no", "batch_id", "cl", "rl", "cr", "rr"]
    return wide.filter("n = 2").select(*names).unionByName(paired.select(*names)).select(
        F.col("seq_id").alias("pair_id"), "pair_no", "batch_id",
        (F.col("cl") - F.lit(0.001)).alias("policy_chosen"), (F.col("rl") - F.lit(0.001)).alias("policy_rejected"),
        (F.col("cr") - F.lit(0.05)).alias("ref_chosen"), (F.col("rr") - F.lit(0.05)).alias("ref_rejected"))


def binary_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per completion with a boolean label (every order line)."""
    return tokens_unordered(spark, sf_dir).select(
        F.col("seq_id").alias("row_id"), (F.col("seq_id") % 64).alias("batch_id"), (F.col("mask") == 1).alias("label"),
        F.col("logp").alias("policy_logp"), "ref_logp", F.col("old_logp").alias("policy_kl_logp"),
        F.col("ref_logp").alias("ref_kl_logp"))


def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog row per document source (its number is the rank of its name)."""
    per = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("n_chars").alias("n_chars"))
    # one row per dataset of the catalog, already aggregated
    ranked = per.withColumn("dataset_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source")))
    return ranked.select("dataset_id", F.col("source").alias("name"), "row_count", "n_chars")


def allocations(catalog: DataFrame) -> DataFrame:
    """Project-trait-dataset percentages, three traits and five projects."""
    return catalog.select(
        ((F.col("dataset_id") - 1) % 5).cast("int").alias("project_id"),
        F.when(F.col("dataset_id") % 3 == 0, "reasoning").when(F.col("dataset_id") % 3 == 1, "coding")
        .otherwise("general_tools").alias("trait_type"),
        "dataset_id", (((F.col("dataset_id") * 17) % 101).cast("double") + F.lit(0.33)).alias("percentage"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "queued")
        .otherwise("running").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("dataset_id"),
        F.col("o_totalprice").alias("amount"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "failed").when(F.col("c_mktsegment") == "MACHINERY", "running")
        .otherwise("pending").alias("status"),
        F.col("c_acctbal").alias("amount"))


def run_events(events: DataFrame) -> DataFrame:
    """Status and progress events of runs; works on batch and stream frames."""
    e = F.col("event_type")
    return events.select(
        "event_id", F.col("user_id").alias("run_id"), "ts",
        F.when(e == "signup", "pending").when(e == "view", "queued").when(e == "click", "running")
        .when(e == "purchase", "completed").otherwise("failed").alias("status"),
        F.least(F.col("value"), F.lit(100.0)).alias("progress"),
        F.floor(F.col("value") / F.lit(50.0)).cast("int").alias("epoch"),
        F.when(e != "error", F.col("value") / F.lit(100.0)).alias("loss"),
        F.when(e == "error", F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" failed"))).alias("error"))


def text_pairs(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DataFrame:
    """Every document with the next one of its language (the last with the first).  Only ids are ranked; the
    texts, or what ``texts`` (doc_id, text) has in their place, are joined on afterwards."""
    docs = table(spark, sf_dir, "documents")
    texts = docs if texts is None else texts
    ranked = rank_within(docs.select("doc_id", "lang"), ["lang"], ["doc_id"], "rn")
    ranked = with_group_stats(ranked, ["lang"], {"n": F.count(F.lit(1))})
    after = ranked.select("lang", F.col("rn").alias("at"), F.col("doc_id").alias("next_id"))
    pairs = ranked.select(F.col("doc_id").alias("pair_id"), "lang", (F.col("rn") % F.col("n") + 1).alias("at")).join(after, ["lang", "at"])
    return pairs.join(texts.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("chosen")), "pair_id") \
        .join(texts.select(F.col("doc_id").alias("next_id"), F.col("text").alias("rejected")), "next_id") \
        .select("pair_id", "lang", "chosen", "rejected")


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean embedding of the label's rows."""
    e = table(spark, sf_dir, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    return dims.groupBy("label").agg(F.expr("transform(array_sort(collect_list(struct(d, x))), s -> s.x)").alias("embedding")) \
        .select(F.col("label").cast("long").alias("query_id"), "embedding")


SQL = {
    "token_logps": """token_logps AS (
SELECT l_orderkey AS seq_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos,
       l_partkey % 50 AS token_id,
       -(l_quantity / 50.0) AS logp,
       -(l_quantity / 50.0) - (l_discount + 0.0) + 0.05 AS old_logp,
       -(l_quantity / 50.0) + (l_tax + 0.0) - 0.04 AS ref_logp,
       l_extendedprice / 100000.0 AS entropy,
       l_quantity / 25.0 - 1.0 AS value,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask
FROM lineitem)""",
    "rewards": """rewards AS (
SELECT seq_id AS prompt_id, pos AS gen, logp + 1.0 AS r1,
       CASE WHEN mask = 0 THEN NULL ELSE entropy END AS r2,
       token_id, logp, old_logp, ref_logp
FROM token_logps)""",
    "pair_logps": """odd_logps AS (
SELECT seq_id, pos, logp, ref_logp, row_number() OVER (PARTITION BY seq_id % 64 ORDER BY seq_id) AS rn FROM (
  SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM token_logps) WHERE pos = n - 1 AND pos % 2 = 0),
two_logps AS (
SELECT c.seq_id, c.pos, c.logp AS cl, r.logp AS rl, c.ref_logp AS cr, r.ref_logp AS rr
FROM token_logps c JOIN token_logps r ON c.seq_id = r.seq_id AND c.pos % 2 = 0 AND r.pos = c.pos + 1
UNION ALL SELECT c.seq_id, c.pos, c.logp, r.logp, c.ref_logp, r.ref_logp
FROM odd_logps c LEFT JOIN odd_logps r ON r.seq_id % 64 = c.seq_id % 64 AND r.rn = c.rn + 1 WHERE c.rn % 2 = 1),
pair_logps AS (
SELECT seq_id AS pair_id, pos // 2 AS pair_no, seq_id % 64 AS batch_id, cl - 0.001 AS policy_chosen, rl - 0.001 AS policy_rejected,
       cr - 0.05 AS ref_chosen, rr - 0.05 AS ref_rejected
FROM two_logps)""",
    "binary_logps": """binary_logps AS (
SELECT seq_id AS row_id, seq_id % 64 AS batch_id, mask = 1 AS label,
       logp AS policy_logp, ref_logp, old_logp AS policy_kl_logp, ref_logp AS ref_kl_logp
FROM token_logps)""",
    "dataset_catalog": """dataset_catalog AS (
SELECT CAST(dense_rank() OVER (ORDER BY source) AS INT) AS dataset_id, source AS name,
       count(*) AS row_count, CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM documents GROUP BY source)""",
    "allocations": """allocations AS (
SELECT CAST((dataset_id - 1) % 5 AS INT) AS project_id,
       CASE dataset_id % 3 WHEN 0 THEN 'reasoning' WHEN 1 THEN 'coding' ELSE 'general_tools' END AS trait_type,
       dataset_id, CAST((dataset_id * 17) % 101 AS DOUBLE) + 0.33 AS percentage
FROM dataset_catalog)""",
    "jobs": """jobs AS (
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'queued' ELSE 'running' END AS status,
       o_orderdate AS created_at, o_custkey AS dataset_id, o_totalprice AS amount
FROM orders)""",
    "projects": """projects AS (
SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'failed' WHEN 'MACHINERY' THEN 'running' ELSE 'pending' END AS status,
       c_acctbal AS amount
FROM customer)""",
    "run_events": """run_events AS (
SELECT event_id, user_id AS run_id, ts,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
       least(value, 100.0) AS progress, CAST(floor(value / 50.0) AS INT) AS epoch,
       CASE WHEN event_type = 'error' THEN NULL ELSE value / 100.0 END AS loss,
       CASE WHEN event_type = 'error' THEN 'event ' || event_id || ' failed' END AS error
FROM events)""",
    "text_pairs": """text_pairs AS (
SELECT doc_id AS pair_id, lang, text AS chosen, coalesce(lead(text) OVER w, first_value(text) OVER w) AS rejected
FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id))""",
    "label_queries": """label_queries AS (
SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY d) AS embedding FROM (
  SELECT label, d, avg(CAST(x AS DOUBLE)) AS x FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) u
  GROUP BY label, d) m GROUP BY label)""",
}


def ctes(*names: str) -> str:
    """``WITH`` clause for the named derived tables, in the given order."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
