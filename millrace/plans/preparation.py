"""Dataset preparation over the driver tables (PREP-1..18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import apply_chat_template, render_training_text
from ..functions.tokens import hashed_words, word_id
from ..operators import catalog as cat
from ..operators import preparation as prep
from ..tables import allocations, ctes, dataset_catalog, pair_logps, table, text_pairs
from .registry import query
from .scalars import PAIR_TOKENS_SQL, VOCAB, sql_words

SEED = 7


def quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to take per project and source."""
    c = dataset_catalog(spark, sf)
    rows = cat.allocate_rows(allocations(c), c)
    return rows.join(c.select("dataset_id", F.col("name").alias("source")), "dataset_id") \
        .select("source", "project_id", "dataset_id", F.col("rows").alias("k"))


QUOTA_SQL = ctes("dataset_catalog", "allocations") + f""", quotas AS (
SELECT name AS source, project_id, dataset_id, sum(CAST(trunc(row_count * percentage / 100.0) AS BIGINT)) AS k
FROM allocations JOIN dataset_catalog USING (dataset_id) GROUP BY name, project_id, dataset_id),
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || doc_id)) AS rn FROM documents d),
sampled AS (SELECT project_id, dataset_id, doc_id, source, text, n_chars FROM ranked JOIN quotas USING (source) WHERE rn <= k)
"""


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    return prep.mix_datasets(table(spark, sf, "documents"), quotas(spark, sf), "source", ["doc_id"], SEED)


@query("sample_exact", QUOTA_SQL + "SELECT source, doc_id FROM sampled")
def sample_exact(spark, sf):
    q = quotas(spark, sf).select("source", "k")
    return prep.sample_exact(table(spark, sf, "documents").select("source", "doc_id"), q, "source", ["doc_id"], SEED)


@query("mix_datasets", QUOTA_SQL + "SELECT project_id, dataset_id, doc_id, text FROM sampled")
def mix_datasets(spark, sf):
    m = mixed(spark, sf)
    return m.select("project_id", "dataset_id", "doc_id", render_training_text(m).alias("text"))


@query("mix_datasets_counts", QUOTA_SQL + """
SELECT project_id, dataset_id, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM sampled GROUP BY project_id, dataset_id""")
def mix_datasets_counts(spark, sf):
    m = mixed(spark, sf)
    return m.groupBy("project_id", "dataset_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length(render_training_text(m))).alias("chars"))


@query("sample_with_replacement", f"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
d AS (SELECT i AS draw, CAST('0x' || substr(md5('{SEED}:' || i), 1, 12) AS BIGINT) % n AS idx
      FROM n, range(512) r(i) WHERE i < n),
e AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings)
SELECT draw, vec_id, label FROM d JOIN e USING (idx)""")
def sample_with_replacement(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return prep.sample_with_replacement(e, "vec_id", 512, SEED)


@query("apply_chat_template", f"""
SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS text, count(*) AS turns
FROM conversations GROUP BY conv_id""")
def apply_template(spark, sf):
    return apply_chat_template(table(spark, sf, "conversations"))


@query("extract_prompt", f"""
WITH g AS (SELECT conv_id, list(role || ': ' || text ORDER BY turn) AS m FROM conversations GROUP BY conv_id)
SELECT conv_id, m[1:len(m) - 1] AS prompt, [m[len(m)]] AS chosen, [m[len(m)] || '!'] AS rejected FROM g""")
def extract_prompt(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
                    lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"))).alias("chosen"))
    last = F.size("chosen") - 1
    g = g.withColumn("rejected", F.transform("chosen", lambda m, i: F.when(
        i == last, F.struct(m["role"].alias("role"), F.concat(m["text"], F.lit("!")).alias("text"))).otherwise(m)))
    out = prep.extract_prompt_messages(F.col("chosen"), F.col("rejected"))
    return g.select("conv_id", *[
        F.transform(v, lambda m: F.concat(m["role"], F.lit(": "), m["text"])).alias(k) for k, v in out.items()])


@query("extract_prompt_text", """
WITH p AS (SELECT c.doc_id AS pair_id, c.text || 'A' AS chosen, c.text || 'B' || c.lang AS rejected, c.text FROM documents c)
SELECT pair_id, text AS prompt, 'A' AS chosen, substr(rejected, length(text) + 1) AS rejected FROM p""")
def extract_prompt_text(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pair_id"), F.concat("text", F.lit("A")).alias("c"),
        F.concat("text", F.lit("B"), "lang").alias("r"))
    out = prep.extract_prompt_text(F.col("c"), F.col("r"))
    return d.select("pair_id", *[v.alias(k) for k, v in out.items()])


@query("unpair_preferences", ctes("text_pairs") + """
SELECT pair_id, lang, chosen AS completion, true AS label FROM text_pairs
UNION ALL SELECT pair_id, lang, rejected, false FROM text_pairs""")
def unpair_preferences(spark, sf):
    return prep.unpair_preferences(text_pairs(spark, sf), ["pair_id", "lang"])


@query("tokenize", f"""
SELECT doc_id, CASE WHEN starts_with(text, 'The ') THEN ids ELSE list_prepend(1, ids) END AS input_ids
FROM (SELECT doc_id, text, {sql_words('text')} AS ids FROM documents)""")
def tokenize(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return prep.tokenize(d, "text", lambda t: hashed_words(t, VOCAB, "md5"), bos=1, bos_text="The ").drop("text")


@query("tokenize_truncated", f"""
SELECT doc_id, (CASE WHEN starts_with(text, 'The ') THEN ids ELSE list_prepend(1, ids) END)[1:128] AS input_ids
FROM (SELECT doc_id, text, {sql_words('text')} AS ids FROM documents)""")
def tokenize_truncated(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return prep.tokenize(d, "text", lambda t: hashed_words(t, VOCAB, "md5"), 128, bos=1, bos_text="The ").drop("text")


@query("detokenize", f"""
WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')) AS w FROM documents),
v AS (SELECT CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {VOCAB} AS id, min(w) AS w FROM w GROUP BY 1),
a AS (SELECT list(w ORDER BY i) AS vocab FROM range({VOCAB}) r(i) LEFT JOIN v ON v.id = i)
SELECT doc_id, array_to_string(list_transform({sql_words('text')}, lambda i: vocab[i + 1]), ' ') AS text FROM documents, a""")
def detokenize(spark, sf):
    d = table(spark, sf, "documents")
    words = d.select(F.explode(F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")).alias("w"))
    vocab = prep.vocabulary(words, "w", lambda w: word_id(w, VOCAB, "md5"), VOCAB)
    return prep.detokenize(d.select("doc_id", hashed_words(F.col("text"), VOCAB, "md5").alias("ids")), "ids", vocab).drop("ids")


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"[ \n]+"), lambda w: w != ""))
    return table(spark, sf, "documents").select("doc_id", words.alias("n"))


LENGTHS_SQL = "l AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')) AS n FROM documents)"


@query("pack_sequences")
def pack_sequences(spark, sf):
    return prep.pack_sequences(_lengths(spark, sf), "doc_id", "n", 512)


@query("pack_sequences_totals", "WITH " + LENGTHS_SQL + """
SELECT count(*) FILTER (n > 0) AS sequences, CAST(sum(n) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS overlapping FROM l""")
def pack_sequences_totals(spark, sf):
    p = prep.pack_sequences(_lengths(spark, sf), "doc_id", "n", 512)
    bins = p.groupBy("bin").agg(F.sum("len").alias("fill"), F.max(F.col("offset") + F.col("len")).alias("end"))
    bad = bins.agg(F.count_if(F.col("fill") > 512).alias("overfull"), F.count_if(F.col("fill") != F.col("end")).alias("overlapping"))
    return p.agg(F.count_distinct("doc_id").alias("sequences"), F.sum("len").alias("tokens")) \
        .withColumn("overfull", bad.select("overfull").scalar()).withColumn("overlapping", bad.select("overlapping").scalar())


@query("pack_sequences_wrapped", "WITH " + LENGTHS_SQL + """,
a AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at0 FROM l),
b AS (SELECT *, unnest(range(at0 // 512, (at0 + n - 1) // 512 + 1)) AS bin FROM a WHERE n > 0)
SELECT doc_id, greatest(at0, bin * 512) - at0 AS start, least(at0 + n, (bin + 1) * 512) - greatest(at0, bin * 512) AS len,
  bin, greatest(at0, bin * 512) - bin * 512 AS offset FROM b""")
def pack_sequences_wrapped(spark, sf):
    return prep.pack_sequences(_lengths(spark, sf), "doc_id", "n", 512, "wrapped")


@query("filter_by_length", PAIR_TOKENS_SQL + "SELECT pair_id, len(p) AS n_chosen, len(c) AS n_rejected FROM t WHERE len(p) <= 256 AND len(c) <= 256")
def filter_by_length(spark, sf):
    t = text_pairs(spark, sf).select("pair_id", hashed_words(F.col("chosen"), VOCAB, "md5").alias("p"),
                                     hashed_words(F.col("rejected"), VOCAB, "md5").alias("c"))
    return prep.filter_by_length(t, 256, "p", "c").select("pair_id", F.size("p").cast("long").alias("n_chosen"), F.size("c").cast("long").alias("n_rejected"))


@query("split_by_label", """
SELECT d.doc_id, CASE WHEN quality = 1 THEN 'desirable' ELSE 'undesirable' END AS side, text FROM documents d JOIN labels USING (doc_id)""")
def split_by_label(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id") \
        .select("doc_id", "text", (F.col("quality") == 1).alias("label"))
    good, bad = prep.split_by_label(d)
    return good.withColumn("side", F.lit("desirable")).unionByName(bad.withColumn("side", F.lit("undesirable"))).drop("label")


@query("mismatch_pairs", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM conversations),
b AS (SELECT *, idx // 8 AS batch_id FROM r)
SELECT conv_id, turn, role, text, idx, batch_id,
  coalesce(lag(text) OVER (PARTITION BY batch_id ORDER BY idx),
    last_value(text) OVER (PARTITION BY batch_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS KL_text
FROM b""")
def mismatch_pairs(spark, sf):
    return prep.mismatch_pairs(table(spark, sf, "conversations"), ["conv_id", "turn"], "role", "text", 8)


@query("class_balance_bounds", """
WITH c AS (SELECT greatest(count(*) FILTER (quality = 1), 1) AS d, count(*) AS n FROM labels),
k AS (SELECT d, greatest(n - d, 1) AS u FROM c)
SELECT d AS num_desirable, u AS num_undesirable, round_even(u * 1.0::DOUBLE / d, 2) AS des_lower, round_even(u * 1.0::DOUBLE / d * 1.33::DOUBLE, 2) AS des_upper,
  round_even(d * 1.0::DOUBLE / u / 1.33::DOUBLE, 2) AS und_lower, round_even(d * 1.0::DOUBLE / u, 2) AS und_upper,
  NOT (1.0 BETWEEN round_even(u * 1.0::DOUBLE / d, 2) AND round_even(u * 1.0::DOUBLE / d * 1.33::DOUBLE, 2)
    OR 1.0 BETWEEN round_even(d * 1.0::DOUBLE / u / 1.33::DOUBLE, 2) AND round_even(d * 1.0::DOUBLE / u, 2)) AS warn
FROM k WHERE d <> u""")
def class_balance_bounds(spark, sf):
    return prep.class_balance_bounds(table(spark, sf, "labels").withColumn("label", F.col("quality") == 1), "label")


@query("repeat_prompts", """
WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part)
SELECT (idx // 8) * 2 + r AS step, (idx % 8) * 4 + g AS pos, p_partkey FROM p, range(2) a(r), range(4) b(g)""")
def repeat_prompts(spark, sf):
    return prep.repeat_prompts(table(spark, sf, "part"), "p_partkey", 8, 4, 2, seed=None)


@query("repeat_prompts_shuffled", f"""
WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('{SEED}:' || p_partkey), p_partkey) - 1 AS idx FROM part)
SELECT (idx // 8) * 2 + r AS step, (idx % 8) * 4 + g AS pos, p_partkey FROM p, range(2) a(r), range(4) b(g)""")
def repeat_prompts_shuffled(spark, sf):
    return prep.repeat_prompts(table(spark, sf, "part"), "p_partkey", 8, 4, 2, seed=SEED)


@query("shuffle_and_slice_buffer", f"""
WITH p AS (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 32 AS buf FROM part),
s AS (SELECT *, row_number() OVER (PARTITION BY buf ORDER BY md5('{SEED}:' || p_partkey), p_partkey) AS rn, count(*) OVER (PARTITION BY buf) AS n FROM p)
SELECT buf * 8 + i * 4 + ((rn - 1) * 4) // n AS step, ((rn - 1) * 4) // n AS slice, p_partkey FROM s, range(2) a(i)""")
def shuffle_and_slice_buffer(spark, sf):
    return prep.shuffle_and_slice_buffer(table(spark, sf, "part"), "p_partkey", 32, 4, 2, seed=SEED)


@query("attach_reference_scores", ctes("token_logps", "pair_logps") + """
SELECT pair_id, pair_no, policy_chosen, CASE WHEN policy_rejected < -0.5 THEN ref_chosen END AS ref_chosen_logps FROM pair_logps""")
def attach_reference_scores(spark, sf):
    p = pair_logps(spark, sf)
    scores = p.filter("policy_rejected < -0.5").select("pair_id", "pair_no", F.col("ref_chosen").alias("ref_chosen_logps"))
    return prep.attach_reference_scores(p.select("pair_id", "pair_no", "policy_chosen"), scores, ["pair_id", "pair_no"], ["ref_chosen_logps"])


@query("drop_duplicate_prompts", """
SELECT text, conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS rn FROM conversations) WHERE rn = 1""")
def drop_duplicate_prompts(spark, sf):
    return prep.drop_duplicate_prompts(table(spark, sf, "conversations"), "text", ["conv_id", "turn"])


@query("sample_review_rows", f"""
SELECT doc_id, prompt, substr(text, length(prompt) + 1) AS text, round(score, 4) AS score FROM (
  SELECT d.doc_id, d.lang AS prompt, d.lang || d.text AS text, n_chars / 7.0 AS score FROM documents d JOIN labels USING (doc_id)
  WHERE quality = 0 ORDER BY md5('{SEED}:' || d.doc_id), d.doc_id LIMIT 10)""")
def sample_review_rows(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 0"), "doc_id").select(
        "doc_id", F.col("lang").alias("prompt"), F.concat("lang", "text").alias("text"), (F.col("n_chars") / 7.0).alias("score"))
    return prep.sample_review_rows(d, "doc_id", 10, "prompt", ["text"], ["score"], SEED)
