"""Scalar functions over the driver tables (FN-1..14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, numeric, text, tokens
from ..functions.numeric import rnd
from ..operators.preparation import step_examples
from ..scale import spread
from ..session import materialise
from ..tables import ctes, table, text_pairs, token_logps
from .registry import query

VOCAB = 1000


def sql_words(text_sql: str, vocab: int = VOCAB) -> str:
    return (f"list_transform(list_filter(regexp_split_to_array({text_sql}, '[ \\n]+'), lambda w: w <> ''), "
            f"lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {vocab})")


def sequence_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Token arrays, one row per sequence."""
    t = token_logps(spark, sf)
    s = F.sort_array(F.collect_list(F.struct("pos", "token_id", "logp", "mask")))
    return t.groupBy("seq_id").agg(s.alias("s")).select(
        "seq_id", F.col("s.token_id").alias("ids"), F.col("s.logp").alias("logps"),
        F.col("s.mask").alias("mask"))


SEQ_SQL = ctes("token_logps") + """, seqs AS (
SELECT seq_id, list(token_id ORDER BY pos) AS ids, list(logp ORDER BY pos) AS logps,
       list(mask ORDER BY pos) AS mask FROM token_logps GROUP BY seq_id)
"""


@query("sanitize_name", r"""
SELECT page_id, CASE WHEN x = '' THEN 'unnamed' ELSE x END AS name,
  CASE WHEN y = '' THEN 'project' ELSE y END AS project_name
FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(' ..' || url || '. .', '[<>:"/\\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), '_+', '_', 'g') AS x,
  trim(lower(regexp_replace(regexp_replace(regexp_replace(url || ' .  x..', '[<>:"/\\|?*]', '_', 'g'), '\s+', '-', 'g'), '\.+$', ''))) AS y FROM pages)""")
def sanitize_name(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", names.sanitize_name(F.concat(F.lit(" .."), u, F.lit(". ."))).alias("name"),
        names.sanitize_project_name(F.concat(u, F.lit(" .  x.."))).alias("project_name"))


@query("parse_dataset_filename", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '//([^./]*)', 1) AS host, regexp_extract(url, '/([^/?]*)/[^/]*$', 1) AS lang, url FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN host WHEN 1 THEN 'train' ELSE 'user' END AS author,
  CASE page_id % 4 WHEN 0 THEN lang || '_set' WHEN 1 THEN host || '_' || lang || '_train' WHEN 2 THEN 'unknown' ELSE host || '_' || lang END AS name
FROM p""")
def parse_dataset_filename(spark, sf):
    host = F.regexp_extract("url", r"//([^./]*)", 1)
    lang = F.regexp_extract("url", r"/([^/?]*)/[^/]*$", 1)
    kind = F.col("page_id") % 4
    f = F.when(kind == 0, F.concat(F.lit("hf_"), host, F.lit("_"), lang, F.lit("_set_train_7.json"))) \
        .when(kind == 1, F.concat(F.lit("hf_train_"), host, F.lit("_"), lang, F.lit("_train.json"))) \
        .when(kind == 2, F.concat(F.md5(F.col("url").cast("binary")), F.lit(".csv"))) \
        .otherwise(F.concat(host, F.lit("_"), lang, F.lit(".json")))
    return table(spark, sf, "pages").select("page_id", names.parse_dataset_filename(f).alias("p")) \
        .select("page_id", "p.author", "p.name")


@query("split_repo_id", """
WITH p AS (SELECT p_partkey, CASE WHEN p_size < 25 THEN p_brand || '/' || p_name || '/x' ELSE p_name END AS id,
  CASE WHEN p_type = 'PROMO' THEN 'cfg' END AS cfg FROM part)
SELECT p_partkey, CASE WHEN contains(id, '/') THEN split_part(id, '/', 1) ELSE 'huggingface' END AS author,
  CASE WHEN contains(id, '/') THEN substr(id, strpos(id, '/') + 1) ELSE id END || coalesce('_' || cfg, '') AS name,
  id || ' (train)' || coalesce(' - ' || cfg, '') AS display
FROM p""")
def split_repo_id(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") < 25, F.concat_ws("/", "p_brand", "p_name", F.lit("x"))).otherwise(F.col("p_name")).alias("id"),
        F.when(F.col("p_type") == "PROMO", "cfg").alias("cfg"))
    return p.select("p_partkey", names.split_repo_id(F.col("id"), config=F.col("cfg")).alias("r"),
                    names.display_name(F.col("id"), F.lit("train"), F.col("cfg")).alias("display")) \
        .select("p_partkey", "r.author", "r.name", "display")


@query("map_alias", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'top' WHEN '2-HIGH' THEN 'high' ELSE 'other' END AS with_default,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'top' WHEN '2-HIGH' THEN 'high' ELSE o_orderpriority END AS passed
FROM orders""")
def map_alias(spark, sf):
    aliases = {"1-URGENT": "top", "2-HIGH": "high"}
    c = F.col("o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", names.map_alias(c, aliases, "other").alias("with_default"),
                                             names.map_alias(c, aliases).alias("passed"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Ragged JSON records from the conversation turns."""
    t, r, none = F.col("text"), F.col("role"), F.lit(None).cast("string")
    opts = {"ignoreNullFields": "false"}
    raw = F.when(F.col("turn") == 0, F.to_json(F.struct(none.alias("text"), t.alias("instruction")), opts)) \
        .when(F.col("turn") == 1, F.to_json(F.struct(r.alias("input"), t.alias("output")), opts)) \
        .when(F.col("turn") == 2, F.to_json(F.struct(t.alias("instruction"), r.alias("response")), opts)) \
        .when(F.col("turn") == 3, F.to_json(F.struct(t.alias("z"), none.alias("y"), r.alias("content")), opts)) \
        .when(F.col("turn") == 4, F.to_json(F.struct(t.alias("input")), opts)).otherwise(t)
    return table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))


@query("render_training_text", """
SELECT 'c' || conv_id || '-' || turn AS row_id, CASE turn WHEN 0 THEN NULL WHEN 1 THEN role || chr(10) || text
  WHEN 2 THEN '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) || role
  WHEN 3 THEN text || ' None ' || role ELSE text END AS text FROM conversations
UNION ALL SELECT 'd' || doc_id, text FROM documents""")
def render_training_text(spark, sf):
    m = text.json_map(F.col("raw"))
    ragged = _records(spark, sf).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("row_id"),
        text.render_map_text(m, F.col("raw")).alias("text"))
    d = table(spark, sf, "documents")
    uniform = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("row_id"),
                       text.render_training_text(d).alias("text"))
    return ragged.unionByName(uniform)


@query("extract_document_text", """
SELECT conv_id, turn, CASE turn WHEN 0 THEN NULL WHEN 3 THEN role ELSE '-' END AS text,
  turn NOT IN (0, 3) AS is_raw FROM conversations""")
def extract_document_text(spark, sf):
    m = text.json_map(F.col("raw"))
    out = text.extract_document_text(m, F.col("raw"))
    keyed = F.coalesce(F.map_contains_key(m, F.lit("text")) | F.map_contains_key(m, F.lit("content")), F.lit(False))
    return _records(spark, sf).select("conv_id", "turn", F.when(keyed, out).otherwise(
        F.when(out == F.col("raw"), "-").otherwise("wrong")).alias("text"), (~keyed).alias("is_raw"))


def _pair_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of both sides.  Every document is on two sides, so its ids are made once and written."""
    ids = materialise(spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", tokens.hashed_words(F.col("text"), VOCAB, "md5").alias("text")))
    return text_pairs(spark, sf, ids).select("pair_id", F.col("chosen").alias("p"), F.col("rejected").alias("c"))


PAIR_TOKENS_SQL = ctes("text_pairs") + f""", t AS (
SELECT pair_id, {sql_words('chosen')} AS p, {sql_words('rejected')} AS c FROM text_pairs)
"""


@query("truncate_tokens", PAIR_TOKENS_SQL + """
SELECT pair_id, list_slice(p, greatest(len(p) - 511, 1), len(p)) AS prompt_ids,
  list_slice(list_append(c, 2), 1, 256) AS completion_ids,
  list_slice(p, greatest(len(p) + len(c) - 600, 0) + 1, len(p)) AS combined_ids
FROM t""")
def truncate_tokens(spark, sf):
    return _pair_tokens(spark, sf).select(
        "pair_id", tokens.truncate_prompt(F.col("p"), 512).alias("prompt_ids"),
        tokens.truncate_completion(F.col("c"), 256, 2).alias("completion_ids"),
        tokens.truncate_left_combined(F.col("p"), F.col("c"), 600).alias("combined_ids"))


@query("budget_pair_tokens", PAIR_TOKENS_SQL + """, b AS (
SELECT pair_id, [len(p), len(c), 7] AS prompt, p AS chosen, c AS rejected, greatest(len(p), len(c)) AS longer FROM t),
d AS (SELECT *, CASE WHEN 3 + longer > 300 THEN prompt[2:3] ELSE prompt END AS pr FROM b),
e AS (SELECT *, CASE WHEN len(pr) + longer > 300 THEN chosen[1:298] ELSE chosen END AS ca,
  CASE WHEN len(pr) + longer > 300 THEN rejected[1:298] ELSE rejected END AS ra FROM d)
SELECT pair_id, pr AS prompt_ids, list_concat(pr, ca) AS chosen_ids, list_concat(list_transform(pr, lambda x: -100), ca) AS chosen_labels,
  list_concat(pr, ra) AS rejected_ids, list_concat(list_transform(pr, lambda x: -100), ra) AS rejected_labels, true AS agree FROM e""")
def budget_pair_tokens(spark, sf):
    t = _pair_tokens(spark, sf).withColumn(
        "prompt", F.array(F.size("p").cast("long"), F.size("c").cast("long"), F.lit(7).cast("long")))
    out = tokens.budget_pair(F.col("prompt"), F.col("prompt"), F.col("p"), F.col("c"), 300, 2)
    return t.select("pair_id", *[v.alias(k) for k, v in out.items()],
                    tokens.prompts_agree(F.col("prompt"), F.col("prompt")).alias("agree"))


def _sql_marked(bos: str, ids: str) -> str:
    return f"CASE WHEN len({ids}) > 0 AND {ids}[1] = {bos} THEN {ids} ELSE list_prepend({bos}, {ids}) END"


def _sql_ended(ids: str, eos: str) -> str:
    return f"CASE WHEN len({ids}) > 0 AND {ids}[len({ids})] = {eos} THEN {ids} ELSE list_append({ids}, {eos}) END"


# odd pairs glue the answer to the prompt's last word; of three rejected sides one has its own prompt, one another last word
@query("budget_pair_specials", ctes("text_pairs") + f""", x AS (
SELECT pair_id, 'answer in ' || lang || ' for ' || pair_id AS pc,
  CASE pair_id % 3 WHEN 0 THEN 'reply to ' || lang || ' for ' || pair_id WHEN 1 THEN 'answer in ' || lang || ' for ' || (pair_id + 1)
    ELSE 'answer in ' || lang || ' for ' || pair_id END AS pr,
  CASE WHEN pair_id % 2 = 0 THEN ' ' ELSE '' END || coalesce(chosen, '') AS a, ' ' || coalesce(rejected, '') AS b FROM text_pairs),
t AS (SELECT pair_id, {sql_words('pc')} AS pc, {sql_words('pr')} AS pr, {sql_words('pc || a')} AS fc, {sql_words('pr || b')} AS fr FROM x),
u AS (SELECT *, len(pc) - CASE WHEN fc[1:len(pc)] = pc THEN 0 ELSE 1 END AS nc, len(pr) - CASE WHEN fr[1:len(pr)] = pr THEN 0 ELSE 1 END AS nr FROM t),
v AS (SELECT pair_id, {_sql_marked('1', 'pc[1:least(nc, nr)]')} AS p, {_sql_marked('1', 'fc[1:nc]')} AS p1, {_sql_marked('1', 'fr[1:nr]')} AS p2,
  {_sql_ended('fc[nc + 1:len(fc)]', '2')} AS a1, {_sql_ended('fr[nr + 1:len(fr)]', '2')} AS a2,
  len(list_filter(range(1, least(nc, nr) + 1), lambda i: fc[i] <> fr[i])) <= 1 AND abs(nc - nr) <= 1 AS agree FROM u),
w AS (SELECT *, greatest(len(a1), len(a2)) AS longer FROM v),
y AS (SELECT pair_id, agree, longer, a1, a2, CASE WHEN len(p) + longer > 120 THEN p[len(p) - 3:len(p)] ELSE p END AS p,
  CASE WHEN len(p1) + longer > 120 THEN p1[len(p1) - 3:len(p1)] ELSE p1 END AS p1, CASE WHEN len(p2) + longer > 120 THEN p2[len(p2) - 3:len(p2)] ELSE p2 END AS p2 FROM w),
z AS (SELECT *, CASE WHEN len(p1) + longer > 120 THEN a1[1:116] ELSE a1 END AS b1, CASE WHEN len(p2) + longer > 120 THEN a2[1:116] ELSE a2 END AS b2 FROM y)
SELECT pair_id, p AS prompt_ids, list_concat(p1, b1) AS chosen_ids, list_concat(list_transform(p1, lambda x: -100), b1) AS chosen_labels,
  list_concat(p2, b2) AS rejected_ids, list_concat(list_transform(p2, lambda x: -100), b2) AS rejected_labels, agree FROM z""")
def budget_pair_specials(spark, sf):
    said = F.concat(F.lit("answer in "), F.col("lang"), F.lit(" for "), F.col("pair_id").cast("string"))
    kind = F.col("pair_id") % 3
    t = text_pairs(spark, sf).select(
        "pair_id", said.alias("pc"),
        F.when(kind == 0, F.concat(F.lit("reply to "), F.col("lang"), F.lit(" for "), F.col("pair_id").cast("string")))
        .when(kind == 1, F.concat(F.lit("answer in "), F.col("lang"), F.lit(" for "), (F.col("pair_id") + 1).cast("string"))).otherwise(said).alias("pr"),
        F.concat(F.when(F.col("pair_id") % 2 == 0, " ").otherwise(""), F.coalesce("chosen", F.lit(""))).alias("a"),
        F.concat(F.lit(" "), F.coalesce("rejected", F.lit(""))).alias("b"))

    def ids(*parts: str):
        return tokens.hashed_words(F.concat(*parts), VOCAB, "md5")
    t = t.select("pair_id", ids("pc").alias("pc"), ids("pr").alias("pr"), ids("pc", "a").alias("fc"), ids("pr", "b").alias("fr"))
    (p1, a1), (p2, a2) = (tokens.answer_parts(F.col(p), F.col(f)) for p, f in (("pc", "fc"), ("pr", "fr")))
    t = t.select("pair_id", "pc", p1.alias("p1"), a1.alias("a1"), p2.alias("p2"), a2.alias("a2"))
    out = tokens.budget_pair(F.col("p1"), F.col("p2"), F.col("a1"), F.col("a2"), 120, 4, bos=1, eos=2, prompt=F.col("pc"))
    return t.select("pair_id", *[v.alias(k) for k, v in out.items()], tokens.prompts_agree(F.col("p1"), F.col("p2")).alias("agree"))


def _sql_steps(last_only: bool) -> str:
    label = "CASE WHEN rn = n THEN label ELSE -100 END" if last_only else "label"
    return f"""
WITH s AS (SELECT conv_id, {sql_words('text')} AS ids, CAST(role = 'assistant' AS BIGINT) AS label,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
g AS (SELECT conv_id, list_prepend(1, any_value(ids) FILTER (rn = 1)) AS p,
  coalesce(flatten(list(list_append(ids, 0) ORDER BY rn) FILTER (rn > 1)), []) AS c,
  coalesce(flatten(list(list_append(list_transform(ids, lambda x: -100), {label}) ORDER BY rn) FILTER (rn > 1)), []) AS l FROM s GROUP BY conv_id),
h AS (SELECT conv_id, p[greatest(len(p) - 11, 1):len(p)] AS p, c[1:60] AS c, l[1:60] AS l FROM g)
SELECT conv_id, list_concat(p, c)[1:64] AS input_ids, list_concat(list_transform(p, lambda x: -100), l)[1:64] AS labels FROM h"""


def _step_examples(spark: SparkSession, sf: str, last_only: bool) -> DataFrame:
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", tokens.hashed_words(F.col("text"), VOCAB, "md5").alias("ids"), (F.col("role") == "assistant").alias("label"))
    return step_examples(c, "conv_id", ["turn"], "ids", "label", 0, 60, max_prompt=12, max_len=64, bos=1, last_only=last_only)


@query("step_examples", _sql_steps(False))
def step_examples_all(spark, sf):
    return _step_examples(spark, sf, False)


@query("step_examples_last", _sql_steps(True))
def step_examples_last(spark, sf):
    return _step_examples(spark, sf, True)


@query("step_labels", f"""
WITH s AS (SELECT conv_id, turn,
  {sql_words('text')} AS ids, CAST(role = 'assistant' AS BIGINT) AS label FROM conversations)
SELECT conv_id, list_concat([1], flatten(list(list_append(ids, 0) ORDER BY turn))) AS input_ids,
  list_concat([-100], flatten(list(list_append(list_transform(ids, lambda x: -100), label) ORDER BY turn))) AS labels,
  CAST(sum(len(ids) + 1) + 1 AS BIGINT) AS n_tokens
FROM s GROUP BY conv_id""")
def step_labels(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        tokens.hashed_words(F.col("text"), VOCAB, "md5").alias("ids"), (F.col("role") == "assistant").alias("label"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "ids", "label"))).alias("s"))
    steps, labels = F.col("s.ids"), F.col("s.label")
    return g.select(
        "conv_id",
        F.array_prepend(tokens.step_ids(steps, 0), F.lit(1).cast("long")).alias("input_ids"),
        F.array_prepend(tokens.step_labels(steps, labels), F.lit(-100).cast("long")).alias("labels")) \
        .withColumn("n_tokens", F.size("labels").cast("long"))


@query("token_mask_ops", SEQ_SQL + """, l AS (SELECT *, CASE WHEN list_position(mask, 1) IS NULL OR list_position(mask, 1) = 0 THEN len(mask) ELSE list_position(mask, 1) - 1 END AS lead FROM seqs)
SELECT seq_id, len(list_filter(ids[1:3], lambda x: x = 0)) AS pads,
  list_transform(ids, lambda x, i: CAST((i - 1) >= 3 - lead AND x <> 0 AS INT)) AS completion,
  list_concat(list_filter(ids, lambda x: x <> 0), list_filter(ids, lambda x: x = 0)) AS packed,
  list_concat(list_transform(range(lead), lambda x: 0.0::DOUBLE), logps[1:len(mask) - lead]) AS aligned
FROM l""")
def token_mask_ops(spark, sf):
    s = sequence_arrays(spark, sf)
    at = F.array_position("mask", 1)
    lead = F.when(at == 0, F.size("mask").cast("long")).otherwise(at - 1)
    return s.select(
        "seq_id", tokens.pad_count(F.col("ids"), 3, 0).cast("long").alias("pads"),
        tokens.completion_mask(F.col("ids"), lead, F.lit(3), 0).alias("completion"),
        tokens.left_pack(F.col("ids"), 0).alias("packed"),
        tokens.align_logprobs(F.col("logps"), F.col("mask")).alias("aligned"))


@query("eos_mask", SEQ_SQL + """, l AS (SELECT seq_id, ids, coalesce(nullif(list_position(ids, 7), 0), 0) AS fst FROM seqs),
m AS (SELECT *, CASE WHEN fst = 0 THEN len(ids) ELSE fst END AS length FROM l),
c AS (SELECT *, list_transform(ids, lambda x, i: CASE WHEN fst > 0 AND i > fst THEN 0 ELSE x END) AS cut FROM m)
SELECT seq_id, list_transform(ids, lambda x, i: CAST(i <= length AS INT)) AS mask, length, fst > 0 AS terminated,
  list_transform(ids, lambda x, i: CAST(i <= length AND fst > 0 AS INT)) AS mask_finished, cut AS cut_ids,
  CASE WHEN coalesce(list_position(cut, 0), 0) = 0 THEN len(cut) ELSE list_position(cut, 0) - 1 END - 1 AS cut_length
FROM c""")
def eos_mask(spark, sf):
    ids = F.col("ids")
    m, m2, c = tokens.eos_mask(ids, 7), tokens.eos_mask(ids, 7, True), tokens.cut_after_stop(ids, 7, 0)
    return sequence_arrays(spark, sf).select(
        "seq_id", *[v.alias(k) for k, v in m.items()], m2["mask"].alias("mask_finished"),
        c["ids"].alias("cut_ids"), c["length"].alias("cut_length"))


@query("token_logprob", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
z AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS lse FROM e)
SELECT vec_id, round(x[label + 1] - lse, 8) AS logprob, round(lse - list_sum(list_transform(x, lambda v: exp(v - lse) * v)), 8) AS entropy
FROM z""")
def token_logprob(spark, sf):
    x = F.col("x")
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")) \
        .select("vec_id", F.round(tokens.token_logprob(x, F.col("label")), 8).alias("logprob"),
                F.round(tokens.entropy(x), 8).alias("entropy"))


@query("sequence_logprob", ctes("token_logps") + """
SELECT seq_id, round(sum(logp) FILTER (pos >= 1 AND mask = 1), 6) AS logp_sum, round(avg(logp) FILTER (pos >= 1 AND mask = 1), 6) AS logp_mean
FROM token_logps GROUP BY seq_id""")
def sequence_logprob(spark, sf):
    on = (F.col("pos") >= 1) & (F.col("mask") == 1)
    return token_logps(spark, sf).groupBy("seq_id").agg(
        F.round(F.sum(F.when(on, F.col("logp"))), 6).alias("logp_sum"),
        F.round(F.avg(F.when(on, F.col("logp"))), 6).alias("logp_mean"))


@query("step_arithmetic", """
SELECT source, lang, n, (n // 4) * 3 AS total_steps, CAST(ceil(n / 4.0) AS BIGINT) AS batches,
  round(least(99.0, (n // 2) * 100.0 / nullif((n // 4) * 3, 0)), 6) + 0.0 AS progress
FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)""")
def step_arithmetic(spark, sf):
    d = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    total = numeric.total_steps(F.col("n"), 4, 3)
    prog = numeric.progress_percent(F.floor(F.col("n") / 2), F.nullif(total, F.lit(0)))
    return d.select("source", "lang", "n", total.alias("total_steps"), numeric.batch_count(F.col("n"), 4).alias("batches"),
                    rnd(prog).alias("progress"))


@query("nested_names", """
SELECT event_id, CASE event_type WHEN 'error' THEN [] WHEN 'view' THEN ['view', '', 'n'] ELSE ['', event_type] END AS names FROM events""")
def nested_names(spark, sf):
    e = F.col("event_type")
    js = F.when(e == "view", F.concat(F.lit('[{"config_name":"'), e, F.lit('","name":"z"},"s",'), F.col("props"), F.lit(',{"name":"n"}]'))) \
        .when(e != "error", F.concat(F.lit("["), F.col("props"), F.lit(',7,{"name":"'), e, F.lit('"}]')))
    return table(spark, sf, "events").select("event_id", text.nested_names(js).alias("names"))


