"""Rewards and policy-gradient tables over the derived tables (RL-1..15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd, sql_rnd
from ..operators import reward as rl
from ..tables import LINE_ORDER, ctes, rewards, table, token_logps, tokens_unordered
from .registry import query

TOK = ctes("token_logps")
REW = ctes("token_logps", "rewards")
ADV_SQL = "(((seq_id % 7) - 3) / CAST(3.0 AS DOUBLE))"


def adv():
    """A sequence-level advantage (or score) that depends on the sequence only."""
    return ((F.col("seq_id") % 7) - 3).cast("double") / F.lit(3.0)


@query("reward_matrix", REW + """
SELECT prompt_id, gen, CASE WHEN token_id < 25 THEN NULL ELSE r1 END AS fit, r2 AS clarity, token_id < 25 AND r2 IS NULL AS all_null FROM rewards""")
def reward_matrix(spark, sf):
    nan = F.lit(float("nan"))
    out = rl.reward_matrix(rewards(spark, sf), {"fit": F.when(F.col("token_id") < 25, nan).otherwise(F.col("r1")), "clarity": F.col("r2")})
    return out.select("prompt_id", "gen", "fit", "clarity", "all_null")


@query("reward_matrix_pivot", REW + "SELECT prompt_id, gen, r1 AS fit, r2 AS clarity, r1 IS NULL AND r2 IS NULL AS all_null FROM rewards")
def reward_matrix_pivot(spark, sf):
    long = rewards(spark, sf).select("prompt_id", "gen", F.explode(F.map_from_arrays(
        F.array(F.lit("fit"), F.lit("clarity")), F.array("r1", "r2"))).alias("f", "v"))
    return rl.pivot_rewards(long, ["prompt_id", "gen"], "f", "v", ["fit", "clarity"])


@query("weighted_reward", REW + f"""
SELECT prompt_id, gen, {sql_rnd('0.7 * r1 + coalesce(0.5 * r2, 0.0)', 8)} AS plain,
  {sql_rnd('least(greatest(0.7 * r1 + coalesce(0.5 * r2, 0.0), 0.1), 0.6) - 0.05 * (old_logp - ref_logp)', 8)} AS penalised FROM rewards""")
def weighted_reward(spark, sf):
    w = {"r1": 0.7, "r2": 0.5}
    return rewards(spark, sf).select(
        "prompt_id", "gen", rnd(rl.weighted_reward(w), 8).alias("plain"),
        rnd(rl.weighted_reward(w, (0.1, 0.6), F.col("old_logp") - F.col("ref_logp"), 0.05), 8).alias("penalised"))


@query("group_advantage", REW + f"""
SELECT prompt_id, gen, {sql_rnd('(r1 - avg(r1) OVER p) / (stddev_samp(r1) OVER p + 1e-4)')} AS advantage
FROM rewards WINDOW p AS (PARTITION BY prompt_id)""")
def group_advantage(spark, sf):
    return rl.group_advantage(rewards(spark, sf), "prompt_id", "r1").select("prompt_id", "gen", rnd(F.col("advantage")).alias("advantage"))


@query("group_advantage_batch", REW + f"""
SELECT prompt_id, gen, {sql_rnd('(r1 - avg(r1) OVER p) / ((SELECT stddev_samp(r1) FROM rewards) + 1e-4)')} AS advantage,
  {sql_rnd('stddev_samp(r1) OVER p')} AS group_std FROM rewards WINDOW p AS (PARTITION BY prompt_id)""")
def group_advantage_batch(spark, sf):
    out = rl.group_advantage(rewards(spark, sf), "prompt_id", "r1", "batch")
    return out.select("prompt_id", "gen", rnd(F.col("advantage")).alias("advantage"), rnd(F.col("group_std")).alias("group_std"))


@query("leave_one_out_advantage", REW + f""", a AS (
SELECT prompt_id, gen, r1 - (sum(r1) OVER p - r1) / nullif(count(*) OVER p - 1, 0) AS a FROM rewards WINDOW p AS (PARTITION BY prompt_id))
SELECT prompt_id, gen, {sql_rnd('a')} AS advantage, {sql_rnd('(a - (SELECT avg(a) FROM a)) / ((SELECT stddev_samp(a) FROM a) + 1e-4)')} AS normalised FROM a""")
def leave_one_out_advantage(spark, sf):
    r = rewards(spark, sf)
    out = rl.leave_one_out_advantage(r, "prompt_id", "r1").withColumn("plain", F.col("advantage"))
    stats = out.agg(F.struct(F.avg("plain").alias("m"), F.stddev_samp("plain").alias("s"))).scalar()
    norm = out.withColumn("_z", stats)
    return norm.select("prompt_id", "gen", rnd(F.col("plain")).alias("advantage"),
                       rnd((F.col("plain") - F.col("_z.m")) / (F.col("_z.s") + F.lit(1e-4))).alias("normalised"))


@query("leave_one_out_normalised", REW + f""", a AS (
SELECT prompt_id, gen, r1 - (sum(r1) OVER p - r1) / nullif(count(*) OVER p - 1, 0) AS a FROM rewards WINDOW p AS (PARTITION BY prompt_id))
SELECT prompt_id, gen, {sql_rnd('(a - (SELECT avg(a) FROM a)) / ((SELECT stddev_samp(a) FROM a) + 1e-4)')} AS advantage FROM a""")
def leave_one_out_normalised(spark, sf):
    out = rl.leave_one_out_advantage(rewards(spark, sf), "prompt_id", "r1", normalize=True)
    return out.select("prompt_id", "gen", rnd(F.col("advantage")).alias("advantage"))


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of a prompt (supplier) in the order of their steps."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("prompt"), "l_orderkey", *LINE_ORDER, (F.lit(1.0) - F.col("l_quantity") / F.lit(50.0)).alias("reward"))


STEPS_SQL = """WITH s AS (SELECT l_suppkey AS prompt, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, 1.0 - l_quantity / 50.0 AS reward FROM lineitem)
"""


@query("global_advantage", STEPS_SQL + f"""
SELECT prompt, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  {sql_rnd('(reward - (SELECT avg(reward) FROM s)) / ((SELECT stddev_pop(reward) FROM s) + 1e-8)')} AS advantage FROM s""")
def global_advantage(spark, sf):
    return rl.global_advantage(_steps(spark, sf), "reward").select(
        "prompt", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", rnd(F.col("advantage")).alias("advantage"))


@query("per_prompt_advantage", STEPS_SQL + f""", w AS (SELECT *, count(*) OVER b AS n, avg(reward) OVER b AS m, stddev_pop(reward) OVER b AS d FROM s
  WINDOW b AS (PARTITION BY prompt ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
SELECT prompt, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  {sql_rnd('CASE WHEN n >= 16 THEN (reward - m) / (d + 1e-8) ELSE (reward - (SELECT avg(reward) FROM s)) / ((SELECT stddev_pop(reward) FROM s) + 1e-8) END')} AS advantage FROM w""")
def per_prompt_advantage(spark, sf):
    out = rl.per_prompt_advantage(_steps(spark, sf), "prompt", ["l_orderkey", *LINE_ORDER], "reward")
    return out.select("prompt", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", rnd(F.col("advantage")).alias("advantage"))


@query("reward_metrics", TOK + f""", c AS (SELECT seq_id // 8 AS prompt, seq_id, count(*) AS length, bool_or(token_id = 7) AS finished,
  avg(value) AS f1, CASE WHEN min(mask) = 0 THEN NULL ELSE max(entropy) END AS f2 FROM token_logps GROUP BY seq_id),
r AS (SELECT *, f1 + coalesce(0.5 * f2, 0.0) AS reward FROM c),
g AS (SELECT prompt, count(*) AS n, avg(reward) AS m, stddev_samp(reward) AS s FROM r GROUP BY prompt)
SELECT {sql_rnd('avg(f1)')} AS f1_mean, {sql_rnd('stddev_samp(f1)')} AS f1_std, {sql_rnd('avg(f2)')} AS f2_mean, {sql_rnd('stddev_samp(f2)')} AS f2_std,
  {sql_rnd('avg(length)')} AS mean_length, min(length) AS min_length, max(length) AS max_length,
  {sql_rnd('coalesce(avg(length) FILTER (finished), 0.0)')} AS mean_terminated_length, coalesce(min(length) FILTER (finished), 0) AS min_terminated_length,
  coalesce(max(length) FILTER (finished), 0) AS max_terminated_length, {sql_rnd('1.0 - count(*) FILTER (finished) / count(*)')} AS clipped_ratio,
  {sql_rnd('(SELECT sum(n * m) / sum(n) FROM g)')} AS reward, {sql_rnd('(SELECT sum(n * s) / sum(n) FILTER (s IS NOT NULL) FROM g)')} AS reward_std,
  {sql_rnd('(SELECT coalesce(sum(n) FILTER (abs(s) <= 1e-8), 0) / sum(n) FROM g)')} AS frac_zero_std FROM r""")
def reward_metrics(spark, sf):
    c = tokens_unordered(spark, sf).groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("length"), F.bool_or(F.col("token_id") == 7).alias("finished"), F.avg("value").alias("f1"),
        F.when(F.min("mask") != 0, F.max("entropy")).alias("f2")) \
        .withColumn("prompt", F.floor(F.col("seq_id") / 8)).withColumn("reward", rl.weighted_reward({"f1": 1.0, "f2": 0.5}))
    out = rl.reward_metrics(c, "prompt", "reward", ["f1", "f2"], "length", "finished")
    keep = {"min_length", "max_length", "min_terminated_length", "max_terminated_length"}
    return out.select(*[F.col(n) if n in keep else rnd(F.col(n)).alias(n) for n in out.columns])


_RATIO = "exp(logp - old_logp)"
_CLIP = "least(greatest({r}, 0.8), 1.28)"
_K3 = "(exp(ref_logp - logp) - (ref_logp - logp) - 1.0)"


def _clip_sql(r: str) -> str:
    return f"-least(least({r}, 1.05) * a, {_CLIP.format(r=r)} * a)"


@query("clipped_policy_loss", TOK + f""", t AS (SELECT *, {ADV_SQL} AS a FROM token_logps)
SELECT seq_id, pos, {sql_rnd(_clip_sql(_RATIO) + ' * CASE WHEN entropy >= 0.3 THEN 1.0 ELSE 0.0 END * 0.9 + 0.04 * ' + _K3, 8)} AS loss FROM t""")
def clipped_policy_loss(spark, sf):
    loss = rl.clipped_policy_loss(F.col("logp") - F.col("old_logp"), adv(), 0.2, 0.28, delta=1.05, entropy_mask=F.col("entropy") >= 0.3,
                                  is_weight=F.lit(0.9), kl=rl.k3(F.col("logp"), F.col("ref_logp")), beta=0.04)
    return token_logps(spark, sf).select("seq_id", "pos", rnd(loss, 8).alias("loss"))


@query("clipped_policy_loss_sequence", TOK + f""", t AS (SELECT *, {ADV_SQL} AS a,
  exp(coalesce(sum(CASE WHEN mask = 1 THEN logp - old_logp END) OVER (PARTITION BY seq_id), 0.0) / greatest(sum(mask) OVER (PARTITION BY seq_id), 1)) AS r FROM token_logps)
SELECT seq_id, pos, {sql_rnd(_clip_sql('r'), 8)} AS loss FROM t""")
def clipped_policy_loss_sequence(spark, sf):
    t = rl.with_sequence_ratio(token_logps(spark, sf), "seq_id")
    return t.select("seq_id", "pos", rnd(rl.clipped_policy_loss(F.col("log_ratio"), adv(), 0.2, 0.28, delta=1.05), 8).alias("loss"))


@query("loss_reductions", TOK + f""", t AS (SELECT *, {ADV_SQL} AS a FROM token_logps),
p AS (SELECT seq_id, coalesce(sum({_clip_sql(_RATIO)}) FILTER (mask = 1), 0.0) AS s, count(*) FILTER (mask = 1) AS n FROM t GROUP BY seq_id)
SELECT {sql_rnd('avg(s / greatest(n, 1))')} AS grpo, {sql_rnd('sum(s) / sum(n)')} AS bnpo, {sql_rnd('sum(s) / (count(*) * 16)')} AS dr_grpo, {sql_rnd('sum(s) / sum(n)')} AS dapo FROM p""")
def loss_reductions(spark, sf):
    loss = rl.clipped_policy_loss(F.col("logp") - F.col("old_logp"), adv(), 0.2, 0.28, delta=1.05)
    out = rl.reduce_losses(tokens_unordered(spark, sf), "seq_id", loss, "mask", 16)
    return out.select(*[rnd(F.col(c)).alias(c) for c in out.columns])


@query("clip_and_is_metrics", TOK + f""", t AS (SELECT *, {ADV_SQL} AS a, seq_id % 16 AS b, {_RATIO} AS r, abs(old_logp - ref_logp) AS d, least(exp(old_logp - ref_logp), 2.0) AS w, {_K3} AS k FROM token_logps WHERE mask = 1),
p AS (SELECT b, avg(CASE WHEN r < 0.95 AND a < 0 THEN 1.0 ELSE 0.0 END) AS low, avg(CASE WHEN r > 1.02 AND a > 0 THEN 1.0 ELSE 0.0 END) AS high,
  avg(CASE WHEN (r < 0.95 AND a < 0) OR (r > 1.02 AND a > 0) THEN 1.0 ELSE 0.0 END) AS region, avg(k) AS kl, avg(entropy) AS entropy,
  avg(d) AS dm, max(d) AS dx, min(w) AS wn, avg(w) AS wm, max(w) AS wx FROM t GROUP BY b)
SELECT {sql_rnd('avg(low)')} AS low_mean, {sql_rnd('min(low)')} AS low_min, {sql_rnd('avg(high)')} AS high_mean, {sql_rnd('max(high)')} AS high_max,
  {sql_rnd('avg(region)')} AS region_mean, {sql_rnd('avg(kl)')} AS kl, {sql_rnd('avg(entropy)')} AS entropy, {sql_rnd('avg(dm)')} AS diff_mean,
  {sql_rnd('max(dx)')} AS diff_max, {sql_rnd('min(wn)')} AS is_min, {sql_rnd('avg(wm)')} AS is_mean, {sql_rnd('max(wx)')} AS is_max FROM p""")
def clip_and_is_metrics(spark, sf):
    t = tokens_unordered(spark, sf).withColumn("b", F.col("seq_id") % 16)
    out = rl.clip_metrics(t, "b", F.col("logp") - F.col("old_logp"), adv(), "ref_logp", "old_logp", eps_low=0.05, eps_high=0.02)
    return out.select(*[rnd(F.col(c)).alias(c) for c in out.columns])


_CAP = 1.04
_TOKEN_STATS = """avg(k) AS kl, avg(entropy) AS entropy, avg(d) AS dm, max(d) AS dx, min(w) AS wn, avg(w) AS wm, max(w) AS wx"""
_CLIP_OUT = f"""SELECT {sql_rnd('avg(low)')} AS low_mean, {sql_rnd('min(low)')} AS low_min, {sql_rnd('avg(high)')} AS high_mean, {sql_rnd('max(high)')} AS high_max,
  {sql_rnd('avg(region)')} AS region_mean, {sql_rnd('avg(kl)')} AS kl, {sql_rnd('avg(entropy)')} AS entropy, {sql_rnd('avg(dm)')} AS diff_mean,
  {sql_rnd('max(dx)')} AS diff_max, {sql_rnd('min(wn)')} AS is_min, {sql_rnd('avg(wm)')} AS is_mean, {sql_rnd('max(wx)')} AS is_max"""


def _clip_flags(high: float) -> str:
    lo, hi = "(r < 0.99 AND a < 0)", f"(r > {high} AND a > 0)"
    return ", ".join(f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) AS {n}" for n, c in (("low", lo), ("high", hi), ("region", f"{lo} OR {hi}")))


# the cap lies below the upper limit, so no token counts as clipped there
@query("clip_metrics_capped", TOK + f""", t AS (SELECT *, {ADV_SQL} AS a, seq_id % 16 AS b, least({_RATIO}, {_CAP}) AS r, abs(old_logp - ref_logp) AS d,
  least(exp(old_logp - ref_logp), 2.0) AS w, {_K3} AS k FROM token_logps WHERE mask = 1),
p AS (SELECT b, {_clip_flags(1.05)}, {_TOKEN_STATS} FROM t GROUP BY b) {_CLIP_OUT} FROM p""")
def clip_metrics_capped(spark, sf):
    t = tokens_unordered(spark, sf).withColumn("b", F.col("seq_id") % 16)
    out = rl.clip_metrics(t, "b", F.col("logp") - F.col("old_logp"), adv(), "ref_logp", "old_logp", eps_low=0.01, eps_high=0.05, delta=_CAP)
    return out.select(*[rnd(F.col(c)).alias(c) for c in out.columns])


@query("clip_metrics_sequence", TOK + f""", t AS (SELECT *, {ADV_SQL} AS a, seq_id % 16 AS b, abs(old_logp - ref_logp) AS d,
  least(exp(old_logp - ref_logp), 2.0) AS w, {_K3} AS k FROM token_logps),
s AS (SELECT b, seq_id, max(a) AS a, least(exp(coalesce(sum(logp - old_logp) FILTER (mask = 1), 0.0) / greatest(count(*) FILTER (mask = 1), 1)), {_CAP}) AS r
  FROM t GROUP BY b, seq_id),
c AS (SELECT b, {_clip_flags(1.01)} FROM s GROUP BY b),
m AS (SELECT b, {_TOKEN_STATS} FROM t WHERE mask = 1 GROUP BY b) {_CLIP_OUT} FROM c JOIN m USING (b)""")
def clip_metrics_sequence(spark, sf):
    t = tokens_unordered(spark, sf).withColumn("b", F.col("seq_id") % 16)
    out = rl.clip_metrics(t, "b", F.col("logp") - F.col("old_logp"), adv(), "ref_logp", "old_logp", eps_low=0.01, eps_high=0.01, delta=_CAP,
                          sequence="seq_id")
    return out.select(*[rnd(F.col(c)).alias(c) for c in out.columns])


@query("high_entropy_mask", TOK + """
SELECT seq_id, pos, mask = 1 AND entropy >= (SELECT quantile_cont(entropy, 0.8) FROM token_logps WHERE mask = 1) AS high FROM token_logps""")
def high_entropy_mask(spark, sf):
    return rl.high_entropy_mask(token_logps(spark, sf), 0.8).select("seq_id", "pos", "high")


PPO_SQL = TOK + f""", g AS (SELECT *, {ADV_SQL} AS score, min(CASE WHEN token_id = 0 THEN pos END) OVER s AS pad, max(pos) OVER s AS fin,
  bool_or(token_id = 7) OVER s AS has_eos FROM token_logps WINDOW s AS (PARTITION BY seq_id)),
l AS (SELECT *, coalesce(pad - 1, fin) AS last FROM g),
f AS (SELECT * REPLACE (CASE WHEN pos > last THEN 1.0 ELSE logp END AS logp, CASE WHEN pos > last THEN 1.0 ELSE ref_logp END AS ref_logp) FROM l),
h AS (SELECT *, logp - ref_logp AS kl FROM f),
r AS (SELECT *, -0.05123456789 * kl + CASE WHEN pos = CASE WHEN last + 1 <= fin THEN last + 1 ELSE last END
  THEN score - CASE WHEN has_eos THEN 0.0 ELSE 1.0 END ELSE 0.0 END AS reward FROM h)
"""


def _ppo(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return rl.ppo_token_rewards(token_logps(spark, sf), "seq_id", adv(), 0, 7, 0.05123456789, missing_eos_penalty=1.0, **kw)


@query("ppo_token_rewards", PPO_SQL + f"SELECT seq_id, pos, last, {sql_rnd('reward', 8)} AS reward FROM r")
def ppo_token_rewards(spark, sf):
    return _ppo(spark, sf).select("seq_id", "pos", "last", rnd(F.col("reward"), 8).alias("reward"))


@query("ppo_token_rewards_whitened", PPO_SQL + f""", k AS (SELECT seq_id, pos, last, -0.05123456789 * (exp(-kl) - 1.0 + kl) + (reward + 0.05123456789 * kl) AS reward FROM r),
s AS (SELECT avg(reward) AS m, var_samp(reward) AS v FROM k WHERE pos <= last + 1)
SELECT seq_id, pos, {sql_rnd('CASE WHEN pos <= last + 1 THEN (reward - m) / sqrt(v + 1e-8) + m ELSE 0.0 END')} AS reward FROM k, s""")
def ppo_token_rewards_whitened(spark, sf):
    return _ppo(spark, sf, estimator="k3", whiten=True).select("seq_id", "pos", rnd(F.col("reward")).alias("reward"))


@query("gae", PPO_SQL + f""", v AS (SELECT *, CASE WHEN pos <= last + 1 THEN value ELSE 0.0 END AS v FROM r),
d AS (SELECT *, reward + coalesce(lead(v) OVER (PARTITION BY seq_id ORDER BY pos), 0.0) - v AS delta FROM v),
a AS (SELECT t.seq_id, t.pos, max(t.last) AS last, max(t.v) AS v, sum(pow(0.93719, k.pos - t.pos) * k.delta) AS adv
  FROM d t JOIN d k ON k.seq_id = t.seq_id AND k.pos >= t.pos GROUP BY t.seq_id, t.pos),
s AS (SELECT avg(adv) AS m, var_samp(adv) AS vv FROM a WHERE pos <= last)
SELECT seq_id, pos, {sql_rnd('adv')} AS advantage, {sql_rnd('adv + v')} AS returns,
  {sql_rnd('CASE WHEN pos <= last THEN (adv - m) / sqrt(vv + 1e-8) ELSE 0.0 END')} AS whitened FROM a, s""")
def gae(spark, sf):
    out = rl.gae(_ppo(spark, sf), "seq_id", 1.0, 0.93719)
    return out.select("seq_id", "pos", *[rnd(F.col(c)).alias(c) for c in ("advantage", "returns", "whitened")])


@query("ppo_losses_and_stats", PPO_SQL + f""", t AS (SELECT * REPLACE (CASE WHEN pos > last THEN 1.0 ELSE old_logp END AS old_logp,
    CASE WHEN pos > last + 1 THEN 0.0 ELSE value END AS value, CAST(pos <= last AS INT) AS mask), pos <= last + 1 AS p1m, {ADV_SQL} AS a,
  CASE WHEN pos > last + 1 THEN 0.0 ELSE value + entropy END AS vp, value * 0.9 AS ret FROM r),
u AS (SELECT *, least(greatest(vp, value - 0.2), value + 0.2) AS vc, exp(logp - old_logp) AS ratio FROM t),
w AS (SELECT *, pow(vp - ret, 2) AS v1, pow(vc - ret, 2) AS v2, -a * ratio AS p1, -a * least(greatest(ratio, 0.95), 1.05) AS p2 FROM u),
x AS (SELECT 0.5 * avg(greatest(v1, v2)) FILTER (p1m) AS vl, avg(CASE WHEN v2 > v1 THEN 1.0 ELSE 0.0 END) FILTER (p1m) AS vcf,
  avg(greatest(p1, p2)) FILTER (mask = 1) AS pl, avg(CASE WHEN p2 > p1 THEN 1.0 ELSE 0.0 END) FILTER (mask = 1) AS pcf,
  0.5 * avg(pow(logp - old_logp, 2)) AS kl, avg(entropy) AS e, avg(ratio) AS r FROM w)
SELECT {sql_rnd('vl')} AS value_loss, {sql_rnd('vcf')} AS value_clipfrac, {sql_rnd('pl')} AS policy_loss, {sql_rnd('pcf')} AS policy_clipfrac,
  {sql_rnd('kl')} AS approx_kl, {sql_rnd('e')} AS entropy, {sql_rnd('r')} AS ratio, {sql_rnd('pl + 0.1 * vl')} AS loss FROM x""")
def ppo_losses_and_stats(spark, sf):
    t = _ppo(spark, sf)
    v = F.col("value")
    out = rl.ppo_losses(t, F.col("pos") <= F.col("last"), F.col("pos") <= F.col("last") + 1, v + F.col("entropy"), v, v * F.lit(0.9), adv(), F.col("logp"), F.col("old_logp"),
                        F.col("entropy"), clip=0.05)
    return out.select(*[rnd(F.col(c)).alias(c) for c in out.columns])


@query("ppo_objective", PPO_SQL + f""", p AS (SELECT seq_id, sum(kl) AS kl, sum(-logp) AS e, max({ADV_SQL}) AS s FROM r GROUP BY seq_id)
SELECT {sql_rnd('avg(kl)')} AS kl, {sql_rnd('avg(e)')} AS entropy, {sql_rnd('avg(-0.05 * kl)')} AS non_score_reward, {sql_rnd('avg(s)')} AS scores,
  {sql_rnd('avg(-0.05 * kl) + avg(s)')} AS rlhf_reward FROM p""")
def ppo_objective(spark, sf):
    out = rl.ppo_objective(_ppo(spark, sf), "seq_id", adv())
    return out.select(*[rnd(F.col(c)).alias(c) for c in out.columns])


@query("ddpo_loss", TOK + f""", t AS (SELECT *, least(greatest({ADV_SQL} * 8.0, -5.0), 5.0) AS a, {_RATIO} AS r FROM token_logps)
SELECT {sql_rnd('avg(greatest(-a * r, -a * least(greatest(r, 0.97), 1.03)))')} AS loss, {sql_rnd('0.5 * avg(pow(logp - old_logp, 2))')} AS approx_kl,
  {sql_rnd('avg(CASE WHEN abs(r - 1.0) > 0.03 THEN 1.0 ELSE 0.0 END)')} AS clipfrac, {sql_rnd('10.0 - avg(value)')} AS alignprop_loss FROM t""")
def ddpo_loss(spark, sf):
    t = tokens_unordered(spark, sf)
    out = rl.ddpo_loss(t, adv() * F.lit(8.0), F.col("logp"), F.col("old_logp"), 5.0, 0.03) \
        .withColumn("alignprop_loss", rl.alignprop_loss(t, F.col("value")).scalar())
    return out.select(*[rnd(F.col(c)).alias(c) for c in out.columns])


@query("metric_rollup", """
WITH e AS (SELECT user_id AS run_id, day(ts) AS step, CASE WHEN event_id % 5 = 0 THEN 'eval' ELSE 'train' END AS mode, event_type, value FROM events)
SELECT run_id, step, """ + ", ".join(
    f"round(avg(value) FILTER (event_type = '{m}' AND mode = '{k}'), 6) AS {p}{m}" for k, p in (("train", ""), ("eval", "eval_"))
    for m in ("view", "click", "purchase", "signup", "error")) + " FROM e GROUP BY run_id, step")
def metric_rollup(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.dayofmonth("ts").cast("long").alias("step"),
        F.when(F.col("event_id") % 5 == 0, "eval").otherwise("train").alias("mode"), "event_type", "value")
    out = rl.metric_rollup(e, ["run_id", "step"], "mode", "event_type", "value", ["view", "click", "purchase", "signup", "error"])
    return out.select("run_id", "step", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("run_id", "step")])


@query("completion_log", REW + f"""
SELECT prompt_id // 8 AS step, 'p' || prompt_id AS prompt, 'g' || gen AS completion, r1, r2,
  {sql_rnd('r1 - avg(r1) OVER (PARTITION BY prompt_id)')} AS advantage FROM rewards""")
def completion_log(spark, sf):
    a = rl.group_advantage(rewards(spark, sf), "prompt_id", "r1", "none")
    out = rl.completion_log(a, F.floor(F.col("prompt_id") / 8), F.concat(F.lit("p"), F.col("prompt_id").cast("string")),
                            F.concat(F.lit("g"), F.col("gen").cast("string")), ["r1", "r2"], "advantage")
    return out.withColumn("advantage", rnd(F.col("advantage")))
