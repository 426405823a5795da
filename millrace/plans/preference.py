"""Preference scoring over the derived log-prob tables (PREF-1..16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd, sql_logsigmoid, sql_rnd, sql_sigmoid, sql_softplus
from ..operators import preference as pref
from ..operators.retrieval import density_ratio_weight
from ..scale import rank_within
from ..tables import LINE_ORDER, binary_logps, ctes, pair_logps, table, token_logps
from .registry import query

PAIRS = ctes("token_logps", "pair_logps")
BINARY = ctes("token_logps", "binary_logps")
BETA = 0.1
LOGITS = "((policy_chosen - policy_rejected) - (ref_chosen - ref_rejected))"
CR, RR = "(0.1 * (policy_chosen - ref_chosen))", "(0.1 * (policy_rejected - ref_rejected))"
SQL_CH, SQL_RJ = "(policy_chosen - ref_chosen)", "(policy_rejected - ref_rejected)"


def _loss_sql(exprs: dict[str, str]) -> str:
    return PAIRS + "SELECT pair_id, pair_no, " + ", ".join(f"{sql_rnd(e)} AS {n}" for n, e in exprs.items()) + " FROM pair_logps"


def _loss_query(spark: SparkSession, sf: str, kinds: dict[str, dict]) -> DataFrame:
    return pair_logps(spark, sf).select("pair_id", "pair_no", *[
        rnd(pref.pair_loss(k.removesuffix("_ls"), pref.Pair(), BETA, **kw)).alias(k) for k, kw in kinds.items()])


@query("pair_logits", _loss_sql({
    "reverse_kl": LOGITS, "reference_free": "(policy_chosen - policy_rejected)",
    "alpha_half": f"CASE WHEN policy_rejected IS NOT NULL THEN (exp(least({SQL_RJ} * -0.5, 709.0)) - exp(least({SQL_CH} * -0.5, 709.0))) / 0.5 END",
    "js": f"{LOGITS} - ({sql_softplus(SQL_CH)} - {sql_softplus(SQL_RJ)})"}))
def pair_logits(spark, sf):
    p = pref.Pair()
    return pair_logps(spark, sf).select(
        "pair_id", "pair_no", rnd(pref.pair_logits(p)).alias("reverse_kl"), rnd(pref.pair_logits(p, reference_free=True)).alias("reference_free"),
        rnd(pref.pair_logits(p, "alpha", 0.5)).alias("alpha_half"), rnd(pref.pair_logits(p, "js")).alias("js"))


_X = f"(0.1 * {LOGITS})"


@query("loss_sigmoid_family", _loss_sql({
    "sigmoid": f"-{sql_logsigmoid(_X)}",
    "sigmoid_ls": f"-{sql_logsigmoid(_X)} * 0.9 - {sql_logsigmoid('-' + _X)} * 0.1",
    "robust": f"(-{sql_logsigmoid(_X)} * 0.9 + {sql_logsigmoid('-' + _X)} * 0.1) / 0.8",
    "exo_pair": f"{sql_sigmoid(_X)} * ({sql_logsigmoid(_X)} - ln(0.999)) + {sql_sigmoid('-' + _X)} * ({sql_logsigmoid('-' + _X)} - ln(0.001))",
    "hinge": f"CASE WHEN {_X} IS NOT NULL THEN greatest(1.0 - {_X}, 0.0) END", "ipo": f"pow({LOGITS} - 5.0, 2)"}))
def loss_sigmoid_family(spark, sf):
    return _loss_query(spark, sf, {"sigmoid": {}, "sigmoid_ls": {"eps": 0.1}, "robust": {"eps": 0.1}, "exo_pair": {}, "hinge": {}, "ipo": {}})


@query("loss_sppo_family", _loss_sql({
    "sppo_hard": f"pow({SQL_CH} - 5.0, 2) + pow({SQL_RJ} + 5.0, 2)",
    "nca_pair": f"-{sql_logsigmoid(CR)} - 0.5 * {sql_logsigmoid('-' + CR)} - 0.5 * {sql_logsigmoid('-' + RR)}",
    "apo_zero": f"1.0 - {sql_sigmoid(CR)} + {sql_sigmoid(RR)}",
    "apo_down": f"{sql_sigmoid(CR)} + 1.0 - {sql_sigmoid(f'0.1 * ({SQL_CH} - {SQL_RJ})')}",
    "discopop": f"-{sql_logsigmoid(_X)} * (1.0 - {sql_sigmoid(_X + ' / 0.05')}) + exp(-{_X}) * {sql_sigmoid(_X + ' / 0.05')}",
    "sft": "-policy_chosen", "chosen_reward": CR, "rejected_reward": RR}))
def loss_sppo_family(spark, sf):
    cr, rr = pref.pair_rewards(pref.Pair(), BETA)
    out = pair_logps(spark, sf)
    kinds = ("sppo_hard", "nca_pair", "apo_zero", "apo_down", "discopop", "sft")
    return out.select("pair_id", "pair_no", *[rnd(pref.pair_loss(k, pref.Pair(), BETA, nll=-F.col("policy_chosen"))).alias(k) for k in kinds],
                      rnd(cr).alias("chosen_reward"), rnd(rr).alias("rejected_reward"))


def _aot_sql(a: str, b: str) -> str:
    x = "(0.1 * (a - b))"
    return PAIRS + f""", w AS (SELECT *, CASE WHEN policy_rejected IS NOT NULL THEN {a} END AS a, {b} AS b FROM pair_logps),
l AS (SELECT batch_id, a, row_number() OVER (PARTITION BY batch_id ORDER BY a NULLS LAST, pair_id, pair_no) AS rank FROM w),
r AS (SELECT batch_id, b, row_number() OVER (PARTITION BY batch_id ORDER BY b NULLS LAST, pair_id, pair_no) AS rank FROM w)
SELECT batch_id, rank, {sql_rnd('a - b')} AS delta, {sql_rnd(f'-{sql_logsigmoid(x)} * 0.95 - {sql_logsigmoid("-" + x)} * 0.05')} AS loss
FROM l JOIN r USING (batch_id, rank)"""


def _aot(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    out = pref.aot_loss(pair_logps(spark, sf), kind, tie=("pair_id", "pair_no"), beta=BETA, eps=0.05)
    return out.select("batch_id", "rank", rnd(F.col("delta")).alias("delta"), rnd(F.col("loss")).alias("loss"))


@query("loss_aot_pair", _aot_sql(SQL_CH, SQL_RJ))
def loss_aot_pair(spark, sf):
    return _aot(spark, sf, "aot_pair")


@query("loss_aot", _aot_sql("(policy_chosen - policy_rejected)", "(ref_chosen - ref_rejected)"))
def loss_aot(spark, sf):
    return _aot(spark, sf, "aot")


@query("loss_bco_pair", PAIRS + f""", b AS (SELECT batch_id, avg(({CR} + {RR}) / 2.0) AS m FROM pair_logps GROUP BY batch_id),
d AS (SELECT batch_id, avg(m) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS delta FROM b)
SELECT pair_id, pair_no, batch_id, {sql_rnd('delta')} AS delta,
  {sql_rnd(f"-{sql_logsigmoid(f'({CR} - delta)')} - {sql_logsigmoid(f'(-({RR} - delta))')}")} AS loss
FROM pair_logps JOIN d USING (batch_id)""")
def loss_bco_pair(spark, sf):
    out = pref.bco_pair_loss(pair_logps(spark, sf), beta=BETA)
    return out.select("pair_id", "pair_no", "batch_id", rnd(F.col("delta")).alias("delta"), rnd(F.col("loss")).alias("loss"))


_R = "(0.1 * (policy_logp - ref_logp))"


@query("loss_bco_unpaired", BINARY + f""", b AS (SELECT batch_id, sum({_R}) AS s, count(*) AS n FROM binary_logps GROUP BY batch_id),
d AS (SELECT batch_id, sum(s) OVER (ORDER BY batch_id) / sum(n) OVER (ORDER BY batch_id) AS delta FROM b),
w AS (SELECT *, exp(policy_logp) AS p FROM binary_logps JOIN d USING (batch_id))
SELECT row_id, batch_id, label, policy_logp, {sql_rnd('delta')} AS delta,
  {sql_rnd(f"CASE WHEN label THEN -{sql_logsigmoid(f'({_R} - delta)')} ELSE -least(greatest(p / (1.0 - p + 1e-8), 0.5), 10.0) * {sql_logsigmoid(f'(-({_R} - delta))')} END")} AS loss
FROM w""")
def loss_bco_unpaired(spark, sf):
    out = pref.bco_loss(binary_logps(spark, sf), beta=BETA, weight=density_ratio_weight(F.exp("policy_logp")))
    return out.select("row_id", "batch_id", "label", "policy_logp", rnd(F.col("delta")).alias("delta"), rnd(F.col("loss")).alias("loss"))


@query("multi_loss_weighting", _loss_sql({
    "loss": f"-{sql_logsigmoid(_X)} * 0.8 + CASE WHEN {_X} IS NOT NULL THEN greatest(1.0 - {_X}, 0.0) END * 0.2 + (1.0 - {sql_sigmoid(CR)} + {sql_sigmoid(RR)})",
    "chosen_reward": f"2.0 * {CR}", "rejected_reward": f"2.0 * {RR}"}))
def multi_loss_weighting(spark, sf):
    out = pref.multi_loss({"sigmoid": 0.8, "hinge": 0.2, "apo_zero": 1.0}, pref.Pair(), BETA)
    return pair_logps(spark, sf).select("pair_id", "pair_no", *[rnd(c).alias(k) for k, c in out.items()])


def two_sided(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences 2p and 2p+1 as the two sides of pair p, as tokens."""
    return token_logps(spark, sf).select(
        F.floor(F.col("seq_id") / 2).alias("pair_id"), (F.col("seq_id") % 2).alias("side"), "pos", "logp", "ref_logp",
        (-F.col("entropy")).alias("log_sum_sq"), "mask", "value", "token_id")


SIDES_SQL = ctes("token_logps") + """, t AS (SELECT seq_id // 2 AS pair_id, seq_id % 2 AS side, pos, logp, ref_logp, -entropy AS lss, mask, value, token_id FROM token_logps),
n AS (SELECT pair_id, count(*) FILTER (mask = 1 AND side = 0) AS len_0, count(*) FILTER (mask = 1 AND side = 1) AS len_1 FROM t GROUP BY pair_id),
j AS (SELECT *, least(len_0, len_1) AS pub FROM t JOIN n USING (pair_id)),
s AS (SELECT pair_id, pair_id % 16 AS batch_id, max(len_0) AS len_0,
  sum(logp) FILTER (side = 0 AND mask = 1) AS logp_0, sum(logp) FILTER (side = 1 AND mask = 1) AS logp_1,
  avg(logp) FILTER (side = 0 AND mask = 1) AS mean_0, avg(logp) FILTER (side = 1 AND mask = 1) AS mean_1,
  sum(ref_logp) FILTER (side = 0 AND mask = 1) AS ref_0, sum(ref_logp) FILTER (side = 1 AND mask = 1) AS ref_1,
  avg(logp - lss) FILTER (side = 0 AND mask = 1) AS adj_0, avg(logp - lss) FILTER (side = 1 AND mask = 1) AS adj_1,
  sum(CASE WHEN pos < len_0 THEN logp * CASE WHEN pos < pub THEN 1.0 ELSE 0.5 END ELSE 0.0 END) FILTER (side = 0 AND mask = 1) AS ld_0,
  sum(CASE WHEN pos < len_1 THEN logp * CASE WHEN pos < pub THEN 1.0 ELSE 0.5 END ELSE 0.0 END) FILTER (side = 1 AND mask = 1) AS ld_1
  FROM j GROUP BY pair_id)
"""
_WPO = "CASE WHEN adj_0 + adj_1 IS NOT NULL THEN least(exp(adj_0 + adj_1), 1.0) END"
_XS, _XL = "(0.1 * ((logp_0 - logp_1) - (ref_0 - ref_1)))", "(0.1 * ((ld_0 - ld_1) - (ref_0 - ref_1)))"


@query("loss_adjustments", SIDES_SQL + f""", b AS (SELECT batch_id, -sum(logp_0) / sum(len_0) AS nll FROM s GROUP BY batch_id)
SELECT pair_id, {sql_rnd('mean_0')} AS mean_chosen, {sql_rnd('mean_1')} AS mean_rejected, {sql_rnd('ld_0')} AS ld_chosen, {sql_rnd('ld_1')} AS ld_rejected,
  {sql_rnd(_WPO)} AS policy_weight, {sql_rnd('nll')} AS nll,
  {sql_rnd(f'(-{sql_logsigmoid(_XS)} + 0.5 * nll) * {_WPO}')} AS loss_rpo_wpo, {sql_rnd(f'-{sql_logsigmoid(_XL)}')} AS loss_ld
FROM s JOIN b USING (batch_id)""")
def loss_adjustments(spark, sf):
    s = pref.side_sums(two_sided(spark, sf), "pair_id", "side", 0.5).withColumn("batch_id", F.col("pair_id") % 16)
    full = pref.adjusted_loss(s, "batch_id", BETA, rpo_alpha=0.5, weighting=True).withColumnRenamed("loss", "loss_rpo_wpo")
    p = pref.Pair(F.col("ld_0"), F.col("ld_1"), F.col("ref_0"), F.col("ref_1"))
    names = {"mean_0": "mean_chosen", "mean_1": "mean_rejected", "ld_0": "ld_chosen", "ld_1": "ld_rejected",
             "policy_weight": "policy_weight", "nll": "nll", "loss_rpo_wpo": "loss_rpo_wpo"}
    return full.select("pair_id", *[rnd(F.col(k)).alias(v) for k, v in names.items()],
                       rnd(pref.pair_loss("sigmoid", p, BETA)).alias("loss_ld"))


@query("preference_metrics", PAIRS + f"""
SELECT batch_id, {sql_rnd(f'avg({CR})', 9)} AS eval_rewards_chosen, {sql_rnd(f'avg({RR})', 9)} AS eval_rewards_rejected,
  {sql_rnd(f'avg(CASE WHEN {CR} > {RR} THEN 1.0 WHEN {CR} <= {RR} THEN 0.0 END)', 9)} AS eval_rewards_accuracy, {sql_rnd(f'avg({CR} - {RR})', 9)} AS eval_rewards_margin,
  {sql_rnd('avg(policy_chosen)', 9)} AS eval_logps_chosen, {sql_rnd('avg(policy_rejected)', 9)} AS eval_logps_rejected,
  {sql_rnd('avg(-policy_chosen)', 9)} AS eval_nll_loss
FROM pair_logps GROUP BY batch_id""")
def preference_metrics(spark, sf):
    cr, rr = pref.pair_rewards(pref.Pair(), BETA)
    m = pref.preference_metrics(pair_logps(spark, sf), ["batch_id"], cr, rr, "eval_", {"nll_loss": F.avg(-F.col("policy_chosen"))})
    return m.select("batch_id", *[rnd(F.col(c), 9).alias(c) for c in m.columns if c != "batch_id"])


KTO_SQL = BINARY + f""", k AS (SELECT batch_id, greatest(avg(policy_kl_logp - ref_kl_logp), 0.0) AS kl FROM binary_logps GROUP BY batch_id),
s AS (SELECT *, {_R} AS reward, CASE WHEN label THEN 1.0 * (1.0 - {sql_sigmoid('0.1 * ((policy_logp - ref_logp) - kl)')})
  ELSE 1.2 * (1.0 - {sql_sigmoid('0.1 * (kl - (policy_logp - ref_logp))')}) END AS loss FROM binary_logps JOIN k USING (batch_id))
"""


@query("kto_loss", KTO_SQL + f"""SELECT row_id, batch_id, label, policy_logp, {sql_rnd('kl')} AS kl, {sql_rnd('reward')} AS reward, {sql_rnd('loss')} AS loss FROM s""")
def kto_loss(spark, sf):
    out = pref.kto_loss(binary_logps(spark, sf), beta=BETA, undesirable_weight=1.2)
    return out.select("row_id", "batch_id", "label", "policy_logp", *[rnd(F.col(c)).alias(c) for c in ("kl", "reward", "loss")])


@query("kto_loss_apo_zero_unpaired", BINARY + f"""
SELECT row_id, label, policy_logp, {sql_rnd(f"CASE WHEN label THEN 1.0 - {sql_sigmoid(_R)} ELSE {sql_sigmoid(_R)} END")} AS loss FROM binary_logps""")
def kto_loss_apo_zero_unpaired(spark, sf):
    out = pref.kto_loss(binary_logps(spark, sf), beta=BETA, kind="apo_zero_unpaired")
    return out.select("row_id", "label", "policy_logp", rnd(F.col("loss")).alias("loss"))


@query("kto_rollup", KTO_SQL + f""", b AS (SELECT batch_id, avg(kl) AS kl, avg(loss) AS loss FROM s GROUP BY batch_id),
t AS (SELECT avg(reward) FILTER (label) AS rc, avg(reward) FILTER (NOT label) AS rr, avg(policy_logp) FILTER (label) AS lc,
  avg(policy_logp) FILTER (NOT label) AS lr FROM s)
SELECT {sql_rnd('rc')} AS eval_rewards_chosen, {sql_rnd('rr')} AS eval_rewards_rejected, {sql_rnd('lc')} AS eval_logps_chosen,
  {sql_rnd('lr')} AS eval_logps_rejected, {sql_rnd('(SELECT avg(kl) FROM b)')} AS eval_kl, {sql_rnd('(SELECT avg(loss) FROM b)')} AS eval_loss,
  {sql_rnd('rc - rr')} AS eval_rewards_margin FROM t""")
def kto_rollup(spark, sf):
    out = pref.kto_rollup(pref.kto_loss(binary_logps(spark, sf), beta=BETA, undesirable_weight=1.2), prefix="eval_")
    return out.select(*[rnd(F.col(c)).alias(c) for c in out.columns])


_Z = "(policy_chosen - policy_rejected)"
_AC, _AR = "((1.0 - exp(policy_chosen * -0.3)) / 0.3)", "((1.0 - exp(policy_rejected * -0.3)) / 0.3)"


@query("cpo_loss", _loss_sql({
    "sigmoid": f"-{sql_logsigmoid(f'(0.1 * {_Z})')}", "hinge": f"CASE WHEN {_Z} IS NOT NULL THEN greatest(1.0 - 0.1 * {_Z}, 0.0) END", "ipo": f"pow({_Z} - 5.0, 2)",
    "simpo": f"-{sql_logsigmoid(f'(0.1 * ({_Z} - 5.0))')}", "alphapo": f"-{sql_logsigmoid(f'(0.1 * ({_AC} - {_AR}))')}",
    "alphapo_chosen_reward": f"0.1 * {_AC}", "total": f"-{sql_logsigmoid(f'(0.1 * {_Z})')} + 0.5 * -policy_chosen"}))
def cpo_loss(spark, sf):
    pc, pr = F.col("policy_chosen"), F.col("policy_rejected")
    a = pref.cpo_loss("sigmoid", pc, pr, BETA, alpha=0.3)
    plain = [rnd(pref.cpo_loss(k, pc, pr, BETA)["loss"]).alias(k) for k in ("sigmoid", "hinge", "ipo", "simpo")]
    return pair_logps(spark, sf).select("pair_id", "pair_no", *plain, rnd(a["loss"]).alias("alphapo"),
                                        rnd(a["chosen_reward"]).alias("alphapo_chosen_reward"),
                                        rnd(pref.cpo_loss("sigmoid", pc, pr, BETA)["loss"] + F.lit(0.5) * -pc).alias("total"))


_ODDS = "((policy_chosen - policy_rejected) - (ln(1.0 - exp(policy_chosen)) - ln(1.0 - exp(policy_rejected))))"


@query("orpo_loss", PAIRS + f"""
SELECT batch_id, {sql_rnd(f'avg(-policy_chosen) - 0.1 * avg({sql_logsigmoid(_ODDS)})')} AS loss, {sql_rnd(f'avg({sql_logsigmoid(_ODDS)})')} AS log_odds_ratio,
  {sql_rnd(f'avg({_ODDS})')} AS log_odds_chosen FROM pair_logps GROUP BY batch_id""")
def orpo_loss(spark, sf):
    out = pref.orpo_loss(pair_logps(spark, sf), ["batch_id"], F.avg(-F.col("policy_chosen")), BETA)
    return out.select("batch_id", *[rnd(F.col(c)).alias(c) for c in ("loss", "log_odds_ratio", "log_odds_chosen")])


@query("orpo_terms", _loss_sql({"log_odds": _ODDS, "ratio": sql_logsigmoid(_ODDS)}))
def orpo_terms(spark, sf):
    t = pref.orpo_terms(F.col("policy_chosen"), F.col("policy_rejected"))
    return pair_logps(spark, sf).select("pair_id", "pair_no", *[rnd(c).alias(k) for k, c in t.items()])


@query("reward_model_loss", PAIRS + f"""
SELECT batch_id, {sql_rnd(f"avg(-{sql_logsigmoid('(policy_chosen - policy_rejected - 0.1)')}) + 0.01 * avg(pow(policy_chosen + policy_rejected, 2))")} AS loss
FROM pair_logps GROUP BY batch_id""")
def reward_model_loss(spark, sf):
    out = pref.reward_model_total(pair_logps(spark, sf), ["batch_id"], F.col("policy_chosen"), F.col("policy_rejected"), F.lit(0.1), 0.01)
    return out.select("batch_id", rnd(F.col("loss")).alias("loss"))


@query("reward_model_preference", _loss_sql({"loss": f"-{sql_logsigmoid(_Z)}", "preference": sql_sigmoid(_Z)}))
def reward_model_preference(spark, sf):
    c, r = F.col("policy_chosen"), F.col("policy_rejected")
    return pair_logps(spark, sf).select("pair_id", "pair_no", rnd(pref.reward_model_loss(c, r)).alias("loss"),
                                        rnd(pref.pair_preference(c, r)).alias("preference"))


def _online(spark: SparkSession, sf: str) -> DataFrame:
    """Completions 0 and 1, 2 and 3, ... of each prompt as the two of a round."""
    two = rank_within(table(spark, sf, "lineitem"), ["l_orderkey"], LINE_ORDER, "rn")
    q = F.col("l_quantity") / F.lit(50.0)
    two = two.select(F.col("l_orderkey").alias("prompt_id"), F.floor((F.col("rn") - 1) / 2).alias("round"), ((F.col("rn") - 1) % 2).alias("gen"), (F.lit(1.0) - q).alias("reward"),
                     (-q).alias("logp"), (-q + (F.col("l_tax") + F.lit(0.0)) - F.lit(0.04)).alias("ref_logp"),
                     (F.col("l_returnflag") != "R").alias("eos"))
    return pref.online_pairs(two, ["prompt_id", "round"], "gen", 0.2)


ONLINE_SQL = ctes("token_logps") + """, p AS (SELECT a.seq_id AS prompt_id, a.pos // 2 AS round,
  1.0 + a.logp - CASE WHEN a.mask = 0 THEN 0.2 ELSE 0.0 END AS r0, 1.0 + b.logp - CASE WHEN b.mask = 0 THEN 0.2 ELSE 0.0 END AS r1,
  a.logp AS l0, b.logp AS l1, a.ref_logp AS f0, b.ref_logp AS f1, a.mask AS e0, b.mask AS e1
  FROM token_logps a LEFT JOIN token_logps b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0),
o AS (SELECT *, r0 >= r1 AS m, CASE WHEN r0 >= r1 THEN l0 WHEN r0 < r1 THEN l1 END AS lc, CASE WHEN r0 >= r1 THEN l1 WHEN r0 < r1 THEN l0 END AS lr,
  CASE WHEN r0 >= r1 THEN f0 WHEN r0 < r1 THEN f1 END AS fc, CASE WHEN r0 >= r1 THEN f1 WHEN r0 < r1 THEN f0 END AS fr FROM p)
"""
_XO = "(0.1 * ((lc - lr) - (fc - fr)))"


@query("online_pair_selection", ONLINE_SQL + f"""
SELECT prompt_id, round, m AS first_chosen, {sql_rnd('abs(r0 - r1)')} AS scores_margin, {sql_rnd(f'-{sql_logsigmoid(_XO)}')} AS loss,
  {sql_rnd('pow((lc - lr) - (fc - fr) - 5.0, 2)')} AS loss_ipo FROM o""")
def online_pair_selection(spark, sf):
    p = pref.Pair()
    return _online(spark, sf).select("prompt_id", "round", "first_chosen", rnd(F.col("scores_margin")).alias("scores_margin"),
                                     rnd(pref.pair_loss("sigmoid", p, BETA)).alias("loss"), rnd(pref.pair_loss("ipo", p, BETA)).alias("loss_ipo"))


@query("online_pair_metrics", ONLINE_SQL + f"""
SELECT {sql_rnd('avg(0.1 * (lc - fc))')} AS rewards_chosen, {sql_rnd('avg(0.1 * (lr - fr))')} AS rewards_rejected,
  {sql_rnd('avg(CASE WHEN 0.1 * (lc - fc) > 0.1 * (lr - fr) THEN 1.0 WHEN lc IS NOT NULL THEN 0.0 END)')} AS rewards_accuracy,
  {sql_rnd('avg(0.1 * (lc - fc) - 0.1 * (lr - fr))')} AS rewards_margin, {sql_rnd('avg(lc)')} AS logps_chosen, {sql_rnd('avg(lr)')} AS logps_rejected,
  {sql_rnd('avg(abs(r0 - r1))')} AS scores_margin, {sql_rnd('avg((r0 + r1) / 2.0)')} AS scores, {sql_rnd('avg((e0 + e1) / 2.0)')} AS contain_eos,
  {sql_rnd('avg((l0 - f0 + l1 - f1) / 2.0)')} AS kl, {sql_rnd('avg(-0.1 * (l0 - f0 + l1 - f1) / 2.0)')} AS non_score_reward,
  {sql_rnd('avg((r0 + r1) / 2.0 - 0.1 * (l0 - f0 + l1 - f1) / 2.0)')} AS rlhf_reward, {sql_rnd('avg(-(l0 + l1) / 2.0)')} AS entropy FROM o""")
def online_pair_metrics(spark, sf):
    m = pref.online_metrics(_online(spark, sf), BETA)
    return m.select(*[rnd(F.col(c)).alias(c) for c in m.columns])


def _sequence_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Pair sums of policy and reference log-probs on model data (side 0) and
    reference data (side 1), null for a side without tokens; no positions needed, so one partial aggregation."""
    from ..tables import tokens_unordered
    t = tokens_unordered(spark, sf).select(
        F.floor(F.col("seq_id") / 2).alias("pair_id"), (F.col("seq_id") % 2).alias("side"), "logp", "ref_logp", "value", "token_id")
    aggs = []
    for s in (0, 1):
        on = F.col("side") == s
        aggs += [F.count_if(on).alias(f"n{s}"), F.sum(F.when(on, F.col("logp"))).alias(f"m{s}"), F.sum(F.when(on, F.col("ref_logp"))).alias(f"r{s}"),
                 F.sum(F.when(on, F.col("value"))).alias(f"score{s}"), F.bool_or(F.when(on, F.col("token_id") == 7)).alias(f"eos{s}"),
                 F.sum(F.when(on, (F.col("logp") - F.col("ref_logp")) * F.col("logp"))).alias(f"q{s}")]
    return t.groupBy("pair_id").agg(*aggs)


SUMS_SQL = ctes("token_logps") + ", g AS (SELECT seq_id // 2 AS pair_id, " + ", ".join(
    f"count(*) FILTER (seq_id % 2 = {s}) AS n{s}, sum(logp) FILTER (seq_id % 2 = {s}) AS m{s}, sum(ref_logp) FILTER (seq_id % 2 = {s}) AS r{s}, "
    f"sum(value) FILTER (seq_id % 2 = {s}) AS score{s}, bool_or(token_id = 7) FILTER (seq_id % 2 = {s}) AS eos{s}, "
    f"sum((logp - ref_logp) * logp) FILTER (seq_id % 2 = {s}) AS q{s}" for s in (0, 1)) + """
FROM token_logps GROUP BY seq_id // 2),
s AS (SELECT *, round(score0, 6) >= round(score1, 6) AS first FROM g)
"""
_PICK = "CASE WHEN first THEN {} WHEN NOT first THEN {} END"
_XX = "(0.1 * CASE WHEN first THEN (m0 - r0) - (m1 - r1) ELSE (m1 - r1) - (m0 - r0) END)"


_LC, _LR = _PICK.format("m0 + r0", "m1 + r1"), _PICK.format("m1 + r1", "m0 + r0")


@query("xpo_loss", SUMS_SQL + f"""
SELECT pair_id, {sql_rnd(f'-{sql_logsigmoid(_XX)}')} AS pair_loss, {sql_rnd('0.01 * m1')} AS xpo_loss, {sql_rnd(f'-{sql_logsigmoid(_XX)} + 0.01 * m1')} AS loss,
  {sql_rnd(f'0.1 * {_PICK.format('m0 - r0', 'm1 - r1')}')} AS chosen_reward, {sql_rnd(f"0.1 * {_PICK.format('m1 - r1', 'm0 - r0')}")} AS rejected_reward,
  {sql_rnd(_XX)} AS margin, {sql_rnd('((m0 - r0) + (m1 - r1)) / 2.0')} AS kl, {sql_rnd('-(m0 + m1) / 2.0')} AS entropy,
  {sql_rnd(_LC)} AS logps_chosen, {sql_rnd(_LR)} AS logps_rejected, eos0 AS model_eos, eos1 AS ref_eos
FROM s""")
def xpo_loss(spark, sf):
    s = _sequence_sums(spark, sf)
    out = pref.xpo_loss(F.col("m0"), F.col("m1"), F.col("r0"), F.col("r1"), F.round("score0", 6) >= F.round("score1", 6), BETA, 0.01)
    return s.select("pair_id", *[rnd(c).alias(k) for k, c in out.items()], F.col("eos0").alias("model_eos"), F.col("eos1").alias("ref_eos"))


_PR = sql_sigmoid("score0 - score1")


@query("nash_md_loss", SUMS_SQL + f"""
SELECT pair_id, {sql_rnd(f'0.1 * q0 - ({_PR} - 0.5) * m0')} AS loss, {sql_rnd(f'({_PR} - 0.5) * m0')} AS score, {sql_rnd('m0 - r0')} AS kl,
  {sql_rnd('-m0')} AS entropy, {sql_rnd('m0 - r0')} AS margin, {sql_rnd(_PR)} AS probability FROM s""")
def nash_md_loss(spark, sf):
    prob = pref.pair_preference(F.col("score0"), F.col("score1"))
    out = pref.nash_md_loss(F.col("m0"), F.col("r0"), F.col("q0"), prob, BETA)
    return _sequence_sums(spark, sf).select("pair_id", *[rnd(c).alias(k) for k, c in out.items()], rnd(prob).alias("probability"))


_XM = {"pair_loss": f"-{sql_logsigmoid(_XX)}", "xpo_loss": "0.01 * m1", "margin": _XX, "kl": "((m0 - r0) + (m1 - r1)) / 2.0",
       "entropy": "-(m0 + m1) / 2.0", "logps_chosen": _LC, "logps_rejected": _LR, "chosen_reward": f"0.1 * {_PICK.format('m0 - r0', 'm1 - r1')}",
       "rejected_reward": f"0.1 * {_PICK.format('m1 - r1', 'm0 - r0')}", "model_scores": "score0", "ref_scores": "score1",
       "scores_margin": "score0 - score1", "model_eos": "CAST(eos0 AS INT)", "ref_eos": "CAST(eos1 AS INT)"}


@query("xpo_metrics", SUMS_SQL + "SELECT " + ", ".join(f"{sql_rnd(f'avg({e})')} AS {n}" for n, e in _XM.items())
       + f", {sql_rnd(f'avg(CASE WHEN {_XX} > 0 THEN 1.0 WHEN {_XX} <= 0 THEN 0.0 END)')} AS accuracy FROM s")
def xpo_metrics(spark, sf):
    out = pref.xpo_loss(F.col("m0"), F.col("m1"), F.col("r0"), F.col("r1"), F.round("score0", 6) >= F.round("score1", 6), BETA, 0.01)
    s = _sequence_sums(spark, sf).select("*", *[c.alias(k) for k, c in out.items()], (F.col("score0") - F.col("score1")).alias("scores_margin"),
                                         F.col("score0").alias("model_scores"), F.col("score1").alias("ref_scores"),
                                         F.col("eos0").alias("model_eos"), F.col("eos1").alias("ref_eos"))
    m = pref.mean_metrics(s, list(_XM), "margin")
    return m.select(*[rnd(F.col(c)).alias(c) for c in m.columns])


_NM = {"loss": f"0.1 * q0 - ({_PR} - 0.5) * m0", "score": f"({_PR} - 0.5) * m0", "kl": "m0 - r0", "entropy": "-m0", "margin": "m0 - r0",
       "probability": _PR, "logps_chosen": "m0", "logps_rejected": "r0", "model_scores": "score0", "mixture_scores": "score1",
       "model_eos": "CAST(eos0 AS INT)", "mixture_eos": "CAST(eos1 AS INT)"}


@query("nash_md_metrics", SUMS_SQL + "SELECT " + ", ".join(f"{sql_rnd(f'avg({e})')} AS {n}" for n, e in _NM.items())
       + f", {sql_rnd('avg(CASE WHEN m0 - r0 > 0 THEN 1.0 WHEN m0 - r0 <= 0 THEN 0.0 END)')} AS accuracy FROM s")
def nash_md_metrics(spark, sf):
    prob = pref.pair_preference(F.col("score0"), F.col("score1"))
    out = pref.nash_md_loss(F.col("m0"), F.col("r0"), F.col("q0"), prob, BETA)
    s = _sequence_sums(spark, sf).select("*", *[c.alias(k) for k, c in out.items()], prob.alias("probability"), F.col("m0").alias("logps_chosen"),
                                         F.col("r0").alias("logps_rejected"), F.col("score0").alias("model_scores"),
                                         F.col("score1").alias("mixture_scores"), F.col("eos0").alias("model_eos"), F.col("eos1").alias("mixture_eos"))
    m = pref.mean_metrics(s, list(_NM), "margin")
    return m.select(*[rnd(F.col(c)).alias(c) for c in m.columns])


JSD_SQL = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 10.0 / 2.0) AS s FROM embeddings),
f AS (SELECT *, list_reverse(s) AS t FROM e),
g AS (SELECT *, ln(list_sum(list_transform(s, lambda v: exp(v)))) AS zs, ln(list_sum(list_transform(t, lambda v: exp(v)))) AS zt FROM f),
h AS (SELECT vec_id, label, unnest(s) - zs AS s, unnest(t) - zt AS t FROM g),
k AS (SELECT *, ln(0.7 * exp(s) + 0.3 * exp(t)) AS m FROM h),
j AS (SELECT vec_id, label, sum(exp(t) * (t - s)) AS b0, sum(exp(s) * (s - t)) AS b1,
  sum(0.3 * exp(t) * (t - m) + 0.7 * exp(s) * (s - m)) AS mix FROM k GROUP BY vec_id, label)
"""


def _jsd(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform(
        F.col("embedding").cast("array<double>"), lambda v: v * F.lit(10.0)).alias("s")).withColumn("t", F.reverse("s"))
    return e.select("vec_id", F.when(F.col("label") == 0, -100).otherwise(F.col("label")).alias("label"), *[
        pref.generalized_jsd(F.col("s"), F.col("t"), b, 2.0).alias(n) for n, b in (("b0", 0.0), ("b1", 1.0), ("mix", 0.3))])


@query("generalized_jsd", JSD_SQL + f"SELECT vec_id, {sql_rnd('b0')} AS b0, {sql_rnd('b1')} AS b1, {sql_rnd('mix')} AS mix FROM j")
def generalized_jsd(spark, sf):
    return _jsd(spark, sf).select("vec_id", *[rnd(F.col(c)).alias(c) for c in ("b0", "b1", "mix")])


@query("generalized_jsd_reduced", JSD_SQL + f"""SELECT {sql_rnd('avg(mix)')} AS batchmean, {sql_rnd('sum(mix)')} AS sum, {sql_rnd('avg(mix) / 64')} AS mean
FROM j WHERE label <> 0""")
def generalized_jsd_reduced(spark, sf):
    out = pref.reduce_jsd(_jsd(spark, sf), "mix", "label", 64)
    return out.select(*[rnd(F.col(c)).alias(c) for c in out.columns])
