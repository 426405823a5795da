"""Losses and metrics over tables of chosen and rejected log-probs.

Row-wise losses are column expressions; only what depends on a batch (ranks,
running means, the KL term) needs a shuffle.  A pair without one side (null log-probs) keeps its row; what needs the side is
null, and means leave it out."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import logsigmoid, sigmoid, softplus
from ..functions.tokens import bind, logsumexp
from ..scale import join_on_keys, join_small, rank_within, running_sums
from ..session import materialise

EXP_CAP = 709.0  # largest whole exponent a double holds


@dataclass
class Pair:
    """The four log-prob columns of a pair."""
    pc: Column = field(default_factory=lambda: F.col("policy_chosen"))
    pr: Column = field(default_factory=lambda: F.col("policy_rejected"))
    rc: Column = field(default_factory=lambda: F.col("ref_chosen"))
    rr: Column = field(default_factory=lambda: F.col("ref_rejected"))

    @property
    def chosen(self) -> Column:
        return self.pc - self.rc

    @property
    def rejected(self) -> Column:
        return self.pr - self.rr


def pair_logits(p: Pair, divergence: str = "reverse_kl", alpha: float = 1.0, reference_free: bool = False) -> Column:
    """The preference logit under a divergence; reference-free drops the reference terms."""
    chosen, rejected = (p.pc, p.pr) if reference_free else (p.chosen, p.rejected)
    if divergence == "alpha":
        def power(x: Column) -> Column:
            return F.when(x.isNotNull(), F.exp(F.least(x * F.lit(-alpha), F.lit(EXP_CAP))))
        return (power(rejected) - power(chosen)) / F.lit(alpha)
    plain = (p.pc - p.pr) - (F.lit(0.0) if reference_free else (p.rc - p.rr))
    if divergence == "js":
        return plain - (softplus(chosen) - softplus(rejected))
    if divergence != "reverse_kl":
        raise ValueError(f"unknown divergence: {divergence}")
    return plain


def smoothed(x: Column, eps: float) -> Column:
    """Logistic loss of a logit with label smoothing."""
    return -logsigmoid(x) * F.lit(1 - eps) - logsigmoid(-x) * F.lit(eps)


def pair_loss(kind: str, p: Pair, beta: float = 0.1, eps: float = 0.0, logits: Column | None = None,
              tau: float = 0.05, nll: Column | None = None) -> Column:
    """Row-wise preference loss.  The batch-dependent kinds (``aot``,
    ``aot_pair``, ``bco_pair``) have functions of their own."""
    z = pair_logits(p) if logits is None else logits
    b = F.lit(beta)
    x = b * z
    cr, rr = b * p.chosen, b * p.rejected
    if kind == "sigmoid":
        return smoothed(x, eps)
    if kind == "robust":
        return (-logsigmoid(x) * F.lit(1 - eps) + logsigmoid(-x) * F.lit(eps)) / F.lit(1 - 2 * eps)
    if kind == "exo_pair":
        e = eps or 1e-3
        return sigmoid(x) * (logsigmoid(x) - F.lit(math.log(1 - e))) + sigmoid(-x) * (logsigmoid(-x) - F.lit(math.log(e)))
    if kind == "hinge":
        return F.when(x.isNotNull(), F.greatest(F.lit(1.0) - x, F.lit(0.0)))
    if kind == "ipo":
        return F.pow(z - F.lit(1 / (2 * beta)), F.lit(2.0))
    if kind == "sppo_hard":
        return F.pow(p.chosen - F.lit(0.5 / beta), F.lit(2.0)) + F.pow(p.rejected + F.lit(0.5 / beta), F.lit(2.0))
    if kind == "nca_pair":
        return -logsigmoid(cr) - F.lit(0.5) * logsigmoid(-cr) - F.lit(0.5) * logsigmoid(-rr)
    if kind == "apo_zero":
        return F.lit(1.0) - sigmoid(cr) + sigmoid(rr)
    if kind == "apo_down":
        return sigmoid(cr) + F.lit(1.0) - sigmoid(b * (p.chosen - p.rejected))
    if kind == "discopop":
        y = b * pair_logits(p)
        mod = sigmoid(y / F.lit(tau))
        return -logsigmoid(y) * (F.lit(1.0) - mod) + F.exp(-y) * mod
    if kind == "sft":
        if nll is None:
            raise ValueError("sft needs the chosen answers' NLL")
        return nll
    raise ValueError(f"unknown loss type: {kind}")


def pair_rewards(p: Pair, beta: float = 0.1) -> tuple[Column, Column]:
    return F.lit(beta) * p.chosen, F.lit(beta) * p.rejected


def aot_loss(df: DataFrame, kind: str = "aot_pair", batch: str = "batch_id", tie: Sequence[str] = ("pair_id",), beta: float = 0.1,
             eps: float = 0.0) -> DataFrame:
    """Both columns are sorted on their own within the batch and paired by rank:
    (batch, rank, delta, loss).  Pairs without a side come last, with nulls."""
    p = Pair()
    if kind == "aot_pair":
        a, b = p.chosen, p.rejected
    elif kind == "aot":
        a, b = p.pc - p.pr, p.rc - p.rr
    else:
        raise ValueError(f"unknown loss type: {kind}")
    whole = a.isNotNull() & b.isNotNull()
    both = materialise(df.select(batch, *tie, F.when(whole, a).alias("a"), F.when(whole, b).alias("b")))
    left = rank_within(both.drop("b"), [batch], [F.col("a").asc_nulls_last(), *tie], "rank").select(batch, "rank", "a")
    right = rank_within(both.drop("a"), [batch], [F.col("b").asc_nulls_last(), *tie], "rank").select(batch, "rank", "b")
    delta = F.col("a") - F.col("b")
    # (batch, rank) is unique on both sides, so even one huge batch joins evenly
    return left.join(right, [batch, "rank"]).select(
        batch, "rank", delta.alias("delta"), smoothed(F.lit(beta) * delta, eps).alias("loss"))


def bco_pair_loss(df: DataFrame, batch: str = "batch_id", beta: float = 0.1) -> DataFrame:
    """Adds ``delta`` (mean of the batches' mean rewards up to and with this one)
    and ``loss``."""
    p = Pair()
    cr, rr = pair_rewards(p, beta)
    per = materialise(df.groupBy(batch).agg(F.avg((cr + rr) / F.lit(2.0)).alias("m")).withColumn("one", F.lit(1.0)))
    run = running_sums(per, batch, ["m", "one"]).select(batch, (F.col("cum_m") / F.col("cum_one")).alias("delta"))
    out = join_small(df, run, [batch])
    return out.withColumn("loss", -logsigmoid(cr - F.col("delta")) - logsigmoid(-(rr - F.col("delta"))))


def bco_loss(df: DataFrame, batch: str = "batch_id", beta: float = 0.1, weight: Column | None = None) -> DataFrame:
    """Unpaired form on (policy_logp, ref_logp, label): delta is the running mean
    over all rows so far; rejected rows may carry a density-ratio weight."""
    r = F.lit(beta) * (F.col("policy_logp") - F.col("ref_logp"))
    per = materialise(df.groupBy(batch).agg(F.sum(r).alias("s"), F.count(F.lit(1)).cast("double").alias("n")))
    run = running_sums(per, batch, ["s", "n"]).select(batch, (F.col("cum_s") / F.col("cum_n")).alias("delta"))
    d = F.col("delta")
    w = F.lit(1.0) if weight is None else weight
    return join_small(df, run, [batch]).withColumn(
        "loss", F.when(F.col("label"), -logsigmoid(r - d)).otherwise(-w * logsigmoid(-(r - d))))


def multi_loss(weights: Mapping[str, float], p: Pair, beta: float = 0.1, eps: float = 0.0, **kw) -> dict[str, Column]:
    """Weighted sum of several row-wise losses and of their rewards."""
    if not weights:
        raise ValueError("no loss type given")
    total = F.lit(0.0)
    for kind, w in weights.items():
        total = total + F.lit(float(w)) * pair_loss(kind, p, beta, eps, **kw)
    s = F.lit(float(sum(weights.values())))
    cr, rr = pair_rewards(p, beta)
    return {"loss": total, "chosen_reward": s * cr, "rejected_reward": s * rr}


def side_sums(tokens: DataFrame, pair: str, side: str, ld_alpha: float) -> DataFrame:
    """Token table (pair, side 0/1, pos, logp, ref_logp, log_sum_sq, mask) to one
    row per pair: sums, means and the length-desensitised log-prob of each side.  A side without a token that counts has
    length 0 and nulls."""
    on = F.col("mask") == 1
    lens = tokens.groupBy(pair).agg(*[F.count_if(on & (F.col(side) == s)).alias(f"len_{s}") for s in (0, 1)])
    j = join_on_keys(tokens, lens, [pair], "inner")
    front = F.col("pos") < F.least("len_0", "len_1")
    aggs = []
    for s in (0, 1):
        mine = on & (F.col(side) == s)
        length = F.when(F.lit(s) == 0, F.col("len_0")).otherwise(F.col("len_1"))
        rear = ~front & (F.col("pos") < length)
        ld = F.when(front & (F.col("pos") < length), F.col("logp")).when(rear, F.lit(ld_alpha) * F.col("logp")).otherwise(0.0)
        aggs += [
            F.sum(F.when(mine, F.col("logp"))).alias(f"logp_{s}"), F.avg(F.when(mine, F.col("logp"))).alias(f"mean_{s}"),
            F.sum(F.when(mine, F.col("ref_logp"))).alias(f"ref_{s}"),
            F.avg(F.when(mine, F.col("logp") - F.col("log_sum_sq"))).alias(f"adj_{s}"),
            F.sum(F.when(mine, ld)).alias(f"ld_{s}"), F.max(f"len_{s}").alias(f"len_{s}")]
    return j.groupBy(pair).agg(*aggs)


def adjusted_loss(sums: DataFrame, batch: str, beta: float = 0.1, rpo_alpha: float | None = None,
                  weighting: bool = False, length_desensitised: bool = False) -> DataFrame:
    """Sigmoid pair loss on side sums with the RPO term (NLL of the batch's chosen
    tokens) and the WPO weight."""
    name = "ld" if length_desensitised else "logp"
    p = Pair(F.col(f"{name}_0"), F.col(f"{name}_1"), F.col("ref_0"), F.col("ref_1"))
    loss = pair_loss("sigmoid", p, beta)
    if rpo_alpha is not None:
        nll = sums.groupBy(batch).agg((-F.sum("logp_0") / F.sum("len_0")).alias("nll"))
        sums = join_small(sums, nll, [batch])
        loss = loss + F.lit(rpo_alpha) * F.col("nll")
    both = F.col("adj_0") + F.col("adj_1")
    weight = F.when(both.isNotNull(), F.least(F.exp(both), F.lit(1.0)))
    sums = sums.withColumn("policy_weight", weight)
    return sums.withColumn("loss", loss * F.col("policy_weight") if weighting else loss)


def preference_metrics(df: DataFrame, by: Sequence[str], chosen_reward: Column, rejected_reward: Column,
                       prefix: str = "", extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Mean rewards, accuracy, margin and log-probs per group in one aggregation."""
    aggs = {
        "rewards_chosen": F.avg(chosen_reward), "rewards_rejected": F.avg(rejected_reward),
        "rewards_accuracy": F.avg((chosen_reward > rejected_reward).cast("double")),
        "rewards_margin": F.avg(chosen_reward - rejected_reward),
        "logps_chosen": F.avg("policy_chosen"), "logps_rejected": F.avg("policy_rejected"), **(extra or {})}
    return df.groupBy(*by).agg(*[c.alias(f"{prefix}{k}") for k, c in aggs.items()])


def kto_loss(df: DataFrame, batch: str = "batch_id", beta: float = 0.1, kind: str = "kto", desirable_weight: float = 1.0,
             undesirable_weight: float = 1.0) -> DataFrame:
    """Per row: the batch's ``kl`` (clamped at 0), ``reward`` and weighted ``loss``."""
    ratio = F.col("policy_logp") - F.col("ref_logp")
    b = F.lit(beta)
    if kind == "kto":
        kl = df.groupBy(batch).agg(F.greatest(F.avg(F.col("policy_kl_logp") - F.col("ref_kl_logp")), F.lit(0.0)).alias("kl"))
        df = join_small(df, kl, [batch])
        good, bad = F.lit(1.0) - sigmoid(b * (ratio - F.col("kl"))), F.lit(1.0) - sigmoid(b * (F.col("kl") - ratio))
    elif kind == "apo_zero_unpaired":
        df = df.withColumn("kl", F.lit(0.0))
        good, bad = F.lit(1.0) - sigmoid(b * ratio), sigmoid(b * ratio)
    else:
        raise ValueError(f"unknown loss type: {kind}")
    return df.withColumn("reward", b * ratio).withColumn(
        "loss", F.when(F.col("label"), F.lit(desirable_weight) * good).otherwise(F.lit(undesirable_weight) * bad))


def kto_rollup(scored: DataFrame, batch: str = "batch_id", prefix: str = "") -> DataFrame:
    """Log row: class means are total sum over total count, other metrics are
    means of the batch values."""
    good = F.col("label")
    per = scored.groupBy(batch).agg(
        F.count_if(good).alias("nc"), F.count_if(~good).alias("nr"),
        F.sum(F.when(good, F.col("reward"))).alias("rc"), F.sum(F.when(~good, F.col("reward"))).alias("rr"),
        F.sum(F.when(good, F.col("policy_logp"))).alias("lc"), F.sum(F.when(~good, F.col("policy_logp"))).alias("lr"),
        F.first("kl").alias("kl"), F.avg(F.nanvl(F.col("loss"), F.lit(None).cast("double"))).alias("loss"))
    t = per.agg(
        (F.sum("rc") / F.sum("nc")).alias("rewards_chosen"), (F.sum("rr") / F.sum("nr")).alias("rewards_rejected"),
        (F.sum("lc") / F.sum("nc")).alias("logps_chosen"), (F.sum("lr") / F.sum("nr")).alias("logps_rejected"),
        F.avg("kl").alias("kl"), F.avg("loss").alias("loss"))
    out = t.withColumn("rewards_margin", F.col("rewards_chosen") - F.col("rewards_rejected"))
    return out.select(*[F.col(c).alias(f"{prefix}{c}") for c in out.columns])


def cpo_loss(kind: str, pc: Column, pr: Column, beta: float = 0.1, eps: float = 0.0, gamma: float = 0.5,
             alpha: float = 0.0) -> dict[str, Column]:
    """Reference-free losses; a non-zero alpha transforms the log-probs first."""
    if alpha != 0.0:
        pc, pr = [(F.lit(1.0) - F.exp(x * F.lit(-alpha))) / F.lit(alpha) for x in (pc, pr)]
    z = pc - pr
    if kind == "simpo":
        loss = smoothed(F.lit(beta) * (z - F.lit(gamma / beta)), eps)
    elif kind == "sigmoid":
        loss = smoothed(F.lit(beta) * z, eps)
    elif kind == "hinge":
        loss = F.when(z.isNotNull(), F.greatest(F.lit(1.0) - F.lit(beta) * z, F.lit(0.0)))
    elif kind == "ipo":
        loss = F.pow(z - F.lit(1 / (2 * beta)), F.lit(2.0))
    else:
        raise ValueError(f"unknown loss type: {kind}")
    return {"loss": loss, "chosen_reward": F.lit(beta) * pc, "rejected_reward": F.lit(beta) * pr}


def orpo_terms(pc: Column, pr: Column) -> dict[str, Column]:
    """Log odds ratio and its log-sigmoid; null unless both log-probs are below 0."""
    def log1mexp(x: Column) -> Column:
        return F.log1p(-F.exp(x))
    odds = F.when((pc < 0) & (pr < 0), (pc - pr) - (log1mexp(pc) - log1mexp(pr)))
    return {"log_odds": odds, "ratio": logsigmoid(odds)}


def orpo_loss(df: DataFrame, by: Sequence[str], nll: Column, beta: float = 0.1) -> DataFrame:
    t = orpo_terms(F.col("policy_chosen"), F.col("policy_rejected"))
    return df.groupBy(*by).agg((nll - F.lit(beta) * F.avg(t["ratio"])).alias("loss"),
                               F.avg(t["ratio"]).alias("log_odds_ratio"), F.avg(t["log_odds"]).alias("log_odds_chosen"))


def reward_model_loss(chosen: Column, rejected: Column, margin: Column | None = None) -> Column:
    z = chosen - rejected
    return -logsigmoid(z if margin is None else z - margin)


def reward_model_total(df: DataFrame, by: Sequence[str], chosen: Column, rejected: Column, margin: Column | None = None,
                       center: float | None = None) -> DataFrame:
    loss = F.avg(reward_model_loss(chosen, rejected, margin))
    if center is not None:
        loss = loss + F.lit(center) * F.avg(F.pow(chosen + rejected, F.lit(2.0)))
    return df.groupBy(*by).agg(loss.alias("loss"))


def pair_preference(chosen: Column, rejected: Column) -> Column:
    """Softmax over the two scores: probability of the chosen one."""
    return sigmoid(chosen - rejected)


def online_pairs(two: DataFrame, prompt: Sequence[str], gen: str, missing_eos_penalty: float | None = None,
                 judge_rank: str | None = None) -> DataFrame:
    """One row per prompt (key columns) from its completions 0 and 1 (columns reward, logp,
    ref_logp, eos).  The first is chosen if its penalised reward is not lower, or
    if the judge ranks it 0.  A prompt with one of the two only keeps its row, with null choices."""
    r = F.col("reward")
    if missing_eos_penalty is not None:
        r = F.when(F.col("eos"), r).otherwise(r - F.lit(missing_eos_penalty))
    first, second = F.col(gen) == 0, F.col(gen) == 1
    names = {"reward": r, "logp": F.col("logp"), "ref": F.col("ref_logp"), "eos": F.col("eos").cast("double")}
    aggs = [F.max(F.when(c, v)).alias(f"{n}{i}") for n, v in names.items() for i, c in enumerate((first, second))]
    if judge_rank is not None:
        aggs.append(F.max(F.when(first, F.col(judge_rank))).alias("rank0"))
    wide = two.filter(first | second).groupBy(*prompt).agg((F.bool_or(first) & F.bool_or(second)).alias("_both"), *aggs)
    better = F.col("rank0") == 0 if judge_rank is not None else F.col("reward0") >= F.col("reward1")
    wide = wide.withColumn("first_chosen", F.when(F.col("_both"), better)).drop("_both")
    mask = F.col("first_chosen")

    def pick(n: str, best: bool) -> Column:
        return F.when(mask == best, F.col(f"{n}0")).when(mask != best, F.col(f"{n}1"))

    return wide.select("*", pick("logp", True).alias("policy_chosen"), pick("logp", False).alias("policy_rejected"),
                       pick("ref", True).alias("ref_chosen"), pick("ref", False).alias("ref_rejected"),
                       (pick("reward", True) - pick("reward", False)).alias("scores_margin"))


def online_metrics(pairs: DataFrame, beta: float = 0.1) -> DataFrame:
    """Objective metrics over the pairs of ``online_pairs``."""
    p = Pair()
    cr, rr = pair_rewards(p, beta)
    both = (F.col("logp0") - F.col("ref0") + F.col("logp1") - F.col("ref1")) / F.lit(2.0)
    score = (F.col("reward0") + F.col("reward1")) / F.lit(2.0)
    return preference_metrics(pairs, [], cr, rr, "", {
        "scores_margin": F.avg("scores_margin"), "scores": F.avg(score),
        "contain_eos": F.avg((F.col("eos0") + F.col("eos1")) / F.lit(2.0)), "kl": F.avg(both),
        "non_score_reward": F.avg(F.lit(-beta) * both), "rlhf_reward": F.avg(score - F.lit(beta) * both),
        "entropy": F.avg(-(F.col("logp0") + F.col("logp1")) / F.lit(2.0))})


def xpo_loss(mm: Column, mr: Column, rm: Column, rr: Column, model_chosen: Column, beta: float = 0.1, alpha: float = 1e-5,
             kind: str = "sigmoid") -> dict[str, Column]:
    """Pair loss plus the exploration term on sequence sums; arguments are
    (policy|reference) log-probs of (model|reference) data."""
    def pick(c: Column, a: Column, b: Column) -> Column:
        return F.when(c, a).when(~c, b)
    p = Pair(pick(model_chosen, mm, mr), pick(model_chosen, mr, mm), pick(model_chosen, rm, rr), pick(model_chosen, rr, rm))
    pair = pair_loss(kind, p, beta)
    extra = F.lit(alpha) * mr
    cr, rj = pair_rewards(p, beta)
    return {"pair_loss": pair, "xpo_loss": extra, "loss": pair + extra, "chosen_reward": cr, "rejected_reward": rj,
            "margin": cr - rj, "kl": ((mm - rm) + (mr - rr)) / F.lit(2.0), "entropy": -(mm + mr) / F.lit(2.0),
            "logps_chosen": p.pc + p.rc, "logps_rejected": p.pr + p.rr}


def mean_metrics(df: DataFrame, cols: Sequence[str], positive: str | None = None) -> DataFrame:
    """Log row of the online losses: the mean of each column (booleans as rates),
    with ``accuracy`` as the share of rows where ``positive`` is above 0."""
    aggs = [F.avg(F.col(c).cast("double")).alias(c) for c in cols]
    if positive is not None:
        aggs.append(F.avg((F.col(positive) > 0).cast("double")).alias("accuracy"))
    return df.agg(*aggs)


def nash_md_loss(logp_sum: Column, ref_sum: Column, ratio_logp_sum: Column, probability: Column,
                 beta: float = 0.1) -> dict[str, Column]:
    """``ratio_logp_sum`` is the sum of (logp - ref_logp) * logp over the tokens."""
    score = (probability - F.lit(0.5)) * logp_sum
    return {"loss": F.lit(beta) * ratio_logp_sum - score, "score": score, "kl": logp_sum - ref_sum,
            "entropy": -logp_sum, "margin": logp_sum - ref_sum}


def generalized_jsd(student: Column, teacher: Column, beta: float = 0.5, temperature: float = 1.0) -> Column:
    """Divergence of one position, summed over the vocabulary, from logit arrays."""
    def log_softmax(x: Column) -> Column:
        y = F.transform(x, lambda v: v / F.lit(float(temperature)))
        return bind(logsumexp(y), lambda z: F.transform(y, lambda v: v - z))

    def kl(a: Column, b: Column) -> Column:
        """Terms of KL(b || a) for log-probs a and b."""
        return F.exp(b) * (b - a)

    def term(s: Column, t: Column) -> Column:
        if beta == 0:
            return kl(s, t)
        if beta == 1:
            return kl(t, s)
        x, y = s + F.lit(math.log(1 - beta)), t + F.lit(math.log(beta))
        m = F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))
        return F.lit(beta) * kl(m, t) + F.lit(1 - beta) * kl(m, s)

    return F.aggregate(F.zip_with(log_softmax(student), log_softmax(teacher), term), F.lit(0.0), lambda a, v: a + v)


def reduce_jsd(df: DataFrame, value: str, label: str, vocab: int, ignore: int = -100) -> DataFrame:
    """Batch mean (per unmasked position), sum and mean over all entries."""
    on = F.col(label) != ignore
    return df.agg((F.sum(F.when(on, F.col(value))) / F.count_if(on)).alias("batchmean"),
                  F.sum(F.when(on, F.col(value))).alias("sum"),
                  (F.sum(F.when(on, F.col(value))) / (F.count_if(on) * F.lit(vocab))).alias("mean"))
