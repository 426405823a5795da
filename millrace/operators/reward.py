"""Reward aggregation, advantages and policy-gradient losses over token and completion tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, masked_mean
from ..scale import discounted_suffix, join_on_keys, quantile, rolling, with_group_stats, with_previous
from ..session import materialise


def _null_nan(c: Column) -> Column:
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def reward_matrix(df: DataFrame, funcs: Mapping[str, Column]) -> DataFrame:
    """One column per reward function (null where it does not apply; NaN becomes
    null) and ``all_null`` for rows no function applies to.  A function is any
    column expression, a pandas UDF of the user included."""
    out = df.select("*", *[_null_nan(c).alias(n) for n, c in funcs.items()])
    return out.withColumn("all_null", F.coalesce(*[F.col(n) for n in funcs]).isNull())


def pivot_rewards(long: DataFrame, keys: Sequence[str], func: str, value: str, names: Sequence[str]) -> DataFrame:
    """The same matrix from (keys, function, value) rows."""
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col(func) == n, _null_nan(F.col(value)))).alias(n) for n in names])
    return wide.withColumn("all_null", F.coalesce(*[F.col(n) for n in names]).isNull())


def weighted_reward(weights: Mapping[str, float], clip: tuple[float, float] | None = None, kl: Column | None = None,
                    beta: float = 0.0) -> Column:
    """Weighted sum ignoring nulls, clipped, minus the sequence's KL penalty."""
    total = F.lit(0.0)
    for n, w in weights.items():
        total = total + F.coalesce(F.lit(float(w)) * F.col(n), F.lit(0.0))
    if clip is not None:
        total = clamp(total, *clip)
    return total if kl is None else total - F.lit(beta) * kl


def group_advantage(df: DataFrame, prompt: str, reward: str, scale: str = "group") -> DataFrame:
    """Reward minus the group mean, over the sample std of the group or of the
    whole batch.  A group of one has no std and keeps null."""
    r = F.col(reward)
    g = with_group_stats(df, [prompt], {"_m": F.avg(r), "group_std": F.stddev_samp(r)})
    adv = r - F.col("_m")
    if scale == "group":
        adv = adv / (F.col("group_std") + F.lit(1e-4))
    elif scale == "batch":
        g = g.withColumn("_s", df.agg(F.stddev_samp(r)).scalar())
        adv = adv / (F.col("_s") + F.lit(1e-4))
    elif scale != "none":
        raise ValueError(f"unknown scaling: {scale}")
    return g.withColumn("advantage", adv).drop("_m", "_s")


def leave_one_out_advantage(df: DataFrame, prompt: str, reward: str, normalize: bool = False) -> DataFrame:
    """Reward minus the mean of the other completions of the prompt."""
    r = F.col(reward)
    g = with_group_stats(df, [prompt], {"_s": F.sum(r), "_n": F.count(r)})
    g = g.withColumn("advantage", r - F.try_divide(F.col("_s") - r, (F.col("_n") - 1).cast("double"))).drop("_s", "_n")
    if not normalize:
        return g
    a = F.col("advantage")
    stats = g.agg(F.struct(F.avg(a).alias("m"), F.stddev_samp(a).alias("s"))).scalar()
    return g.withColumn("_z", stats).withColumn(
        "advantage", (a - F.col("_z.m")) / (F.col("_z.s") + F.lit(1e-4))).drop("_z")


def global_advantage(df: DataFrame, reward: str) -> DataFrame:
    """Reward standardised by the batch's mean and population std."""
    r = F.col(reward)
    stats = df.agg(F.struct(F.avg(r).alias("m"), F.stddev_pop(r).alias("s"))).scalar()
    return df.withColumn("_z", stats).withColumn("advantage", (r - F.col("_z.m")) / (F.col("_z.s") + F.lit(1e-8))).drop("_z")


def per_prompt_advantage(df: DataFrame, prompt: str, order: Sequence[str], reward: str, buffer: int = 16,
                         min_count: int = 16) -> DataFrame:
    """Standardised by the prompt's last ``buffer`` rewards; by the whole batch
    while the prompt has fewer than ``min_count``."""
    r = F.col(reward)
    stats = df.agg(F.struct(F.avg(r).alias("m"), F.stddev_pop(r).alias("s"))).scalar()
    w = rolling(df, [prompt], order, buffer, {"_n": F.count(r), "_m": F.avg(r), "_s": F.stddev_pop(r)}).withColumn("_z", stats)
    own = F.col("_n") >= min_count
    mean = F.when(own, F.col("_m")).otherwise(F.col("_z.m"))
    std = F.when(own, F.col("_s")).otherwise(F.col("_z.s"))
    return w.withColumn("advantage", (r - mean) / (std + F.lit(1e-8))).drop("_n", "_m", "_s", "_z")


def reward_metrics(df: DataFrame, prompt: str, reward: str, funcs: Sequence[str], length: str, finished: str) -> DataFrame:
    """Log row of one step over completions.  Group means and stds count once per
    completion, as in the row form; they are folded from the group table."""
    r, n = F.col(reward), F.col("_n")
    fin = F.col(finished)
    per_func = [a for f in funcs for a in (F.avg(f).alias(f"{f}_mean"), F.stddev_samp(f).alias(f"{f}_std"))]
    done = F.when(fin, F.col(length))
    base = df.agg(*per_func, F.avg(length).alias("mean_length"), F.min(length).alias("min_length"),
                  F.max(length).alias("max_length"), F.coalesce(F.avg(done), F.lit(0.0)).alias("mean_terminated_length"),
                  F.coalesce(F.min(done), F.lit(0)).alias("min_terminated_length"),
                  F.coalesce(F.max(done), F.lit(0)).alias("max_terminated_length"),
                  (F.lit(1.0) - F.count_if(fin) / F.count(F.lit(1))).alias("clipped_ratio"))
    g = df.groupBy(prompt).agg(F.count(F.lit(1)).alias("_n"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"))
    groups = g.agg(F.struct(
        (F.sum(n * F.col("_m")) / F.sum(n)).alias("reward"),
        (F.sum(n * F.col("_s")) / F.sum(F.when(F.col("_s").isNotNull(), n))).alias("reward_std"),
        (F.sum(F.when(F.abs("_s") <= 1e-8, n).otherwise(0)) / F.sum(n)).alias("frac_zero_std"))).scalar()
    return base.withColumn("_g", groups).select(*base.columns, "_g.reward", "_g.reward_std", "_g.frac_zero_std")


def k3(logp: Column, ref: Column) -> Column:
    d = ref - logp
    return F.exp(d) - d - F.lit(1.0)


def with_sequence_ratio(df: DataFrame, seq: str, new: str = "logp", old: str = "old_logp", mask: str = "mask") -> DataFrame:
    """``log_ratio``: the masked mean over the sequence of new minus old log-probs."""
    on = F.col(mask) == 1
    g = with_group_stats(df, [seq], {"_sum": F.sum(F.when(on, F.col(new) - F.col(old))), "_on": F.count(F.when(on, 1))})
    mean = F.coalesce(F.col("_sum"), F.lit(0.0)) / F.greatest(F.col("_on"), F.lit(1))
    return g.withColumn("log_ratio", mean).drop("_sum", "_on")


def clipped_policy_loss(log_ratio: Column, advantage: Column, eps_low: float = 0.2, eps_high: float = 0.2,
                        delta: float | None = None, entropy_mask: Column | None = None, is_weight: Column | None = None,
                        kl: Column | None = None, beta: float = 0.0) -> Column:
    """Per-token loss: minus the smaller of the plain and the clipped term."""
    ratio = F.exp(log_ratio)
    clipped = clamp(ratio, 1 - eps_low, 1 + eps_high)
    if delta is not None:
        ratio = clamp(ratio, hi=delta)
    loss = -F.least(ratio * advantage, clipped * advantage)
    if entropy_mask is not None:
        loss = loss * entropy_mask.cast("double")
    if is_weight is not None:
        loss = loss * is_weight
    return loss if kl is None else loss + F.lit(beta) * kl


def reduce_losses(df: DataFrame, seq: str, loss: Column, mask: str, max_length: int) -> DataFrame:
    """All four reductions: mean of sequence means, token mean, per B·max_len, per total tokens."""
    on = F.col(mask) == 1
    per = df.groupBy(seq).agg(F.coalesce(F.sum(F.when(on, loss)), F.lit(0.0)).alias("_sum"), F.count_if(on).alias("_n"))
    n = F.sum("_n")
    return per.agg(F.avg(F.col("_sum") / F.greatest("_n", F.lit(1))).alias("grpo"), (F.sum("_sum") / F.greatest(n, F.lit(1))).alias("bnpo"),
                   (F.sum("_sum") / (F.count(F.lit(1)) * F.lit(max_length))).alias("dr_grpo"),
                   F.try_divide(F.sum("_sum"), n.cast("double")).alias("dapo"))


def clip_metrics(df: DataFrame, batch: str, log_ratio: Column, advantage: Column, sampling: str, old: str, mask: str = "mask",
                 eps_low: float = 0.2, eps_high: float = 0.2, is_cap: float = 2.0, delta: float | None = None,
                 sequence: str | None = None) -> DataFrame:
    """Clip ratios, KL, entropy and importance-sampling statistics: per batch, then across batches.

    Ratios are capped at ``delta`` before they are tested.  With ``sequence`` a sequence has one ratio, of the masked mean of
    ``log_ratio``, and one advantage, and clip ratios are means over sequences; the other figures stay those of the tokens.
    A batch without unmasked tokens has zeros."""
    on = F.col(mask) == 1
    diff = F.abs(F.col(old) - F.col(sampling))
    weight = F.least(F.exp(F.col(old) - F.col(sampling)), F.lit(is_cap))
    n = F.greatest(F.sum("_n"), F.lit(1))

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(F.when(on, x)), F.lit(0.0))

    def clips(log: Column, a: Column) -> dict[str, Column]:
        ratio = F.exp(log) if delta is None else clamp(F.exp(log), hi=delta)
        low, high = (ratio < 1 - eps_low) & (a < 0), (ratio > 1 + eps_high) & (a > 0)
        return {"low": low.cast("double"), "high": high.cast("double"), "region": (low | high).cast("double")}

    sums = {"_kl": total(k3(F.col("logp"), F.col("ref_logp"))), "_entropy": total(F.col("entropy")), "_diff": total(diff), "_is": total(weight),
            "_n": F.count_if(on), "diff_max": F.max(F.when(on, diff)), "is_min": F.min(F.when(on, weight)), "is_max": F.max(F.when(on, weight))}
    if sequence is None:
        sums |= {k: total(x) for k, x in clips(log_ratio, advantage).items()}
        parts = df.groupBy(batch).agg(*[x.alias(k) for k, x in sums.items()])
        clip = {k: F.sum(k) / n for k in ("low", "high", "region")}
    else:
        sums |= {"_log": total(log_ratio), "_a": F.max(advantage)}
        parts = df.groupBy(batch, sequence).agg(*[x.alias(k) for k, x in sums.items()])
        clip = {k: F.avg(x) for k, x in clips(F.col("_log") / F.greatest("_n", F.lit(1)), F.col("_a")).items()}
    zero = F.lit(0.0)
    per = parts.groupBy(batch).agg(
        *[x.alias(k) for k, x in clip.items()], (F.sum("_kl") / n).alias("kl"), (F.sum("_entropy") / n).alias("entropy"),
        (F.sum("_diff") / n).alias("diff_mean"), F.coalesce(F.max("diff_max"), zero).alias("diff_max"),
        F.coalesce(F.min("is_min"), zero).alias("is_min"), (F.sum("_is") / n).alias("is_mean"), F.coalesce(F.max("is_max"), zero).alias("is_max"))
    return per.agg(F.avg("low").alias("low_mean"), F.min("low").alias("low_min"), F.avg("high").alias("high_mean"),
                   F.max("high").alias("high_max"), F.avg("region").alias("region_mean"), F.avg("kl").alias("kl"),
                   F.avg("entropy").alias("entropy"), F.avg("diff_mean").alias("diff_mean"), F.max("diff_max").alias("diff_max"),
                   F.min("is_min").alias("is_min"), F.avg("is_mean").alias("is_mean"), F.max("is_max").alias("is_max"))


def high_entropy_mask(df: DataFrame, threshold: float, entropy: str = "entropy", mask: str = "mask") -> DataFrame:
    """``high``: unmasked tokens at or above the exact quantile of unmasked entropies."""
    cut = quantile(df.filter(F.col(mask) == 1), entropy, threshold)
    if cut is None:
        return df.withColumn("high", F.lit(False))
    return df.withColumn("high", (F.col(mask) == 1) & (F.col(entropy) >= F.lit(cut)))


def _whiten(df: DataFrame, col: str, on: Column, shift_mean: bool) -> DataFrame:
    """Masked standardisation with the batch's sample variance; masked-out rows become 0."""
    x = F.col(col)
    stats = df.agg(F.struct(F.avg(F.when(on, x)).alias("m"), F.var_samp(F.when(on, x)).alias("v"))).scalar()
    z = (x - F.col("_w.m")) / F.sqrt(F.col("_w.v") + F.lit(1e-8))
    if not shift_mean:
        z = z + F.col("_w.m")
    return df.withColumn("_w", stats).withColumn(col, F.when(on, z).otherwise(0.0)).drop("_w")


#: Fixed value: the log-prob of positions past the last token.
PADDING_LOGPROB = 1.0


def ppo_token_rewards(df: DataFrame, seq: str, score: Column, pad: int, eos: int, kl_coef: float = 0.05, estimator: str = "k1",
                      missing_eos_penalty: float | None = None, whiten: bool = False) -> DataFrame:
    """``reward`` per token: minus the KL cost, plus the score at the position
    after the last token (at the last one where there is none).  Adds ``last``."""
    tok, pos = F.col("token_id"), F.col("pos")
    g = with_group_stats(df, [seq], {"_pad": F.min(F.when(tok == pad, pos)), "_end": F.max(pos), "_eos": F.bool_or(tok == eos)})
    last = F.coalesce(F.col("_pad") - 1, F.col("_end"))
    end = F.when(last + 1 <= F.col("_end"), last + 1).otherwise(last)
    if missing_eos_penalty is not None:
        score = score - F.when(F.col("_eos"), 0.0).otherwise(F.lit(missing_eos_penalty))
    logr = F.col("ref_logp") - F.col("logp")
    if estimator == "k1":
        kl = -logr
    elif estimator == "k3":
        kl = F.exp(logr) - F.lit(1.0) - logr
    else:
        raise ValueError(f"unknown estimator: {estimator}")
    kl = F.when(pos <= last, kl).otherwise(0.0)  # both log-probs are one constant past the last token
    out = g.withColumn("last", last).withColumn("kl", kl) \
        .withColumn("reward", F.lit(-kl_coef) * kl + F.when(pos == end, score).otherwise(0.0)).drop("_pad", "_end", "_eos")
    return _whiten(out, "reward", pos <= F.col("last") + 1, shift_mean=False) if whiten else out


def gae(df: DataFrame, seq: str, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """Generalised advantages of (pos, reward, value, last): ``advantage`` (raw),
    ``returns`` and ``whitened`` (masked past the last token)."""
    v = F.when(F.col("pos") <= F.col("last") + 1, F.col("value")).otherwise(0.0)
    d = materialise(df.select(seq, "pos", "last", "reward", v.alias("_v")))
    d = with_previous(d, [seq], [F.col("pos").desc()], "_v", "_next")
    d = d.withColumn("_delta", F.col("reward") + F.lit(gamma) * F.coalesce("_next", F.lit(0.0)) - F.col("_v"))
    d = discounted_suffix(d, [seq], "pos", "_delta", gamma * lam, "advantage")
    d = d.withColumn("returns", F.col("advantage") + F.col("_v")).withColumn("whitened", F.col("advantage")).drop("_next", "_delta", "_v")
    d = materialise(d)  # read twice: for the mean and variance, and for the result
    return _whiten(d, "whitened", F.col("pos") <= F.col("last"), shift_mean=True)


def ppo_losses(df: DataFrame, mask: Column, mask_p1: Column, vpred: Column, value: Column, returns: Column, advantage: Column,
               new: Column, old: Column, entropy: Column, clip: float = 0.2, clip_value: float = 0.2, vf_coef: float = 0.1) -> DataFrame:
    """One row of losses and statistics over all tokens.  ``mask`` holds up to the last token of a sequence, ``mask_p1`` one
    further: beyond, log-probs are equal and values 0.  KL, ratio and entropy are means over all positions."""
    vpred, value = F.when(mask_p1, vpred).otherwise(0.0), F.when(mask_p1, value).otherwise(0.0)
    clipped = F.least(F.greatest(vpred, value - F.lit(clip_value)), value + F.lit(clip_value))
    v1, v2 = F.pow(vpred - returns, F.lit(2.0)), F.pow(clipped - returns, F.lit(2.0))
    d = F.when(mask, new - old).otherwise(0.0)
    ratio = F.exp(d)
    p1, p2 = -advantage * ratio, -advantage * clamp(ratio, 1 - clip, 1 + clip)
    out = df.agg(
        (F.lit(0.5) * masked_mean(F.greatest(v1, v2), mask_p1)).alias("value_loss"),
        masked_mean((v2 > v1).cast("double"), mask_p1).alias("value_clipfrac"),
        masked_mean(F.greatest(p1, p2), mask).alias("policy_loss"), masked_mean((p2 > p1).cast("double"), mask).alias("policy_clipfrac"),
        (F.lit(0.5) * F.avg(d * d)).alias("approx_kl"), F.avg(entropy).alias("entropy"), F.avg(ratio).alias("ratio"))
    return out.withColumn("loss", F.col("policy_loss") + F.lit(vf_coef) * F.col("value_loss"))


def ppo_objective(df: DataFrame, seq: str, score: Column, kl_coef: float = 0.05) -> DataFrame:
    """Means over sequences of KL, entropy, KL cost and the full reward, from the rows of ``ppo_token_rewards``
    (``kl`` is 0 past ``last``; the log-prob there is ``PADDING_LOGPROB``)."""
    logp = F.when(F.col("pos") <= F.col("last"), F.col("logp")).otherwise(PADDING_LOGPROB)
    per = df.groupBy(seq).agg(F.sum("kl").alias("kl"), F.sum(-logp).alias("entropy"), F.max(score).alias("score"))
    out = per.agg(F.avg("kl").alias("kl"), F.avg("entropy").alias("entropy"), F.avg(F.lit(-kl_coef) * F.col("kl")).alias("non_score_reward"),
                  F.avg("score").alias("scores"))
    return out.withColumn("rlhf_reward", F.col("non_score_reward") + F.col("scores"))


def ddpo_loss(df: DataFrame, advantage: Column, new: Column, old: Column, adv_clip: float = 5.0, clip: float = 1e-4) -> DataFrame:
    a = clamp(advantage, -adv_clip, adv_clip)
    ratio = F.exp(new - old)
    worst = F.greatest(-a * ratio, -a * clamp(ratio, 1 - clip, 1 + clip))
    return df.agg(F.avg(worst).alias("loss"), (F.lit(0.5) * F.avg(F.pow(new - old, F.lit(2.0)))).alias("approx_kl"),
                  F.avg((F.abs(ratio - F.lit(1.0)) > clip).cast("double")).alias("clipfrac"))


def alignprop_loss(df: DataFrame, reward: Column) -> DataFrame:
    return df.agg((F.lit(10.0) - F.avg(reward)).alias("loss"))


def metric_rollup(df: DataFrame, keys: Sequence[str], mode: str, metric: str, value: str, names: Sequence[str]) -> DataFrame:
    """Mean of each stored metric per log step, long to wide; evaluation columns
    carry the ``eval_`` prefix."""
    def mean(n: str, m: str) -> Column:
        return F.avg(F.when((F.col(metric) == n) & (F.col(mode) == m), F.col(value)))
    return df.groupBy(*keys).agg(*[mean(n, m).alias(p + n) for m, p in (("train", ""), ("eval", "eval_")) for n in names])


def completion_log(df: DataFrame, step: Column, prompt: Column, completion: Column, rewards: Sequence[str], advantage: str) -> DataFrame:
    return df.select(step.alias("step"), prompt.alias("prompt"), completion.alias("completion"), *rewards, advantage)


def attach_scores(tokens: DataFrame, scores: DataFrame, seq: str) -> DataFrame:
    """Per-sequence scores on every token of the sequence."""
    return join_on_keys(tokens, scores, [seq])
