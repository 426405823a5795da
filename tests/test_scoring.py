"""Preference and reward formulas against plain Python."""

import math
import random
import statistics as stats
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.operators import preference as pref
from millrace.operators import reward as rl

from .conftest import rows


def sig(x):
    return 1 / (1 + math.exp(-x))


def ls(x):
    return math.log(sig(x))


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(-1.0, -2.0, -1.5, -1.8)], "policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")


Z, CH, RJ, B = 0.7, 0.5, -0.2, 0.1


@pytest.mark.parametrize("kind,kw,want", [
    ("sigmoid", {}, -ls(B * Z)), ("sigmoid", {"eps": 0.1}, -ls(B * Z) * 0.9 - ls(-B * Z) * 0.1),
    ("robust", {"eps": 0.1}, (-ls(B * Z) * 0.9 + ls(-B * Z) * 0.1) / 0.8), ("hinge", {}, 1 - B * Z), ("ipo", {}, (Z - 5) ** 2),
    ("exo_pair", {}, sig(B * Z) * (ls(B * Z) - math.log(0.999)) + sig(-B * Z) * (ls(-B * Z) - math.log(0.001))),
    ("sppo_hard", {}, (CH - 5) ** 2 + (RJ + 5) ** 2), ("nca_pair", {}, -ls(B * CH) - 0.5 * ls(-B * CH) - 0.5 * ls(-B * RJ)),
    ("apo_zero", {}, 1 - sig(B * CH) + sig(B * RJ)), ("apo_down", {}, sig(B * CH) + 1 - sig(B * (CH - RJ))),
    ("discopop", {}, -ls(B * Z) * (1 - sig(B * Z / 0.05)) + math.exp(-B * Z) * sig(B * Z / 0.05))])
def test_pair_losses(pair, kind, kw, want):
    assert pair.select(pref.pair_loss(kind, pref.Pair(), B, **kw)).first()[0] == pytest.approx(want)


def test_unknown_kinds_fail(pair):
    for call in (lambda: pref.pair_loss("nope", pref.Pair()), lambda: pref.pair_loss("sft", pref.Pair()), lambda: pref.pair_logits(pref.Pair(), "nope"),
                 lambda: pref.cpo_loss("nope", F.lit(0), F.lit(0)), lambda: pref.multi_loss({}, pref.Pair()), lambda: pref.aot_loss(pair, "nope")):
        with pytest.raises(ValueError):
            call()


def test_divergences(pair):
    got = pair.select(pref.pair_logits(pref.Pair(), "js"), pref.pair_logits(pref.Pair(), "alpha", 0.5), pref.pair_logits(pref.Pair(), reference_free=True)).first()
    assert got[0] == pytest.approx(Z - (math.log1p(math.exp(CH)) - math.log1p(math.exp(RJ))))
    assert got[1] == pytest.approx((math.exp(-0.5 * RJ) - math.exp(-0.5 * CH)) / 0.5) and got[2] == pytest.approx(1.0)


def test_alpha_divergence_is_capped(spark):
    df = spark.createDataFrame([(-5000.0, 0.0, 0.0, 0.0)], "policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    assert math.isfinite(df.select(pref.pair_logits(pref.Pair(), "alpha")).first()[0])


def pairs(spark, n=30):
    data = [(i, i % 3, -0.1 - (i * 7 % 11) / 5, -0.2 - (i * 5 % 13) / 6, -0.3 - (i % 4) / 4, -0.4 - (i % 6) / 6) for i in range(n)]
    return data, spark.createDataFrame(data, "pair_id long, batch_id long, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")


@pytest.mark.parametrize("kind", ["aot", "aot_pair"])
def test_aot_with_hot_batches(spark, hot, kind):
    data, df = pairs(spark)
    got = {(r.batch_id, r.rank): r.delta for r in pref.aot_loss(df, kind).collect()}
    for b in range(3):
        mine = [d for d in data if d[1] == b]
        x = sorted(d[2] - d[4] if kind == "aot_pair" else d[2] - d[3] for d in mine)
        y = sorted(d[3] - d[5] if kind == "aot_pair" else d[4] - d[5] for d in mine)
        assert [got[(b, i + 1)] for i in range(len(mine))] == pytest.approx([p - q for p, q in zip(x, y)])


def test_bco_running_mean(spark):
    data, df = pairs(spark)
    got = {r.pair_id: r.delta for r in pref.bco_pair_loss(df).collect()}
    means = [stats.mean(0.1 * ((d[2] - d[4]) + (d[3] - d[5])) / 2 for d in data if d[1] == b) for b in range(3)]
    for d in data:
        assert got[d[0]] == pytest.approx(stats.mean(means[:d[1] + 1]))


def test_kto(spark):
    df = spark.createDataFrame([(0, True, -1.0, -1.2, -0.5, -0.7), (0, False, -2.0, -1.5, -0.4, -0.3), (1, True, -1.0, -1.0, -3.0, -1.0)],
                               "batch_id long, label boolean, policy_logp double, ref_logp double, policy_kl_logp double, ref_kl_logp double")
    out = pref.kto_loss(df, undesirable_weight=2.0)
    got = {(r.batch_id, r.label): r for r in out.collect()}
    assert got[(0, True)].kl == pytest.approx(0.05) and got[(1, True)].kl == 0.0
    assert got[(0, True)].loss == pytest.approx(1 - sig(0.1 * 0.15)) and got[(0, False)].loss == pytest.approx(2 * (1 - sig(0.1 * 0.55)))
    r = pref.kto_rollup(out).first()
    assert r.rewards_chosen == pytest.approx(0.01) and r.rewards_margin == pytest.approx(0.01 + 0.05) and r.kl == pytest.approx(0.025)


def test_orpo_needs_negative_logps(spark):
    t = pref.orpo_terms(F.col("a"), F.col("b"))
    df = spark.createDataFrame([(-1.0, -2.0), (0.0, -1.0)], "a double, b double").select(t["log_odds"].alias("o")).collect()
    want = 1.0 - (math.log(1 - math.exp(-1)) - math.log(1 - math.exp(-2)))
    assert df[0].o == pytest.approx(want) and df[1].o is None


def test_online_pairs(spark):
    df = spark.createDataFrame([(1, 0, 0.5, -1.0, -1.1, False, 1), (1, 1, 0.4, -2.0, -1.9, True, 0), (2, 0, 0.3, -1.0, -1.0, True, 0), (2, 1, 0.3, -1.5, -1.0, True, 1),
                                (3, 0, 0.9, -1.0, -1.0, True, 0)], "p int, g int, reward double, logp double, ref_logp double, eos boolean, rank int")
    got = {r.p: r for r in pref.online_pairs(df, ["p"], "g", 0.2).collect()}
    assert set(got) == {1, 2, 3} and not got[1].first_chosen and got[2].first_chosen  # a tie keeps the first
    assert got[3].first_chosen is None  # one completion only
    assert got[1].policy_chosen == -2.0 and got[1].scores_margin == pytest.approx(0.1)
    judged = {r.p: r.first_chosen for r in pref.online_pairs(df, ["p"], "g", judge_rank="rank").collect()}
    assert judged == {1: False, 2: True, 3: None}


@pytest.mark.parametrize("beta", [0.0, 0.3, 1.0])
def test_jsd(spark, beta):
    s, t = [0.1, 1.0, -2.0], [0.3, 0.2, 0.9]

    def soft(x):
        z = sum(math.exp(v / 2) for v in x)
        return [math.exp(v / 2) / z for v in x]
    p, q = soft(s), soft(t)
    kl = lambda a, b: sum(x * math.log(x / y) for x, y in zip(a, b))
    m = [(1 - beta) * x + beta * y for x, y in zip(p, q)]
    want = kl(q, p) if beta == 0 else kl(p, q) if beta == 1 else beta * kl(q, m) + (1 - beta) * kl(p, m)
    df = spark.createDataFrame([(s, t)], "s array<double>, t array<double>")
    assert df.select(pref.generalized_jsd(F.col("s"), F.col("t"), beta, 2.0)).first()[0] == pytest.approx(want)


REW = [(1, 0, 1.0), (1, 1, 3.0), (1, 2, 2.0), (2, 0, 5.0), (3, 0, 4.0), (3, 1, 4.0)]


@pytest.fixture(scope="module")
def rewards(spark):
    return spark.createDataFrame(REW, "p int, g int, r double").cache()


def test_group_advantage(rewards):
    got = {(r.p, r.g): r.advantage for r in rl.group_advantage(rewards, "p", "r").collect()}
    assert got[(1, 1)] == pytest.approx(1 / (1 + 1e-4)) and got[(2, 0)] is None and got[(3, 0)] == 0.0
    batch = {(r.p, r.g): r.advantage for r in rl.group_advantage(rewards, "p", "r", "batch").collect()}
    assert batch[(1, 1)] == pytest.approx(1 / (stats.stdev(x for _, _, x in REW) + 1e-4)) and batch[(2, 0)] == 0.0
    with pytest.raises(ValueError):
        rl.group_advantage(rewards, "p", "r", "nope")


def test_group_advantage_hot(rewards, hot):
    got = {(r.p, r.g): r.advantage for r in rl.group_advantage(rewards, "p", "r").collect()}
    assert len(got) == 6 and got[(1, 1)] == pytest.approx(1 / (1 + 1e-4))


def test_leave_one_out(rewards):
    got = {(r.p, r.g): r.advantage for r in rl.leave_one_out_advantage(rewards, "p", "r").collect()}
    assert got[(1, 1)] == 1.5 and got[(2, 0)] is None and got[(3, 1)] == 0.0


def test_reward_matrix_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 1.0, None)], "id int, a double, b double")
    got = rl.reward_matrix(df, {"fa": F.col("a"), "fb": F.col("b")})
    assert rows(got, "id", "fa", "all_null") == [(1, None, True), (2, 1.0, False)]
    assert rows(got.select("id", rl.weighted_reward({"fa": 2.0, "fb": 1.0}).alias("w"))) == [(1, 0.0), (2, 2.0)]


def test_per_prompt_buffer(spark, hot):
    data = [("a", i, float(i % 5)) for i in range(20)] + [("b", 0, 9.0)]
    df = spark.createDataFrame(data, "p string, i int, r double")
    got = {(r.p, r.i): r.advantage for r in rl.per_prompt_advantage(df, "p", ["i"], "r", 4, 4).collect()}
    every = [r for _, _, r in data]
    last = [float(i % 5) for i in range(16, 20)]
    assert got[("a", 19)] == pytest.approx((4 - stats.mean(last)) / (stats.pstdev(last) + 1e-8))
    assert got[("b", 0)] == pytest.approx((9 - stats.mean(every)) / (stats.pstdev(every) + 1e-8))


def test_clipped_loss(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, -2.0), (0.0, 1.0)], "lr double, a double")
    got = [r[0] for r in df.select(rl.clipped_policy_loss(F.col("lr"), F.col("a"), 0.2, 0.2)).collect()]
    assert got == pytest.approx([-2.4, 1.6, -1.0])
    capped = df.select(rl.clipped_policy_loss(F.col("lr"), F.lit(-1.0), delta=1.5)).first()[0]
    assert capped == pytest.approx(1.5)


def test_loss_reductions(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 3.0, 1), (2, 5.0, 1), (2, 9.0, 0), (3, 7.0, 0)], "s int, l double, mask int")
    r = rl.reduce_losses(df, "s", F.col("l"), "mask", 10).first()
    assert (r.grpo, r.bnpo, r.dr_grpo, r.dapo) == pytest.approx(((2 + 5 + 0) / 3, 3.0, 9 / 30, 3.0))


def test_high_entropy_mask(spark):
    df = spark.createDataFrame([(i, float(i), 1) for i in range(10)] + [(99, 50.0, 0)], "i int, entropy double, mask int")
    assert rows(rl.high_entropy_mask(df, 0.8).filter("high"), "i") == [(8,), (9,)]
    assert rl.high_entropy_mask(df.filter("mask = 0"), 0.8).filter("high").count() == 0


@pytest.mark.parametrize("is_hot", [False, True])
def test_gae_matches_the_recursion(spark, is_hot, request):
    if is_hot:
        request.getfixturevalue("hot")
    data = [(s, p, 0 if (s == 2 and p >= 3) else 5 if p < n - 1 else 7, -0.5 - p / 10, -0.4 - p / 20, 0.1 * p) for s, n in ((1, 4), (2, 6), (3, 1)) for p in range(n)]
    df = spark.createDataFrame(data, "seq int, pos long, token_id int, logp double, ref_logp double, value double")
    t = rl.ppo_token_rewards(df, "seq", F.lit(1.0), 0, 7, 0.1)
    tok = {(r.seq, r.pos): r for r in t.collect()}
    assert tok[(1, 3)].last == 3 and tok[(1, 3)].reward == pytest.approx(0.1 * (tok[(1, 3)].ref_logp - tok[(1, 3)].logp) + 1.0)
    assert tok[(2, 3)].last == 2 and tok[(2, 3)].reward == 1.0  # no KL past the last token
    got = {(r.seq, r.pos): r for r in rl.gae(t, "seq", 0.9, 0.8).collect()}
    adv = {}
    for (s, p), r in sorted(tok.items(), reverse=True):
        v = lambda q: tok[(s, q)].value if (s, q) in tok and q <= tok[(s, q)].last + 1 else 0.0
        adv[(s, p)] = r.reward + 0.9 * v(p + 1) - v(p) + 0.72 * adv.get((s, p + 1), 0.0)
        assert got[(s, p)].advantage == pytest.approx(adv[(s, p)]) and got[(s, p)].returns == pytest.approx(adv[(s, p)] + v(p))
    on = [a for (s, p), a in adv.items() if p <= tok[(s, p)].last]
    assert got[(1, 0)].whitened == pytest.approx((adv[(1, 0)] - stats.mean(on)) / math.sqrt(stats.variance(on) + 1e-8))
    assert got[(2, 5)].whitened == 0.0


def test_metric_rollup(spark):
    df = spark.createDataFrame([(1, "train", "loss", 1.0), (1, "train", "loss", 3.0), (1, "eval", "loss", 5.0), (2, "train", "kl", 7.0)],
                               "step int, mode string, m string, v double")
    assert rows(rl.metric_rollup(df, ["step"], "mode", "m", "v", ["loss", "kl"])) == [(1, 2.0, None, 5.0, None), (2, None, 7.0, None, None)]


def test_incomplete_pairs_keep_their_rows(spark):
    df = spark.createDataFrame([(0, 0, -1.0, -2.0, -1.5, -1.5), (0, 1, -1.0, None, -1.5, None), (0, 2, -3.0, -1.0, -1.0, -2.0)],
                               "batch_id int, pair_id int, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    p = pref.Pair()
    kinds = ["sigmoid", "robust", "exo_pair", "hinge", "ipo", "sppo_hard", "nca_pair", "apo_zero", "apo_down", "discopop"]
    got = df.select("pair_id", *[pref.pair_loss(k, p, 0.1).alias(k) for k in kinds], pref.pair_logits(p, "alpha", 0.5).alias("alpha"),
                    *[pref.cpo_loss(k, p.pc, p.pr)["loss"].alias(f"cpo_{k}") for k in ("simpo", "sigmoid", "hinge", "ipo")]).orderBy("pair_id").collect()
    assert [[v is None for v in r[1:]] for r in got] == [[False] * 15, [True] * 15, [False] * 15]
    for kind in ("aot", "aot_pair"):
        ranked = {r["rank"]: r["loss"] for r in pref.aot_loss(df, kind).collect()}
        whole = {r["rank"]: r["loss"] for r in pref.aot_loss(df.filter("policy_rejected is not null"), kind).collect()}
        assert ranked == {**whole, 3: None}
    m = pref.preference_metrics(df, [], *pref.pair_rewards(p)).first()
    assert m["rewards_accuracy"] == 0.5


def test_empty_sides_and_single_completions_give_nulls(spark):
    t = spark.createDataFrame([(1, 0, 0, -1.0, -1.5, 0.1, 1), (1, 1, 0, -2.0, -1.0, 0.1, 0), (2, 0, 0, -1.0, -1.0, 0.2, 1), (2, 1, 0, -0.5, -1.0, 0.2, 1),
                               (3, 1, 0, -0.5, -1.0, 0.2, 1)], "pair int, side int, pos int, logp double, ref_logp double, log_sum_sq double, mask int")
    sums = pref.side_sums(t, "pair", "side", 0.5).withColumn("b", F.lit(0))
    out = {r.pair: r for r in pref.adjusted_loss(sums, "b", rpo_alpha=0.5, weighting=True).collect()}
    assert sorted(out) == [1, 2, 3] and out[1]["len_1"] == 0 and out[3]["logp_0"] is None
    assert out[2]["loss"] is not None and out[1]["loss"] is None and out[3]["policy_weight"] is None
    two = spark.createDataFrame([(1, 0, 1.0, -1.0, -1.0, True, 0), (1, 1, 2.0, -1.0, -1.0, True, 1), (2, 0, 1.0, -1.0, -1.0, False, 0), (3, 1, 1.0, -1.0, -1.0, False, 0)],
                                "p int, g int, reward double, logp double, ref_logp double, eos boolean, rank int")
    for judge in (None, "rank"):
        got = {r.p: r for r in pref.online_pairs(two, ["p"], "g", judge_rank=judge).collect()}
        assert got[1].first_chosen is (judge is not None)
        assert all(got[k].first_chosen is None and got[k].policy_chosen is None and got[k].policy_rejected is None for k in (2, 3))


def test_odd_completions_are_paired_in_their_batch(spark, tmp_path):
    from millrace.tables import pair_logps
    # sequences 64 to 64 * 5 share batch 0; their numbers of completions: 1, 2, 3, 1, 1
    rows_ = [(64 * (i + 1), n, n, 1, float(n), 10.0, 0.0, 0.0, "N", date(2024, 1, 1))
             for i, size in enumerate((1, 2, 3, 1, 1)) for n in range(size)]
    spark.createDataFrame(rows_, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_tax double, l_returnflag string, l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted((r.pair_id, r.pair_no, r.policy_rejected is None) for r in pair_logps(spark, str(tmp_path)).collect())
    # 64 with the last of 192, 256 with 320
    assert got == [(64, 0, False), (128, 0, False), (192, 0, False), (256, 0, False)]


@pytest.mark.parametrize("sequence", [None, "seq"])
def test_clip_metrics_after_the_cap(spark, sequence):
    rng = random.Random(4)
    data = [(b, s, rng.gauss(0, 0.5), 0.0, 0.0, 0.0, rng.random(), 0 if b == 2 else rng.choice([0, 1, 1]), (-1.0) ** s)
            for b in range(3) for s in range(b * 4, b * 4 + 4) for _ in range(5)]
    df = spark.createDataFrame(data, "b int, seq int, logp double, ref_logp double, old_logp double, s double, entropy double, mask int, a double").repartition(3)
    for delta in (None, 1.1):
        got = rl.clip_metrics(df, "b", F.col("logp") - F.col("old_logp"), F.col("a"), "s", "old_logp", eps_low=0.1, eps_high=0.2, delta=delta,
                              sequence=sequence).first()
        low, high = [], []
        for b in range(3):
            on = [r for r in data if r[0] == b and r[7]]
            pairs = [(r[2], r[8]) for r in on]
            if sequence:
                pairs = []
                for s in range(b * 4, b * 4 + 4):
                    own = [r[2] for r in on if r[1] == s]
                    pairs.append((sum(own) / max(len(own), 1), (-1.0) ** s))
            ratios = [(min(math.exp(x), delta or 1e9), a) for x, a in pairs]
            low.append(sum(r < 0.9 and a < 0 for r, a in ratios) / max(len(ratios), 1))
            high.append(sum(r > 1.2 and a > 0 for r, a in ratios) / max(len(ratios), 1))
        assert (got["low_mean"], got["low_min"]) == pytest.approx((sum(low) / 3, min(low)))
        assert (got["high_mean"], got["high_max"]) == pytest.approx((sum(high) / 3, max(high)))
        assert delta is None or got["high_max"] == 0
