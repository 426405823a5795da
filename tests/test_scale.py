"""Hot-key routes against brute force on small frames."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import scale

from .conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key; values repeat."""
    rng = random.Random(3)
    data = [(0 if i % 3 == 0 else rng.randint(1, 40), i, rng.randint(0, 9), rng.random()) for i in range(3000)]
    return spark.createDataFrame(data, "k int, id long, v int, x double").repartition(7).cache()


def test_hot_keys_are_a_table_with_salts_by_size(spark, skewed):
    spark.conf.set(scale.HOT_ROWS_KEY, "300")
    try:
        found = scale.hot_keys(skewed, ["k"])
        assert rows(found) == [(0, 4)]  # 1,000 rows
        side = skewed.groupBy("k").agg(F.max("x").alias("m"))
        joined = scale.join_on_keys(skewed, side, ["k"])
        assert rows(joined, "id", "m") == rows(skewed.join(side, "k", "left"), "id", "m")
    finally:
        spark.conf.unset(scale.HOT_ROWS_KEY)


def test_no_hot_keys_by_default(skewed):
    assert scale.hot_keys(skewed, ["k"]) is None


def test_cold_group_statistics_share_one_exchange(skewed):
    ranked = scale.rank_within(skewed, ["k"], ["id"], "rn")
    plan = scale.with_group_stats(ranked, ["k"], {"n": F.count(F.lit(1)), "m": F.avg("v")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1


def test_null_keys_are_hot_too(spark, hot):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), (1, 3, 1.0), (1, 4, 2.0), (2, 5, 9.0)], "k int, id long, v double")
    got = scale.with_group_stats(df, ["k"], {"m": F.avg("v")})
    assert rows(got, "id", "m") == [(1, 3.0), (2, 3.0), (3, 1.5), (4, 1.5), (5, 9.0)]
    assert rows(scale.with_previous(df, ["k"], ["id"], "v", "p"), "id", "p") == [(1, None), (2, 2.0), (3, None), (4, 1.0), (5, None)]
    side = spark.createDataFrame([(1, "a"), (3, "b")], "k int, s string")
    assert rows(scale.join_on_keys(df, side, ["k"]), "id", "s") == [(1, None), (2, None), (3, "a"), (4, "a"), (5, None)]
    assert rows(scale.join_on_keys(df, side, ["k"], "left_anti"), "id") == [(1,), (2,), (5,)]


@pytest.mark.parametrize("keys", [["k"], ["k", "v"]])
def test_rank_within(skewed, hot, keys):
    got = scale.rank_within(skewed, keys, [F.col("v").desc(), "id"], "rn")
    w = Window.partitionBy(*keys).orderBy(F.col("v").desc(), "id")
    assert got.withColumn("e", F.row_number().over(w)).filter("rn != e").count() == 0
    assert got.count() == skewed.count()


def test_rank_keeps_null_keys(spark, hot):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, id long")
    assert rows(scale.rank_within(df, ["k"], ["id"], "rn"), "id", "rn") == [(1, 1), (2, 2), (3, 1)]


def test_dense_index(skewed):
    got = scale.dense_index(skewed.select("id"), ["id"])
    assert got.filter("idx != id").count() == 0 and got.count() == 3000


def test_with_previous(skewed, hot):
    got = scale.with_previous(skewed, ["k"], ["id"], "v", "p")
    w = Window.partitionBy("k").orderBy("id")
    assert got.withColumn("e", F.lag("v").over(w)).filter("NOT (p <=> e)").count() == 0
    assert got.count() == 3000


def test_group_stats(skewed, hot):
    got = scale.with_group_stats(skewed, ["k"], {"s": F.sum("v")})
    want = skewed.withColumn("s", F.sum("v").over(Window.partitionBy("k")))
    assert rows(got, "id", "s") == rows(want, "id", "s")


@pytest.mark.parametrize("limit", [0, 10**6])
def test_join_small_both_ways(skewed, hot, monkeypatch, limit):
    monkeypatch.setattr(scale, "SMALL_ROWS", limit)
    side = skewed.groupBy("k").agg(F.max("x").alias("m"))
    got = scale.join_small(skewed, side, ["k"])
    assert rows(got, "id", "m") == rows(skewed.join(side, "k"), "id", "m")


@pytest.mark.parametrize("depth", [0, 1, 2, None])
def test_running_sums(spark, depth):
    df = spark.range(700).select(F.col("id").alias("b"), (F.col("id") * 2).alias("v"))
    got = scale.running_sums(df, "b", ["v"], fan=8, depth=depth)
    assert got.filter("cum_v != b * (b + 1)").count() == 0 and got.count() == 700


@pytest.mark.parametrize("g", [0.0, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("block", [3, 1024])
def test_discounted_suffix(spark, g, block):
    rng = random.Random(5)
    data = [(k, p, rng.uniform(-1, 1)) for k, n in ((1, 1), (2, 7), (3, 100)) for p in range(n)]
    df = spark.createDataFrame(data, "k int, pos long, v double")
    got = {(r.k, r.pos): r.a for r in scale.discounted_suffix(df, ["k"], "pos", "v", g, "a", block=block).collect()}
    want, acc = {}, {}
    for k, p, v in sorted(data, reverse=True):
        acc[k] = v + g * acc.get(k, 0.0)
        want[(k, p)] = acc[k]
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_order_statistics(skewed):
    xs = sorted(r.x for r in skewed.select("x").collect())
    ranks = [0, 1, 1499, 2999]
    assert scale.order_statistics(skewed, "x", ranks, bins=16, small=20) == {r: xs[r] for r in ranks}


def test_quantile_with_copies(spark, skewed):
    want = skewed.agg(F.expr("percentile(v, 0.73)")).first()[0]
    assert scale.quantile(skewed, "v", 0.73) == pytest.approx(want)
    assert scale.quantile(skewed.filter("false"), "v", 0.5) is None


def test_rolling_blocks(skewed):
    got = scale.rolling(skewed, ["k"], ["id"], 5, {"m": F.sum("v")}, block=6)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(-4, 0)
    assert rows(got, "id", "m") == rows(skewed.withColumn("m", F.sum("v").over(w)), "id", "m")


def test_first_per_key_cuts_before_the_shuffle(skewed):
    got = scale.first_per_key(skewed, ["k"], ["id"], 2)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert got.groupBy("k").count().filter("count > 2").count() == 0


@pytest.mark.parametrize("is_hot", [False, True])
def test_group_stats_of_a_null_key(spark, is_hot, request):
    if is_hot:
        request.getfixturevalue("hot")
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 1.0), (None, 5.0)], "k int, v double")
    assert rows(scale.with_group_stats(df, ["k"], {"m": F.avg("v")}), "k", "v", "m") == sorted(
        [(1, 2.0, 3.0), (1, 4.0, 3.0), (None, 1.0, 3.0), (None, 5.0, 3.0)], key=repr)


def test_rows_of_a_task_are_bounded(spark, skewed):
    """Ranks, lags and joins deal rows over more partitions than the session sets, so that a task's part stays as it is."""
    spark.conf.set(scale.TASK_ROWS_KEY, "100")
    try:
        ranked = scale.rank_within(skewed, ["id"], ["x"])
        before = scale.with_previous(skewed, ["id"], ["x"], "v", "before")
        joined = scale.join_on_keys(skewed, skewed.join(skewed.select("id"), "id").groupBy("id").agg(F.max("v").alias("m")), ["id"])
        for df in (ranked, before, joined):
            parts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert len(parts) == 30 and max(r["count"] for r in parts) < 200
        by_key = scale.rank_within(skewed, ["k"], ["id"])
        w = Window.partitionBy("k").orderBy("id")
        assert rows(by_key) == rows(skewed.withColumn("rn", F.row_number().over(w).cast("long")))
        assert rows(joined, "id", "m") == rows(skewed, "id", "v")
    finally:
        spark.conf.unset(scale.TASK_ROWS_KEY)
