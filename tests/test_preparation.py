"""Sampling, mixing, tokenizing, packing and pairing."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import scale
from millrace.functions.text import apply_chat_template, chat_turns, fill
from millrace.functions.tokens import hashed_words
from millrace.operators import preparation as prep

from .conftest import rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.range(900).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source")).cache()


def quota(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, k long")


def test_sample_exact_counts(spark, docs):
    q = quota(spark, ("hot", 100), ("s1", 0), ("s2", 10**6), ("s3", 1), ("gone", 5))
    got = {r.source: r["count"] for r in prep.sample_exact(docs, q, "source", ["id"]).groupBy("source").count().collect()}
    assert got == {"hot": 100, "s2": docs.filter("source = 's2'").count(), "s3": 1}


def test_sample_exact_is_repeatable_and_seeded(spark, docs):
    q = quota(spark, ("hot", 50))
    a, b = (rows(prep.sample_exact(docs.repartition(n), q, "source", ["id"], 1), "id") for n in (2, 9))
    assert a == b and len(set(a)) == 50
    assert a != rows(prep.sample_exact(docs, q, "source", ["id"], 2), "id")


def test_sample_exact_is_the_hash_order_prefix(spark, docs):
    q = quota(spark, ("hot", 77))
    want = sorted((r.h, r.id) for r in docs.filter("source = 'hot'").select(prep.seeded_hash(4, F.col("id")).alias("h"), "id").collect())[:77]
    assert rows(prep.sample_exact(docs, q, "source", ["id"], 4), "id") == sorted([(i,) for _, i in want], key=repr)


def test_sample_exact_does_not_shuffle_wide_rows(spark, docs):
    got = prep.sample_exact(docs.withColumn("text", F.lit("x")), quota(spark, ("hot", 5)), "source", ["id"])
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_sample_exact_large_catalog_route(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(scale, "SMALL_ROWS", 0)
    q = quota(spark, ("hot", 100), ("s1", 3))
    assert prep.sample_exact(docs, q, "source", ["id"]).count() == 103


def test_one_dataset_for_two_projects(spark, docs):
    q = spark.createDataFrame([("hot", 1, 10), ("hot", 2, 20)], "source string, project int, k long")
    got = prep.mix_datasets(docs, q, "source", ["id"])
    assert rows(got.groupBy("project").count()) == [(1, 10), (2, 20)]


def test_mix_frames_with_different_columns(spark):
    a, b = spark.range(10), spark.range(5).withColumn("extra", F.lit("x"))
    got = prep.mix_frames([(1, a, 4), (2, b, 9)], ["id"])
    assert rows(got.groupBy("dataset_id").count()) == [(1, 4), (2, 5)] and "extra" in got.columns


def test_sample_with_replacement(spark):
    df = spark.range(20).withColumn("v", F.col("id") * 2)
    got = prep.sample_with_replacement(df, "id", 512)
    assert got.count() == 20 and got.filter("v != id * 2").count() == 0
    assert prep.sample_with_replacement(spark.range(2000), "id", 512).count() == 512


def test_long_conversation_is_one_text(spark):
    t = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(5)] + [(2, 0, "system", "{role}")], "conv_id int, turn int, role string, text string")
    assert rows(apply_chat_template(t, "{role}:{text};")) == [(1, "user:t0;user:t1;user:t2;user:t3;user:t4;", 5), (2, "system:{role};", 1)]
    assert (1, 3, "user:t3;") in rows(chat_turns(t, "{role}:{text};"))
    long = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    assert rows(apply_chat_template(long, "{text},")) == [(1, "".join(f"{i}," for i in range(5000)), 5000)]


def test_fill_does_not_rescan_values(spark):
    assert spark.range(1).select(fill("<{a}|{b}>", {"a": F.lit("{b}"), "b": F.lit("x")})).first()[0] == "<{b}|x>"


def test_extract_prompt(spark):
    df = spark.sql("select array('a','b','c') as c, array('a','b','d') as r, array('a') as s")
    out = prep.extract_prompt_messages(F.col("c"), F.col("r"))
    assert df.select(*[v.alias(k) for k, v in out.items()]).first().asDict() == {"prompt": ["a", "b"], "chosen": ["c"], "rejected": ["d"]}
    out = prep.extract_prompt_messages(F.col("c"), F.col("s"))
    assert df.select(*[v.alias(k) for k, v in out.items()]).first().asDict() == {"prompt": ["a"], "chosen": ["b", "c"], "rejected": []}
    t = prep.extract_prompt_text(F.lit("Hello one"), F.lit("Hello two!"))
    assert df.select(*[v.alias(k) for k, v in t.items()]).first().asDict() == {"prompt": "Hello ", "chosen": "one", "rejected": "two!"}


def test_unpair(spark):
    df = spark.sql("select 'p' as prompt, 'c' as chosen, 'r' as rejected")
    assert rows(prep.unpair_preferences(df, ["prompt"])) == [("p", "c", True), ("p", "r", False)]


def test_tokenize_rules(spark):
    df = spark.createDataFrame([("<s>a b",), ("a b c",)], "text string")
    tok = lambda t: F.transform(F.split(t, " "), lambda w: F.length(w).cast("long"))
    got = prep.tokenize(df, "text", tok, max_length=3, bos=1, bos_text="<s>")
    assert rows(got, "input_ids") == [([1, 1, 1],), ([4, 1],)]
    done = df.withColumn("labels", F.lit(1))
    assert prep.tokenize(done, "text", tok) is done


def test_tokenize_with_user_tokenizer(spark):
    tok = prep.batched_udf(lambda texts: [[ord(c) for c in t] for t in texts], "array<long>", batch=2)
    df = spark.createDataFrame([("ab",), ("c",), ("",)], "text string")
    assert rows(prep.tokenize(df, "text", tok), "text", "input_ids") == [("", []), ("ab", [97, 98]), ("c", [99])]


def test_detokenize_round_trip(spark):
    df = spark.createDataFrame([(1, "the cat sat"), (2, "the dog")], "id int, text string")
    words = df.select(F.explode(F.split("text", " ")).alias("w"))
    from millrace.functions.tokens import word_id
    vocab = prep.vocabulary(words, "w", lambda w: word_id(w, 100_003), 100_003)
    got = prep.detokenize(df.select("id", hashed_words(F.col("text"), 100_003).alias("ids")), "ids", vocab)
    assert rows(got, "id", "text") == [(1, "the cat sat"), (2, "the dog")]


@pytest.mark.parametrize("strategy", ["bfd", "wrapped"])
def test_packing_invariants(spark, strategy):
    rng = random.Random(1)
    lens = [(i, rng.choice([0, 1, 5, 16, 17, 40, 333])) for i in range(60)]
    df = spark.createDataFrame(lens, "id long, n int")
    p = prep.pack_sequences(df, "id", "n", 16, strategy).collect()
    assert sum(r.len for r in p) == sum(n for _, n in lens)
    for i, n in lens:  # each token of each sequence is placed once
        spots = sorted((r.start, r.len) for r in p if r.id == i)
        assert sum(x for _, x in spots) == n and all(a + x == b for (a, x), (b, _) in zip(spots, spots[1:]))
    bins = {}
    for r in p:
        bins.setdefault(r.bin, []).append((r.offset, r.len))
    for spots in bins.values():
        spots.sort()
        assert spots[0][0] == 0 and all(a + x == b for (a, x), (b, _) in zip(spots, spots[1:]))
        assert sum(x for _, x in spots) <= 16


def _plain_best_fit(lengths, cap):
    """Bin of each length, item by item."""
    free, placed = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(f, b) for b, f in enumerate(free) if f >= lengths[i]]
        b = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(cap)
        placed[i] = (b, cap - free[b])
        free[b] -= lengths[i]
    return [placed[i] for i in range(len(lengths))]


def test_best_fit_on_a_histogram_equals_item_by_item(spark):
    assert [b for b, _ in _plain_best_fit([4, 8, 1, 2, 6], 10)] == [1, 0, 2, 0, 1]
    for seed in range(40):
        rng = random.Random(seed)
        cap = rng.choice([10, 16, 100])
        lens = [rng.randint(1, rng.choice([3, cap])) for _ in range(rng.choice([1, 9, 200]))]
        want = _plain_best_fit(lens, cap)
        got, rank = {}, {}
        slots = prep.best_fit_slots({n: lens.count(n) for n in set(lens)}, cap)
        for i, n in enumerate(lens):
            r = rank[n] = rank.get(n, -1) + 1
            _, first, each, b, offset = max(x for x in slots if x[0] == n and x[1] <= r)
            got[i] = (b + (r - first) // each, offset + (r - first) % each * n)
        assert [got[i] for i in range(len(lens))] == want
    df = spark.createDataFrame(list(enumerate(lens)), "id long, n int")
    assert rows(prep.pack_sequences(df, "id", "n", cap), "id", "bin", "offset") == sorted(((i, *p) for i, p in enumerate(want)), key=repr)


def test_packed_tokens(spark):
    seqs = spark.createDataFrame([(1, [1, 2, 3]), (2, [4]), (3, [5, 6])], "id long, ids array<int>")
    placed = prep.pack_sequences(seqs.select("id", F.size("ids").alias("n")), "id", "n", 4)
    got = sorted(tuple(r.input_ids) for r in prep.packed_tokens(seqs, placed, "id", "ids").collect())
    assert sorted(t for b in got for t in b) == [1, 2, 3, 4, 5, 6] and len(got) == 2


def test_filters_and_labels(spark):
    df = spark.sql("select * from values (1, array(1,2), array(1), true), (2, array(1), array(1,2,3), false) as t(id, a, b, label)")
    assert rows(prep.filter_by_length(df, 2, "a", "b"), "id") == [(1,)]
    good, bad = prep.split_by_label(df)
    assert rows(good, "id") == [(1,)] and rows(bad, "id") == [(2,)]


def test_mismatch_pairs_rotation(spark):
    df = spark.createDataFrame([(i, f"x{i}", f"y{i}") for i in range(5)], "id int, prompt string, completion string")
    got = prep.mismatch_pairs(df, ["id"], "prompt", "completion", 3)
    assert rows(got, "id", "KL_completion") == [(0, "y2"), (1, "y0"), (2, "y1"), (3, "y4"), (4, "y3")]


def test_class_balance(spark):
    df = spark.createDataFrame([(True,)] * 8 + [(False,)] * 1, "label boolean")
    r = prep.class_balance_bounds(df, "label").first()
    assert (r.num_desirable, r.num_undesirable, r.des_lower, r.des_upper, r.und_lower, r.und_upper, r.warn) == (8, 1, 0.12, 0.17, 6.02, 8.0, True)
    even = prep.class_balance_bounds(spark.createDataFrame([(True,), (False,)], "label boolean"), "label").first()
    assert even.des_lower is None and even.warn is False


def test_repeat_prompts(spark):
    got = prep.repeat_prompts(spark.range(3), "id", 2, 2, 2, seed=None)
    assert [(r.step, r.pos, r.id) for r in got.orderBy("step", "pos").collect()] == [
        (0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 1), (1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 0, 2), (2, 1, 2), (3, 0, 2), (3, 1, 2)]


def test_shuffle_and_slice(spark):
    got = prep.shuffle_and_slice_buffer(spark.range(8), "id", 4, 2, 2, seed=3)
    assert rows(got.groupBy("step").count()) == [(i, 2) for i in range(8)]
    per = {}
    for r in got.collect():
        per.setdefault(r.step, set()).add(r.id)
    assert per[0] == per[2] and per[0] | per[1] == {0, 1, 2, 3}


def test_reference_scores(spark):
    df = spark.createDataFrame([(1, -1.0), (2, -2.0)], "id int, ref double")
    s = spark.createDataFrame([(2, -9.0)], "id int, ref double")
    assert rows(prep.attach_reference_scores(df, s, ["id"], ["ref"])) == [(1, -1.0), (2, -9.0)]


def test_drop_duplicate_prompts(spark):
    df = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("q", 3, "c")], "prompt string, step int, c string")
    assert rows(prep.drop_duplicate_prompts(df, "prompt", ["step"])) == [("p", 1, "a"), ("q", 3, "c")]


def test_review_rows(spark):
    df = spark.createDataFrame([(i, "ab", f"ab{i}", [0.123456]) for i in range(9)], "id int, prompt string, text string, s array<double>")
    got = prep.sample_review_rows(df, "id", 4, "prompt", ["text"], ["s"]).collect()
    assert len(got) == 4 and all(r.text == str(r.id) and r.s == [0.1235] for r in got)


@pytest.mark.parametrize("last_only", [False, True])
def test_step_examples(spark, last_only):
    rng = random.Random(3)
    turns = [(c, t, None if rng.random() < 0.1 else [rng.randrange(2, 99) for _ in range(rng.choice([0, 1, 3, 30]))], rng.choice([True, False, None]))
             for c, n in [("a", 1), ("b", 2), ("c", 5), (None, 3), ("d", 40)] for t in range(n)]
    df = spark.createDataFrame(turns, "conv string, turn int, ids array<bigint>, ok boolean").repartition(3)
    got = {r["conv"]: (r["input_ids"], r["labels"]) for r in prep.step_examples(df, "conv", ["turn"], "ids", "ok", 0, 12, 4, 14, 1, last_only).collect()}
    want = {}
    for c in {t[0] for t in turns}:
        prompt, *steps = [t for t in turns if t[0] == c]
        p = [1, *(prompt[2] or [])][-4:]
        ids = [x for s in steps for x in [*(s[2] or []), 0]][:12]
        labels = [x for k, s in enumerate(steps) for x in
                  [*[-100] * len(s[2] or []), -100 if last_only and k < len(steps) - 1 else int(bool(s[3]))]][:12]
        want[c] = ((p + ids)[:14], ([-100] * len(p) + labels)[:14])
    assert got == want
    assert prep.step_examples(df.limit(0), "conv", ["turn"], "ids", "ok", 0, 12).count() == 0
