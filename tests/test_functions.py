"""Scalar functions on hand-written edge values."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import names, numeric, text, tokens
from millrace.plans import all_queries


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (str, int, float)) else F.lit(v))
    return df.select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [
    ("..a:b/c*?. ", "a_b_c_"), ("___", "_"), ("", "unnamed"), (". .", "unnamed"), ("a<>b", "a_b"), ("ok", "ok")])
def test_sanitize_name(spark, raw, want):
    assert one(spark, names.sanitize_name(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw,want", [("My  Set..", "my-set"), ("", "project"), ("A/B", "a_b")])
def test_sanitize_project_name(spark, raw, want):
    assert one(spark, names.sanitize_project_name(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw,want", [
    ("hf_org_name_train.json", ("org", "name")), ("hf_org_a_b_val_7.json", ("org", "a_b")), ("hf_train_x.json", ("train", "x")),
    ("hf_train_x_train.json", ("train", "x_train")), ("hf_org_train.json", ("org", "")), ("hf_one.json", ("user", "hf_one")),
    ("0123456789abcdef0123456789ABCDEF.csv", ("user", "unknown")), ("plain.set.json", ("user", "plain.set"))])
def test_parse_dataset_filename(spark, raw, want):
    assert tuple(one(spark, names.parse_dataset_filename(F.col("x")), x=raw)) == want


def test_split_repo_id(spark):
    assert tuple(one(spark, names.split_repo_id(F.col("x")), x="a/b/c")) == ("a", "b/c")
    assert tuple(one(spark, names.split_repo_id(F.col("x"), "", F.lit("cfg")), x="b")) == ("", "b_cfg")
    assert one(spark, names.display_name(F.lit("n"), F.lit("train"), F.lit(None).cast("string"))) == "n (train)"


def test_map_alias(spark):
    assert one(spark, names.map_alias(F.col("x")), x="gemma:7b") == "google/gemma-7b-it"
    assert one(spark, names.map_alias(F.col("x")), x="other") == "other"
    assert one(spark, names.map_alias(F.col("x"), fallback=names.MODEL_ALIAS_DEFAULT), x="other") == names.MODEL_ALIAS_DEFAULT
    assert len(names.MODEL_ALIASES) == 9


@pytest.mark.parametrize("s,want", [(0, "0s"), (59, "59s"), (60, "1m 0s"), (3599, "59m 59s"), (3661, "1h 1m")])
def test_format_duration(spark, s, want):
    assert one(spark, names.format_duration(F.col("x")), x=s) == want


@pytest.mark.parametrize("n,want", [(0, "0 Bytes"), (512, "512 Bytes"), (1024, "1 KB"), (1572864, "1.5 MB"), (1100, "1.07 KB")])
def test_format_bytes(spark, n, want):
    assert one(spark, names.format_bytes(F.col("x")), x=n) == want


@pytest.mark.parametrize("raw,want", [
    ('{"text": null}', None), ('{"input": "a"}', "a"), ('{"instruction": "i"}', "### Instruction:\ni\n\n### Response:\n"),
    ('{"instruction": "i", "response": "r"}', "### Instruction:\ni\n\n### Response:\nr"), ('{"z": 1, "y": null}', "1 None"),
    ('{"text": "t", "instruction": "i"}', "t"), ("a bare string", "a bare string"), ('{"input": "a", "output": null}', "a\nNone")])
def test_render_map_text(spark, raw, want):
    assert one(spark, text.render_map_text(text.json_map(F.col("x")), F.col("x")), x=raw) == want


def test_render_uniform(spark):
    def r(sql):
        df = spark.sql(sql)
        return df.select(text.render_training_text(df)).first()[0]
    assert r("select 'a' as input, 'b' as output") == "a\nb"
    assert r("select 'i' as instruction, 'r' as response") == "### Instruction:\ni\n\n### Response:\nr"
    assert r("select cast(null as string) as text, 1 as input") is None
    assert r("select 1 as a, cast(null as int) as b") == "1 None"


def test_extract_document_text(spark):
    def r(raw):
        return one(spark, text.extract_document_text(text.json_map(F.col("x")), F.col("x")), x=raw)
    assert r('{"text": null, "content": "c"}') is None
    assert r('{"content": "c"}') == "c" and r('{"a": 1}') == '{"a": 1}'


def test_nested_names(spark):
    assert one(spark, text.nested_names(F.col("x")), x='[{"config_name":"a","name":"b"},{"name":"c"},{},"s"]') == ["a", "c", ""]
    assert one(spark, text.nested_names(F.lit(None).cast("string"))) == []


def ids(*v):
    return F.array(*[F.lit(x).cast("long") for x in v]) if v else F.array().cast("array<long>")


def test_truncations(spark):
    assert one(spark, tokens.truncate_prompt(ids(1, 2, 3), 2)) == [2, 3]
    assert one(spark, tokens.truncate_prompt(ids(5), 4, bos=1, eos=2)) == [1, 5, 2]
    assert one(spark, tokens.truncate_completion(ids(1, 2, 3), 3, 9)) == [1, 2, 3]
    assert one(spark, tokens.truncate_completion(ids(1), 3, 9)) == [1, 9]
    assert one(spark, tokens.truncate_left_combined(ids(1, 2, 3), ids(4, 5), 4)) == [2, 3]
    assert one(spark, tokens.truncate_left_combined(ids(1), ids(4, 5, 6, 7), 2)) == []


def test_budget_pair(spark):
    out = tokens.budget_pair(ids(1, 2, 3), ids(1, 2, 3), ids(7, 8, 9), ids(7), 5, 2, "keep_start")
    assert one(spark, out["chosen_ids"]) == [1, 2, 7, 8, 9] and one(spark, out["chosen_labels"]) == [-100, -100, 7, 8, 9]
    out = tokens.budget_pair(ids(1, 2, 3), ids(1, 2, 3), ids(7, 8, 9, 10), ids(7), 5, 2)
    assert one(spark, out["chosen_ids"]) == [2, 3, 7, 8, 9] and one(spark, out["rejected_ids"]) == [2, 3, 7]
    assert one(spark, tokens.prompts_agree(ids(1, 2), ids(1, 3, 4)))
    assert not one(spark, tokens.prompts_agree(ids(1, 2), ids(3, 4)))


def test_step_labels(spark):
    steps, labels = F.array(ids(5, 6), ids(7)), F.array(F.lit(True), F.lit(False))
    assert one(spark, tokens.step_ids(steps, 0)) == [5, 6, 0, 7, 0]
    assert one(spark, tokens.step_labels(steps, labels)) == [-100, -100, 1, -100, 0]
    assert one(spark, tokens.step_labels(steps, labels, last_only=True)) == [-100, -100, -100, -100, 0]


def test_mask_ops(spark):
    assert one(spark, tokens.left_pack(ids(0, 3, 0, 4), 0)) == [3, 4, 0, 0]
    assert one(spark, tokens.pad_count(ids(0, 0, 5, 0), 3, 0)) == 2
    assert one(spark, tokens.completion_mask(ids(0, 5, 6, 0), F.lit(1), F.lit(2), 0)) == [0, 1, 1, 0]
    lp, m = F.array(F.lit(-1.0), F.lit(-2.0), F.lit(-3.0)), F.array(F.lit(0), F.lit(1), F.lit(1))
    assert one(spark, tokens.align_logprobs(lp, m)) == [0.0, -1.0, -2.0]


def test_eos_mask(spark):
    def r(a):
        return {k: one(spark, c) for k, c in tokens.eos_mask(a, 9).items()}
    assert r(ids(1, 9, 2)) == {"mask": [1, 1, 0], "length": 2, "terminated": True}
    assert r(ids(9, 1)) == {"mask": [1, 0], "length": 1, "terminated": True}
    assert r(ids(1, 2)) == {"mask": [1, 1], "length": 2, "terminated": False}
    assert r(ids()) == {"mask": [], "length": 0, "terminated": False}
    assert one(spark, tokens.eos_mask(ids(1, 2), 9, True)["mask"]) == [0, 0]
    cut = tokens.cut_after_stop(ids(4, 9, 5, 6), 9, 0)
    assert one(spark, cut["ids"]) == [4, 9, 0, 0] and one(spark, cut["length"]) == 1


def test_logprob_and_entropy(spark):
    x = F.array(F.lit(1000.0), F.lit(1000.0))  # no overflow
    assert one(spark, tokens.token_logprob(x, F.lit(0))) == pytest.approx(-math.log(2))
    assert one(spark, tokens.entropy(x)) == pytest.approx(math.log(2))


@pytest.mark.parametrize("x", [-800.0, -1.0, 0.0, 2.5, 800.0])
def test_stable_logistic(spark, x):
    sp = max(x, 0) + math.log1p(math.exp(-abs(x)))
    assert one(spark, numeric.softplus(F.col("x")), x=x) == pytest.approx(sp)
    assert one(spark, numeric.logsigmoid(F.col("x")), x=x) == pytest.approx(x - sp if x < 700 else 0.0, abs=1e-12)
    assert 0 <= one(spark, numeric.sigmoid(F.col("x")), x=x) <= 1


def test_step_arithmetic(spark):
    assert one(spark, numeric.total_steps(F.lit(10), 4, 3)) == 6
    assert one(spark, numeric.batch_count(F.lit(10), 4)) == 3
    assert one(spark, numeric.progress_percent(F.lit(6), F.lit(6))) == 99.0


def test_budget_pair_with_specials(spark):
    out = tokens.budget_pair(ids(1, 5), ids(5), ids(7, 2), ids(8), 99, 9, bos=1, eos=2, prompt=ids(5, 6))
    assert {k: one(spark, v) for k, v in out.items()} == {
        "prompt_ids": [1, 5], "chosen_ids": [1, 5, 7, 2], "chosen_labels": [-100, -100, 7, 2], "rejected_ids": [1, 5, 8, 2],
        "rejected_labels": [-100, -100, 8, 2]}
    # the specials count: six tokens are over five, so prompts and then answers are cut
    out = tokens.budget_pair(ids(4, 5), ids(4, 5), ids(7, 8), ids(9), 5, 2, bos=1, eos=2)
    assert one(spark, out["chosen_ids"]) == [4, 5, 7, 8, 2] and one(spark, out["rejected_ids"]) == [4, 5, 9, 2]
    assert one(spark, tokens.budget_pair(ids(), ids(), ids(), ids(), 5, 2, bos=1, eos=2)["chosen_ids"]) == [1, 2]


def test_answer_parts(spark):
    for prompt, whole, want in (([1, 2], [1, 2, 3], ([1, 2], [3])), ([1, 2], [1, 9, 3], ([1], [9, 3])), ([], [4], ([], [4])), ([1], [1], ([1], [])),
                                ([7], [8], ([], [8]))):
        p, a = tokens.answer_parts(ids(*prompt), ids(*whole))
        assert (one(spark, p), one(spark, a)) == want


def test_step_example(spark):
    steps, labels = F.array(ids(5, 6), ids(7)), F.array(F.lit(True), F.lit(False))

    def both(**kw):
        out = tokens.step_example(ids(3, 4), steps, labels, 0, **kw)
        return one(spark, out["input_ids"]), one(spark, out["labels"])
    i = -100
    assert both(bos=1) == ([1, 3, 4, 5, 6, 0, 7, 0], [i, i, i, i, i, 1, i, 0])
    assert both(bos=1, max_prompt=2, max_completion=3) == ([3, 4, 5, 6, 0], [i, i, i, i, 1])
    assert both(bos=1, max_len=4, last_only=True) == ([1, 3, 4, 5], [i] * 4)
    assert both(last_only=True) == ([3, 4, 5, 6, 0, 7, 0], [i] * 6 + [0])


def test_a_document_on_two_sides_is_hashed_once(spark, tmp_path):
    texts = ["a b  c", "", None, "c\nd " * 400, "e"]
    spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    got = all_queries()["truncate_tokens"](spark, str(tmp_path))
    assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()  # the ids are written before the pairs

    def ids(t):
        return None if t is None else [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 1000 for w in t.split()]

    after = {0: 2, 2: 4, 4: 0, 1: 3, 3: 1}
    for r in got.collect():
        p, c = ids(texts[r.pair_id]), ids(texts[after[r.pair_id]])
        assert r.prompt_ids == (None if p is None else p[-512:])
        assert r.completion_ids == (None if c is None else [*c, 2][:256])
        if p is not None and c is not None:
            assert r.combined_ids == p[max(len(p) + len(c) - 600, 0):]
    assert got.count() == 5
