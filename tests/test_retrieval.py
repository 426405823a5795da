import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval as vec
from millrace.operators.preparation import batched_udf

from .conftest import rows


@pytest.fixture(scope="module")
def docs(spark):
    import random
    rng = random.Random(2)
    data = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)] + [(300, [0.0] * 4)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5).cache()


def brute(docs, queries, k):
    out = []
    for q, v in queries:
        scored = []
        for r in docs.collect():
            n = sum(x * x for x in r.embedding) ** 0.5
            scored.append((-sum(a * b for a, b in zip(v, r.embedding)) / n if n else 0.0, r.vec_id))
        out += [(q, i, rank + 1) for rank, (_, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1024, 3])
def test_topk_is_exact(spark, docs, monkeypatch, block):
    monkeypatch.setattr(vec, "QUERY_BLOCK", block)
    qs = [(i, [float(i % 3) - 1, 0.5, -0.2 * i, 1.0]) for i in range(8)]
    got = vec.exact_topk(docs, spark.createDataFrame(qs, "query_id long, embedding array<double>"), 5)
    assert rows(got, "query_id", "vec_id", "rank") == brute(docs, qs, 5)


def test_topk_ties_take_the_lower_id(spark):
    d = spark.createDataFrame([(i, [1.0, 0.0]) for i in (7, 3, 5)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, embedding array<double>")
    assert rows(vec.exact_topk(d, q, 2), "vec_id", "score", "rank") == [(3, 2.0, 1), (5, 2.0, 2)]


def test_no_queries(spark, docs):
    assert vec.exact_topk(docs, spark.createDataFrame([], "query_id long, embedding array<double>")).count() == 0


def test_normalize_zero_vector(spark):
    got = spark.range(1).select(vec.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))), vec.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert got[0] == [0.6, 0.8] and got[1] == [0.0, 0.0]


def test_embedders(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "")], "id int, text string")
    e = {r.id: r.embedding for r in vec.embed_documents(df, "text", 16).collect()}
    assert sum(x * x for x in e[1]) == pytest.approx(1.0) and e[2] == [0.0] * 16
    own = vec.embed_documents(df, "text", encoder=batched_udf(lambda ts: [[float(len(t))] for t in ts], "array<float>"))
    assert rows(own, "id", "embedding") == [(1, [5.0]), (2, [0.0])]


def test_index_round_trip(spark, tmp_path, docs):
    texts = docs.select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("text"))
    vectors = docs.select(F.col("vec_id").alias("id"), "embedding")
    vec.build_index_table(texts, vectors, str(tmp_path / "i"), "m", "now")
    d, v, c, m = vec.open_index(spark, str(tmp_path / "i"))
    assert c.first()["num_documents"] == 301 and vec.index_integrity(d, v, c, m).first()["valid"]
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in v.filter("id < 300").collect())
    broken = vec.index_integrity(d, v.filter("id > 0"), c, m).first()
    assert not broken["valid"] and broken["without_vector"] == 1 and broken["bad_blocks"] == 1
    # two vectors that changed places have the counts and the values of a whole index
    swapped = v.withColumn("id", F.when(F.col("id") == 7, 8).when(F.col("id") == 8, 7).otherwise(F.col("id")))
    found = vec.index_integrity(d, swapped, c, m).first()
    assert not found["valid"] and found["vectors"] == 301 and found["without_vector"] == 0 and found["bad_blocks"] in (1, 2)
    twice = vec.index_integrity(d, v.union(v.filter("id = 9")), c, m).first()
    assert not twice["valid"] and twice["bad_blocks"] == 1


def test_empty_index(spark, tmp_path):
    texts = spark.createDataFrame([], "id long, text string")
    vec.build_index_table(texts, vec.embed_words(texts, "id", "text", 8), str(tmp_path / "i"), "m", "now")
    d, v, c, m = vec.open_index(spark, str(tmp_path / "i"))
    assert c.first()["num_documents"] == 0 and vec.index_integrity(d, v, c, m).first()["valid"]


def test_word_vectors(spark):
    import hashlib
    df = spark.createDataFrame([(1, "a B  a\tc"), (2, ""), (3, None), (4, "word " * 5000)], "id long, text string")
    got = {r.id: r.embedding for r in vec.embed_words(df, "id", "text", 16).collect()}
    want = [0.0] * 16
    for w in ("a", "b", "a", "c"):
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
    norm = sum(x * x for x in want) ** 0.5
    assert got[1] == pytest.approx([x / norm for x in want]) and got[2] == got[3] == [0.0] * 16 and sum(got[4]) == 1.0


def test_topk_with_text_keys_in_small_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(vec, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vec, "TILE", 100)
    qs = [(i, [float(i % 3) - 1, 0.5, -0.2 * i, 1.0]) for i in range(150)]
    text = docs.withColumn("vec_id", F.format_string("%04d", "vec_id"))
    q = spark.createDataFrame([(f"q{i}", v) for i, v in qs], "query_id string, embedding array<double>")
    got = vec.exact_topk(text, q, 4)
    assert sorted((int(r.query_id[1:]), int(r.vec_id), r["rank"]) for r in got.collect()) == sorted(brute(docs, qs, 4))


def test_context(spark):
    hits = spark.createDataFrame([(1, 10, 2.0, 1), (1, 11, 1.0, 2)], "query_id long, vec_id long, score double, rank int")
    docs = spark.createDataFrame([(11, "second"), (10, "first")], "id long, text string")
    q = spark.createDataFrame([(1, "why?")], "query_id long, question string")
    p = vec.assemble_context(hits, docs, q).first()["prompt"]
    assert "Context:\nfirst\n\nsecond\n\nQuestion: why?\n\nAnswer:" in p


def test_classifier_separates(spark):
    data = [(i, [1.0 + i % 3, 0.1 * (i % 5)], 1) for i in range(30)] + [(100 + i, [-1.0 - i % 2, 0.2], 0) for i in range(10)]
    df = spark.createDataFrame(data, "id long, embedding array<double>, label int")
    out = vec.chosen_probability(vec.domain_classifier(df), df)
    assert out.filter("(p > 0.5) != (label = 1)").count() == 0


@pytest.mark.parametrize("p,want", [(0.5, 1.0), (0.0, 0.5), (1.0, 10.0)])
def test_density_ratio(spark, p, want):
    assert spark.range(1).select(vec.density_ratio_weight(F.lit(p))).first()[0] == pytest.approx(want)
