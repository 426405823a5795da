"""Language ID, LM scoring, the Jaccard join and embedding dedup against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup
from millrace.llm.components import components
from millrace.llm.embedding_dedup import near_duplicate_components, suffices
from millrace.llm.hnsw import Hnsw
from millrace.llm.jaccard_join import PartEnum, folded, jaccard_components, jaccard_dedup, sketch
from millrace.llm.language_id import Judge, identify_languages, keep_identified, train_languages, viterbi
from millrace.llm.lm_scoring import score_documents
from millrace.llm.ngram_trie import EliasFano, PairTrie
from tests.conftest import rows

from .conftest import low, prose


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] \
        + [(7, 7), (500, None), (300, 400), (400, 300)]
    shift = list(range(600))
    rng.shuffle(shift)
    links = [(shift[a], None if b is None else shift[b]) for a, b in links]
    u = Union()
    for a, b in links:
        if b is not None and a != b:
            u.join(a, b)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"] for r in got} == {x for a, b in links if b is not None and a != b for x in (a, b)}
    pairs = {(r["root"], u.find(r["node"])) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_signatures_of_all_similar_pairs_meet(percent):
    rng = np.random.default_rng(2)
    enum = PartEnum(percent)
    for _ in range(400):
        n = int(rng.integers(4, 400))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone, new = (int(rng.integers(0, n // 6 + 1)) for _ in range(2))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if both * 100 >= percent * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
            assert np.intersect1d(enum.signatures(a), enum.signatures(b)).size, (len(a), len(b), both)


def _jaccard_truth(texts, width, percent):
    sets = []
    for _, t, _ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    u = Union()
    for i, a in enumerate(sets):
        u.find(i)
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                u.join(i, j)
    least = {}
    for i, (d, _, _) in enumerate(texts):
        if d is not None:
            least[u.find(i)] = min(d, least.get(u.find(i), d))
    return sets, [least.get(u.find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, docs, texts, no_docs, width, percent):
    rng = random.Random(5)
    base = prose(rng, 90).split(" ")
    more = []
    for i in range(60):  # near copies, some of them similar to others of the group only
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice("pqrstu")
        more.append((2000 + i, " ".join(w), None))
    sets, want = _jaccard_truth([*texts, *more], width, percent)
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string, lang string").select("doc_id", "text"))
    got = rows(jaccard_components(every, width, percent), "doc_id", "n_shingles", "component_id")
    # a row without a key and without words is its own component, which has no smallest key
    assert got == sorted(((d, len(s), c) for (d, _, _), s, c in zip([*texts, *more], sets, want)), key=repr)
    if width == 5:
        kept = jaccard_dedup(docs)
        assert kept.columns == docs.columns
        _, own = _jaccard_truth(texts, width, percent)
        stay = {d for (d, _, _), c in zip(texts, own) if d == c} | {None}
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _, _ in texts if d in stay)
        assert jaccard_components(no_docs).count() == 0


def test_jaccard_join_null_and_repeated_keys(spark):
    rng = random.Random(11)
    def changed(words, *places):
        return " ".join("changed" + str(i) if i in places else w for i, w in enumerate(words))
    a, b, c, d = (prose(rng, 100).split(" ") for _ in range(4))
    every = [(1, " ".join(a)), (None, changed(a, 40)), (2, changed(a, 40, 60)),  # the row without a key is the bridge
             (None, " ".join(b)), (None, changed(b, 50)),  # no keys at all
             *[(5, " ".join(x)) for x in (c, d)], *[(5, prose(rng, 50)) for _ in range(20)],  # one key, unlike texts
             (6, changed(c, 30)), (7, changed(d, 30)), (5, changed(d, 70)), (8, changed(d, 30, 70))]
    every = [(k, t, None) for k, t in every]
    sets, want = _jaccard_truth(every, 3, 94)
    assert want[:3] == [1, 1, 1] and _jaccard_truth([every[0], every[2]], 3, 94)[1] == [1, 2]
    df = spark.createDataFrame(every, "doc_id long, text string, lang string").repartition(3)
    got = rows(jaccard_components(df, 3, 94), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((k, len(s), w) for (k, _, _), s, w in zip(every, sets, want)), key=repr)


@pytest.mark.parametrize("few", [0, 4])
def test_jaccard_join_in_small_blocks(spark, monkeypatch, few):
    """Near copies that mostly just miss the threshold, in blocks of a few classes, with and without whole sets in them."""
    import millrace.llm.jaccard_join as module
    monkeypatch.setattr(module, "BLOCK", 3)
    monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(module, "PACK", 2000)
    rng = random.Random(21)
    every = []
    for g in range(3):
        base = prose(rng, 70).split(" ")
        for i in range(25):
            w = list(base)
            for k in rng.sample(range(70), rng.choice([1, 2, 2, 3])):
                w[k] = f"new{g}{i}{k}"
            every.append((100 * g + i, " ".join(w), None))
    every += [(1000 + i, prose(rng, rng.randint(5, 80)), None) for i in range(40)]
    sets, want = _jaccard_truth(every, 5, 80)
    assert 3 < len({c for c in want if c < 1000}) < 75
    df = spark.createDataFrame(every, "doc_id long, text string, lang string").repartition(3)
    got = rows(jaccard_components(df, 5, 80), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((k, len(s), w) for (k, _, _), s, w in zip(every, sets, want)), key=repr)


def test_sketches_bound_overlaps():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (3, 700), (200, 260), (5000, 5200), (40, 90_000)):
        a, b = (np.unique(rng.integers(0, 1 << 63, x).astype(np.uint64)) for x in (n, m))
        b = np.unique(np.concatenate([b, a[:n // 2]]))
        assert folded([sketch(a), sketch(b)]).min(axis=0).sum() >= len(np.intersect1d(a, b))
    # full cells bound nothing
    same = np.arange(1, 3000, dtype=np.uint64) << np.uint64(20)
    assert folded([sketch(same), sketch(same)]).min(axis=0).sum() >= len(same)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top, n in ((10, 0), (10, 1), (1 << 20, 500), (1 << 62, 3000), (40, 200)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = EliasFano(*EliasFano.build(v))
        assert (e.values(np.arange(n)) == v).all()
        x = np.concatenate([v, rng.integers(0, top, 300, dtype=np.uint64)])
        i, hit = e.successor(x)
        assert (i == np.searchsorted(v, x)).all() and (hit == np.isin(x, v)).all()


def test_pair_trie(tmp_path):
    PairTrie.write(str(tmp_path), np.array([3, 9, 2**63], dtype=np.uint64), np.array([5, 1, 7]), np.log10([0.5, 0.25, 0.1]),
                   np.array([2, 0, 1]), np.array([4, 8, 4], dtype=np.uint64), np.array([1.5, -0.5, 2.0]))
    t = PairTrie(str(tmp_path))
    rank, count = t.context(np.array([3, 9, 2**63, 4], dtype=np.uint64))
    assert rank.tolist() == [0, 1, 2, -1] and count.tolist() == [5, 1, 7, 0]
    got = t.weight(np.array([0, 0, 0, 1, 2, -1]), np.array([4, 8, 9, 4, 4, 4], dtype=np.uint64))
    assert np.allclose(got, [1.5, -0.5, math.log10(0.5), math.log10(0.25), 2.0, 0.0], atol=1 / 2048)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 2000])  # many small shards: common words are hot
def test_lm_scores(docs, texts, no_docs, shard_bytes):
    discount, share = 0.9, 0.5
    train = F.coalesce(F.col("doc_id") % 4 != 1, F.lit(False))
    got = {}
    for r in score_documents(docs, train, shard_bytes=shard_bytes).collect():
        got.setdefault(r["doc_id"], []).append(r)
    words = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]) for d, t, _ in texts]
    one, two = Counter(), Counter()
    for d, w in words:
        if d is not None and d % 4 != 1:
            one.update(w)
            two.update(zip([None, *w[:-1]], w))
    after = Counter(h for h, _ in two)
    n = sum(one.values())
    z = n + 0.5 * (len(one) + 1)
    assert sum(map(len, got.values())) == len(texts)
    for d, w in words:
        base = score = 0.0
        for h, t in zip([None, *w[:-1]], w):
            p = (one[t] + 0.5) / z
            q = max(two[h, t] - discount, 0) / one[h] + discount * after[h] / one[h] * p if one[h] else p
            base, score = base + math.log10(p), score + math.log10(share * q + (1 - share) * p)
        assert any(r["n_tokens"] == len(w) and r["n_known"] == sum(one[t] > 0 for t in w) and r["train_tokens"] == n
                   and r["held_out"] == (d is None or d % 4 == 1) and math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
                   and abs(r["score"] - score) <= len(w) / 2048 for r in got[d]), d
    if shard_bytes > 2000:
        assert score_documents(no_docs, train).count() == 0
        assert {r["n_known"] for r in score_documents(docs, F.lit(False)).collect()} == {0}


@pytest.mark.parametrize("order,shard_bytes", [(3, 1 << 20), (3, 2000), (4, 2000)])
def test_lm_scores_of_longer_contexts(docs, texts, order, shard_bytes):
    train = F.coalesce(F.col("doc_id") % 4 != 1, F.lit(False))
    got = {}
    for r in score_documents(docs, train, shard_bytes=shard_bytes, order=order).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    words = [(d, [None] * (order - 1) + [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]) for d, t, _ in texts]
    grams = Counter(tuple(w[i - n + 1:i + 1]) for d, w in words if d is not None and d % 4 != 1
                    for i in range(order - 1, len(w)) for n in range(1, order + 1))
    total, after = Counter(), Counter()
    for g, c in grams.items():
        total[g[:-1]] += c
        after[g[:-1]] += 1
    z = sum(c for g, c in grams.items() if len(g) == 1) + 0.5 * (after[()] + 1)
    longer = 0
    for d, w in words:
        score = 0.0
        for i in range(order - 1, len(w)):
            p = q = (grams[w[i],] + 0.5) / z
            for n in range(2, order + 1):
                g = tuple(w[i - n + 1:i + 1])
                if total[g[:-1]]:
                    q = max(grams[g] - 0.9, 0) / total[g[:-1]] + 0.9 * after[g[:-1]] / total[g[:-1]] * q
                    longer += n > 2
            score += math.log10(0.5 * q + 0.5 * p)
        assert any(abs(s - score) <= (len(w) - order + 1) * order / 2048 for s in got[d]), (d, score, got[d])
    assert longer


def test_languages(spark, docs, texts, no_docs):
    rng = random.Random(3)
    def make(chars, n):
        return " ".join("".join(rng.choice(chars) for _ in range(rng.randrange(2, 8))) for _ in range(n))
    a, b = "abcdefghab", "ghijklmnkl"
    labelled = [(make(a, 60), "aa") for _ in range(30)] + [(make(b, 60), "bb") for _ in range(30)] + [("слово и слова", "cc"), ("x", None)]
    model = train_languages(spark.createDataFrame(labelled, "text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    mixed = make(a, 30) + " " + make(b, 50)
    tests = [(1, make(a, 5)), (2, make(b, 5)), (3, mixed), (4, "слова"), (5, None), (6, ""), (7, "123 !! ½"), (8, "ΑΒΓ"), (9, make(a, 20_000)), (1, make(b, 5))]
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["spans"]) for r in identify_languages(
        spark.createDataFrame(tests, "doc_id long, text string"), model, spans=True).collect()]
    assert [g[1] for g in got[:7]] == ["aa", "bb", "bb", "cc", "und", "und", "und"] and got[7][1] in model.languages and got[8][1] == "aa"
    assert all(0 <= g[2] <= 1 for g in got) and all(g[2] == 0 for g in got[4:7]) and got[7][2] < 0.5
    spans = got[2][3]
    assert [s["lang"] for s in spans] == ["aa", "bb"] and abs(spans[1]["first_word"] - 30) <= 2 and sum(s["words"] for s in spans) == 80
    assert identify_languages(docs, model).count() == len(texts) and identify_languages(no_docs, model).count() == 0
    nothing = train_languages(spark.createDataFrame([("x", None)], "text string, lang string"))
    assert {r["lang_pred"] for r in identify_languages(docs, nothing).collect()} == {"und"}
    kept = keep_identified(docs, model, 0.2)
    assert kept.schema == docs.schema
    judge = Judge(model)
    lang, score, _ = judge.languages([None if t is None else t.encode() for _, t, _ in texts], False)
    assert kept.count() == sum(x != "und" and s >= 0.2 for x, s in zip(lang, score))


def test_texts_of_unlearned_scripts_have_score_0(spark):
    model = train_languages(spark.createDataFrame([("some words here", "aa"), ("andere worte dort", "bb")], "text string, lang string"))
    texts = ["ΑΒΓ ΔΕΖ", "слова и words", "some words и слова here", "some words", "ה", "some andere words worte"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in identify_languages(df, model).collect()}
    assert [score[i] > 0 for i in range(6)] == [False, False, True, True, False, True]
    assert {r["doc_id"] for r in keep_identified(df, model, 0.1).collect()} == {2, 3, 5}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lens = rng.integers(0, 7, 4)
        scores = rng.normal(size=(10, 3)) * 3
        words = rng.integers(0, 10, lens.sum())
        got = viterbi(scores, words, lens, 2.0)
        at = 0
        for n in lens:
            if n:
                paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
                value = scores[words[at:at + n], paths].sum(1) - 2.0 * (paths[:, 1:] != paths[:, :-1]).sum(1)
                own = (paths == got[at:at + n]).all(1).argmax()
                assert math.isclose(value[own], value.max(), abs_tol=1e-9)
            at += n


def test_graph_finds_near_vectors():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 24))
    v[1500:] = v[:1500] + rng.normal(size=(1500, 24)) * 0.05
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph, _ = Hnsw.load(Hnsw(v).save())
    found, _ = graph.search(v[:1500], 48)
    assert np.mean([graph.node.tolist().index(i + 1500) in f for i, f in list(enumerate(found))[::10]]) > 0.97


@pytest.mark.parametrize("shard_rows", [250_000, 40])
def test_embedding_components(spark, shard_rows):
    rng = np.random.default_rng(6)
    d = 12
    v = [rng.normal(size=d) for _ in range(120)]
    centre = rng.normal(size=d)
    v += [centre + rng.normal(size=d) * s for s in (0.02, 0.1, 0.16, 0.2) for _ in range(60)]  # tight, loose, straddling
    v += [v[0], v[0] * 3, -v[0], v[1] + 1e-9]
    data = [(i, x.astype(np.float32).tolist(), "x") for i, x in enumerate(v)]
    bad = [(900, None, "x"), (901, [], "x"), (902, [0.0] * d, "x"), (903, [1.0, None, *[0.0] * (d - 2)], "x"), (904, [float("nan")] * d, "x"),
           (905, [float("inf")] + [0.0] * (d - 1), "x")]
    others = [(910, [1.0, 0.0], "x"), (911, [2.0, 0.1], "x"), (None, data[5][1], "x"), (7, data[7][1], "x")]
    every = [*data, *others]
    m = [np.array(x, dtype=np.float64) for _, x, _ in every]
    u, n = Union(), Counter()
    for i in range(len(m)):
        u.find(i)
        for j in range(i):
            if len(m[i]) == len(m[j]) and m[i] @ m[j] >= 0.9 * np.sqrt((m[i] @ m[i]) * (m[j] @ m[j])):
                u.join(i, j)
                n[i] += 1
                n[j] += 1
    least = {}
    for i, (k, _, _) in enumerate(every):
        if k is not None:
            least[u.find(i)] = min(k, least.get(u.find(i), k))
    df = spark.createDataFrame(every + bad, "vec_id long, embedding array<float>, leader string")
    got = rows(near_duplicate_components(df, shard_rows=shard_rows), "vec_id", "n_links", "component_id", "kept")
    want = [(k, n[i], least.get(u.find(i)), k == least.get(u.find(i))) for i, (k, _, _) in enumerate(every)] + [(k, 0, k, True) for k, _, _ in bad]
    assert got == sorted(want, key=repr)
    if shard_rows > 1000:
        assert near_duplicate_components(df.filter("vec_id = -1")).count() == 0
        assert near_duplicate_components(spark.createDataFrame(bad, df.schema)).filter("kept").count() == len(bad)


def test_few_links_enlarge_the_audit_before_the_beam(spark, monkeypatch):
    def audit(limit, beam):
        def tally(index, queries):
            links = 20 * queries.num_rows  # all found; of the nearest others too few
            return pa.table({"links": [links], "found": [links], "near": [100], "near_found": [50 if beam < 72 else 95]})
        return tally
    monkeypatch.setattr(embedding_dedup, "_audit", audit)
    whole = spark.createDataFrame([(2, 0, None)], "dim int, shard int, data binary")

    def sample(times):
        asked.append(times)
        return spark.range(min(times * 3, most)).selectExpr("2 AS dim", "0 AS shard")
    asked, most = [], 99
    assert embedding_dedup.fitting_beam(whole, sample, 0.4, 48) == 48 and asked == [1, 4]
    asked, most = [], 4  # there are no more
    assert embedding_dedup.fitting_beam(whole, sample, 0.4, 48) == 72 and asked == [1, 4]


def test_search_finds_each_node_once():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph, _ = Hnsw.load(Hnsw(v).save())
    for beam in (1, 3, 40):
        found, sims = graph.search(v[:50], beam)
        assert all(len(set(row)) == beam for row in found.tolist())
        assert np.allclose(sims, np.take_along_axis(v[:50] @ v.T, found, axis=1), atol=1e-5) and (np.diff(sims, axis=1) <= 0).all()


def built_shard(v: np.ndarray, size: int = 100) -> list[dict]:
    """What the task that builds a shard's graph gives for vectors that come in batches, not in order."""
    ids = np.random.default_rng(1).permutation(len(v))
    batches = [pa.RecordBatch.from_pydict({
        "row": pa.array(ids[i:i + size]), "v": pa.array(v[ids[i:i + size]].tolist(), pa.list_(pa.float32())),
        "dim": pa.array([v.shape[1]] * len(ids[i:i + size]), pa.int32()), "shard": pa.array([3] * len(ids[i:i + size]), pa.int32())}) for i in range(0, len(v), size)]
    return [r for batch in embedding_dedup._build(math.cos(0.2))(iter(batches)) for r in batch.to_pylist()]


def test_graphs_move_in_pieces(monkeypatch):
    """An index is not one value: no row grows with its shard, and any order of the pieces gives the same graph."""
    monkeypatch.setattr(embedding_dedup, "PIECE", 4096)
    rng = np.random.default_rng(12)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[1000:] = v[:500] * 2  # in the balls of others
    made = built_shard(v)
    values = [(r["kind"], r["place"], r["n"], r["data"]) for r in made if r["data"] is not None]
    assert max(len(x[3]) for x in values) <= 4096 and sum(x[0] == 0 for x in values) > 10
    assert sorted(r["row"] for r in made if r["data"] is None) == list(range(1500))
    rng.shuffle(values)
    shard = embedding_dedup.Shard(16, values)
    whole = Hnsw(v / np.linalg.norm(v, axis=1, keepdims=True), math.cos(0.2))
    assert shard.ids.tolist() == whole.node.tolist() == list(range(1000)) and (shard.exact == v[:1000]).all()
    for got, want in zip(shard.graph.search(whole.v[:200], 30), whole.search(whole.v[:200], 30)):
        assert (got == want).all() if got.dtype == np.int64 else np.allclose(got, want, atol=1e-6)
    assert len(whole.next[1]) < 120  # the upper levels have rows for their own nodes alone


def test_search_reads_queries_by_the_batch():
    """Pairs are found before all queries were read, so a task does not hold those of the whole table."""
    rng = np.random.default_rng(13)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    values = [r for r in built_shard(v) if r["data"] is not None]
    near = v + rng.normal(size=v.shape).astype(np.float32) * 0.05
    read = []

    def batches():
        yield pa.RecordBatch.from_pylist([{**r, "dim": 8} for r in values])
        for i in range(0, 300, 50):
            read.append(i)
            data = np.arange(1000 + i, 1050 + i).tobytes() + np.zeros(50).tobytes() + near[i:i + 50].tobytes()
            yield pa.RecordBatch.from_pylist([{"dim": 8, "kind": 2, "place": 0, "n": 50, "data": data}])
    found, at = set(), []
    for batch in embedding_dedup._search(math.acos(0.9), 24)(batches()):
        found |= {(r["a"], r["b"]) for r in batch.to_pylist()}
        at.append(len(read))
    assert at[0] == 1 and len(read) == 6
    assert {(i, 1000 + i) for i in range(300)} <= found
    cos = (near / np.linalg.norm(near, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    assert all(cos[b - 1000, a] > math.cos(math.acos(0.9) + 0.2) - 1e-5 for a, b in found)


@pytest.mark.parametrize("beam", [4, 0])
def test_wide_beams_search_few_queries_at_once(beam, monkeypatch):
    rng = np.random.default_rng(14)
    v = rng.normal(size=5) + rng.normal(size=(1000, 5)) * 0.4
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph, cells = Hnsw(v), []
    monkeypatch.setattr(embedding_dedup, "CELLS", 1 << 16)
    search = graph.search
    graph.search = lambda q, b: (cells.append(len(q) * b), search(q, b))[1]
    far = np.full(150, 0.8)
    got = [len(line) for line, _ in embedding_dedup._reach(graph, v[:150].astype(np.float32), far, beam)]
    assert sum(got) >= 0.98 * (v[:150] @ v.T >= 0.8).sum() > 150 * 50
    assert len(got) > 2 and max(cells, default=0) <= 8 * 1000


def test_pooled_recall_suffices():
    # links that a sample does not have prove nothing: the nearest nodes are judged
    assert suffices(1000, 980, 30, 0) and not suffices(1000, 979, 30, 30)
    assert suffices(0, 0, 3000, 2700) and not suffices(0, 0, 3000, 2699)
    assert suffices(99, 99, 3000, 3000) and not suffices(99, 98, 3000, 3000)
    assert suffices(0, 0, 0, 0)


def planted_vectors(n: int, d: int) -> np.ndarray:
    """Vectors of which a quarter have one or two partners close to the threshold on either side."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(n, d))
    half = n // 4
    v[half:2 * half] = v[:half] + rng.normal(size=(half, d)) * rng.uniform(0.3, 0.6, size=(half, 1))
    v[2 * half:2 * half + half // 2] = v[:half // 2] + rng.normal(size=(half // 2, d)) * 0.3
    return v


@pytest.mark.parametrize("beam", [48, 2, 0])
def test_recall_of_planted_links(spark, beam, monkeypatch):
    """Shards of thousands of nodes: links against brute force; a beam that is too narrow is widened by the audit."""
    v = planted_vectors(3000, 32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    if beam == 0:  # no beam suffices: all nodes are read
        monkeypatch.setattr(embedding_dedup, "fitting_beam", lambda *audited: 0)
    got = {r["vec_id"]: r["n_links"] for r in near_duplicate_components(df, shards=2, beam=beam or 48).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert want.sum() > 1000 and len(got) == len(v)
    found = np.array([got[i] for i in range(len(v))])
    assert (found <= want).all()
    assert found.sum() == want.sum() if beam == 0 else found.sum() >= 0.98 * want.sum()


def test_word_counts_pass_32_bits():
    from millrace.llm.lm_scoring import _whole_counts
    row = np.array([1, 0, 1, 1, 2, 0])
    n = np.array([4_000_000_000, 5, 4_000_000_000, 3_999_999_999, 1, 4_294_967_295], dtype=np.uint32)
    assert _whole_counts(row, n).tolist() == [4_294_967_300, 11_999_999_999, 1]
    assert _whole_counts(row[:0], n[:0]).tolist() == []


def test_signatures_move_short(spark):
    """A signature keeps 40 bits below those of its group, and no bucket of near copies is lost by that."""
    from millrace.llm.jaccard_join import SIG_BITS, buckets_of
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(words[:60 + k] + [f"x{k}"] + words[60 + k:])) for k in range(6)]
    own = buckets_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90, "doc_id", "text", 0, 4)
    found = own.groupBy("sig").count().collect()
    assert found and all(0 <= r["sig"] < 4 << SIG_BITS for r in found)
    assert max(r["sig"] for r in found) >= 1 << SIG_BITS  # the bits of the group count
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_classes_of_many_dense_blocks_meet_once(spark):
    """Classes that many signatures share are one grid of blocks; a chain of signatures keeps its own blocks."""
    from millrace.llm.jaccard_join import _once
    dense = [(s, 0, 0, c, c, left) for s in range(100, 110) for c in range(6) for left in (True, False)]
    chain = [(s, 0, 0, c, c, left) for s in range(200, 230) for c in (s, s + 1) for left in (True, False) if not (left and c > s)]
    df = spark.createDataFrame(dense + chain, "sig long, l int, r int, c long, root long, is_left boolean")
    got = _once(df).collect()
    assert sorted((r["sig"], r["l"], r["r"], r["c"], r["is_left"]) for r in got if r["is_grid"]) == sorted((0, 0, 0, c, x) for c in range(6) for x in (True, False))
    assert sorted((r["sig"], r["l"], r["r"], r["c"], r["root"], r["is_left"]) for r in got if not r["is_grid"]) == sorted(chain)


def test_arrays_move_squeezed():
    from millrace.llm.lm_scoring import squeeze, unsqueeze
    rng = np.random.default_rng(2)
    for x in (np.sort(rng.integers(0, 1 << 40, 5000)).astype(np.uint64), np.array([0, 1 << 63, (1 << 64) - 1], dtype=np.uint64), np.zeros(0, dtype=np.uint64)):
        assert (unsqueeze(squeeze(x, True), np.uint64, True) == x).all() and (unsqueeze(squeeze(x), np.uint64) == x).all()
    for x in (rng.integers(-20000, 20000, 5000), rng.normal(size=700), rng.integers(0, 900, 5000).astype(np.uint16)):
        back = unsqueeze(squeeze(x), x.dtype.type)
        assert back.dtype == x.dtype and (back == x).all()
    words = np.sort(rng.integers(0, 1 << 40, 5000)).astype(np.uint64)
    assert len(squeeze(words, True)) < 4.6 * len(words) and len(squeeze(rng.integers(-20000, 20000, 5000))) < 3.5 * 5000


@pytest.mark.parametrize("common", [0, 5, 60])  # words without a number, and some with one
def test_lm_scores_whatever_words_have_numbers(docs, common):
    train = F.coalesce(F.col("doc_id") % 4 != 1, F.lit(False))
    def scores(**how):
        return sorted(score_documents(docs, train, order=3, **how).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    for one, other in zip(scores(), scores(shard_bytes=2000, common=common), strict=True):
        assert one[:5] == other[:5] and math.isclose(one["base_score"], other["base_score"], rel_tol=1e-9)
        assert abs(one["score"] - other["score"]) <= one["n_tokens"] / 1000


def test_lm_blocks_do_not_grow_with_shards(spark):
    from millrace.llm.lm_scoring import _source, frequent_words, pair_blocks
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghilmnorst") for _ in range(7)) for _ in range(2000)]
    weights = [1 / (i + 1) for i in range(2000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=300))) for i in range(400)], "doc_id long, text string").coalesce(1)
    source, size = _source(docs, "doc_id", "text", F.lit(True)), {}
    for shards in (4, 64):
        hot, common = frequent_words(source, shards, 1 << 17)
        assert len(common) > 1000 and hot.size <= 4 * shards
        rows = pair_blocks(source, hot, common, np.zeros(len(common), dtype=np.int64), shards, 3).filter(f"part < {shards}").collect()
        size[shards] = sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray)))
    assert size[64] < 1.3 * size[4], size


def test_hashes_place_by_place_are_those_by_windows():
    from millrace.llm.text import RUN, SHORT, Texts
    texts, rng = Texts(), np.random.default_rng(3)
    buf = rng.integers(0, 256, 100_000).astype(np.uint8)
    for n, longest in ((0, 2), (RUN + 5, 9), (900, SHORT + 4), (60, 700)):
        lens = rng.integers(1, longest, n)
        starts = np.sort(rng.integers(0, len(buf) - longest, n))
        assert (texts.hashes(buf, starts, starts + lens) == texts._long(buf, starts, starts + lens)).all()


def test_rows_in_order_of_keys_that_fill_their_bits():
    from millrace.llm.lm_scoring import _order
    rng = np.random.default_rng(4)
    for n, keys in ((0, 2), (5000, 40), (5000, 1 << 63)):
        key, *others = rng.integers(0, keys, n).astype(np.uint64), *(rng.integers(0, 1 << 40, (2, n)) % (1 << 40 if keys > 40 else 3)).astype(np.uint64)
        by, plain = _order(key, others), np.lexsort((others[1], others[0], key))
        assert all((x[by] == x[plain]).all() for x in (key, *others)) and (np.sort(by) == np.arange(n)).all()


@pytest.mark.parametrize("common", [0, 1 << 17])
def test_lm_words_that_clash_have_the_count_of_the_most_frequent(spark, common):
    # the two words have the same 40 bits of their hash
    def scores(seldom):
        texts = [f"x{i % 3} erndouon" for i in range(30)] + [f"y {seldom}"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {r["doc_id"]: r["score"] for r in score_documents(docs, F.lit(True), order=3, common=common).collect() if r["doc_id"] < 30}
    one, other = scores("ll\u00f1osdoie"), scores("other")
    assert one.keys() == other.keys() and all(math.isclose(one[i], other[i], abs_tol=1e-9) for i in one)
