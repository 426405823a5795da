"""Hard negatives, prefix BPE and periodic runs against brute force and the public library."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.hard_negatives import mine_hard_negatives
from millrace.llm.plans import vocabulary
from millrace.llm.runs import RunFinder, periodic_runs, periodic_tail, run_digests
from millrace.llm.word_bpe import PrefixBpe, WordBpe, decode_documents, encode_documents, word_bpe_digests

from .conftest import CLASH

WORDS = "word_bpe_49k.json"


# --- hard negatives ---

def brute_negatives(rows, scale, positives=5, negatives=3, low=50, high=95):
    """rows: (key, label, vector, is_anchor)."""
    inf = float("inf")
    used = [(k, lab, [math.floor(scale * float(x)) for x in v], a) for k, lab, v, a in rows
            if lab is not None and v is not None and all(x is not None and abs(x) < inf for x in v)]

    def order(item):
        return -item[0], item[1] is None, item[1] or 0
    out = []
    for n, (key, label, v, is_anchor) in enumerate(used):
        if not is_anchor:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), k, lab == label) for m, (k, lab, w, _) in enumerate(used) if m != n]
        for ps, pk, _ in sorted((s for s in scored if s[2]), key=order)[:positives]:
            good = sorted((s for s in scored if not s[2] and low * ps <= 100 * s[0] <= high * ps), key=order)[:negatives]
            out += [(key, pk, r, nk, ps, ns) for r, (ns, nk, _) in enumerate(good, 1)]
    return sorted(out, key=str)


def mined(df, **more):
    got = mine_hard_negatives(df, F.col("is_anchor"), key="doc_id", **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(n, seed, width=4, labels=3):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [round(rng.uniform(-0.3, 1), 2) for _ in range(width)], i % 4 == 0) for i in range(n)]


SCHEMA = "doc_id long, label int, embedding array<double>, is_anchor boolean"


@pytest.mark.parametrize("scale", [256.0, 4.0])
def test_negatives_are_those_of_brute_force(spark, scale):
    inf, nan = float("inf"), float("nan")
    rows = vectors(120, 1)
    rows += [rows[0], rows[0], rows[5], (None, 0, [0.5, 0.5, 0.1, 0.2], True), (None, 1, [0.6, 0.5, 0.1, 0.2], False),
             (200, None, [1.0, 1.0, 1.0, 1.0], True), (201, 1, None, True), (202, 1, [nan, 1.0, 1.0, 1.0], True), (203, 1, [1.0, None, 0.0, 0.0], False),
             (204, 2, [inf, 0.0, 0.0, 0.0], False), (205, 2, [0.0, 0.0, 0.0, 0.0], True), (206, 0, [], True), (207, 1, [0.9, 0.2], True),
             (208, 0, [0.0, 0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in [*CLASH, "anchor", "key", "slot", "score", "i", "v", "d", "a"]:
        df = df.withColumn(c, F.lit("x"))
    want = brute_negatives([(k, lab, v, bool(a)) for k, lab, v, a in rows], scale)
    assert mined(df, scale=scale) == want
    assert len(want) > 200


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    import millrace.llm.hard_negatives as module
    rows = vectors(90, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(module, "BLOCK_BYTES", 256)
    monkeypatch.setattr(module, "CELLS", 10)
    assert mined(df) == brute_negatives(rows, 256.0)
    assert mined(df, positives=2, negatives=4, low=20, high=120) == brute_negatives(rows, 256.0, 2, 4, 20, 120)


def test_negatives_with_string_labels_ties_and_no_rows(spark):
    rows = [(i, "ab"[i % 2], [1.0, 0.5 * (i % 3)], True) for i in range(24)]
    df = spark.createDataFrame(rows, SCHEMA.replace("int", "string"))
    assert mined(df) == brute_negatives(rows, 256.0)
    assert mined(df.limit(0)) == [] and mined(df.withColumn("is_anchor", F.lit(False))) == []


def test_products_beyond_doubles_are_exact(spark):
    rows = [(0, 0, [2.0 ** 30 + 1, 1.0], True), (1, 0, [2.0 ** 31 + 3, 1.0], False), (2, 1, [2.0 ** 30 + 5, 1.0], False), (3, 1, [2.0 ** 30 + 7, -1.0], False)]
    got = mined(spark.createDataFrame(rows, SCHEMA), scale=1.0)
    assert got == brute_negatives(rows, 1.0) and len(got) == 2


# --- prefix BPE ---

@pytest.fixture(scope="module")
def library():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary(WORDS))


ODD = st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n\x1c\x85\xa0 'strevmldLS019.,!½é́ßñ中אΣİǅ<|>/w")),
                                 st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_prefix_bpe_is_the_librarys(library, texts):
    own = test_prefix_bpe_is_the_librarys.__dict__.setdefault("bpe", WordBpe(vocabulary(WORDS)))
    got = [ids[upto[d]:upto[d + 1]] for _, ids, upto in own.encode([t.encode() for t in texts]) for d in range(len(upto) - 1)]
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [own.decode(g).decode() for g in got] == [library.decode(g.tolist(), skip_special_tokens=False) for g in got]


def greedy(word: list[str], merges: list[tuple[str, str]]) -> list[str]:
    """Merge the pair of lowest rank, leftmost first, until none is left."""
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        best = min(((rank[p], k) for k, p in enumerate(zip(word, word[1:], strict=False)) if p in rank), default=None)
        if best is None:
            return word
        k = best[1]
        word = [*word[:k], word[k] + word[k + 1], *word[k + 2:]]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_prefix_bpe_of_any_merges(data):
    pieces = ["a", "b", "c", "a$", "b$", "c$"]
    merges: list[tuple[str, str]] = []
    for _ in range(data.draw(st.integers(0, 12))):
        a = data.draw(st.sampled_from([p for p in pieces if not p.endswith("$")]))
        b = data.draw(st.sampled_from(pieces))
        if a + b not in pieces:
            merges.append((a, b))
            pieces.append(a + b)
    vocab = {p: i for i, p in enumerate(pieces)}
    bpe = PrefixBpe(vocab, merges, "$")
    text = data.draw(st.text(alphabet="abc", min_size=1, max_size=24))
    want = greedy([*text[:-1], text[-1] + "$"], merges)
    assert [pieces[t] for t in bpe.encode(text[:-1] + chr(ord(text[-1]) + 0x1000))] == want


def test_long_words_take_linear_work(library):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdeth") for _ in range(200_000))
    ids = next(iter(WordBpe(vocabulary(WORDS)).encode([text.encode()])))[1]
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_are_merged_once(library):
    """Slices that share a piece share its ids, and a worker has one encoder."""
    from millrace.llm.word_bpe import worker_bpe
    own = worker_bpe(vocabulary(WORDS))
    assert worker_bpe(vocabulary(WORDS)) is own
    own.pieces.clear()
    text = "anblewhq Anblewhq, (anblewhq) 'anblewhq' \u00e9anblewhq H\u0331"
    assert next(iter(own.encode([text.encode()])))[1].tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum("anblewhq" in p for p in own.pieces) == 2


def test_word_bpe_documents(spark, docs, no_docs, texts, library):
    path = vocabulary(WORDS)
    want = []
    for key, text, _ in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = word_bpe_digests(docs, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    back = decode_documents(encode_documents(docs, path), path)
    assert sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in back.collect() if r.doc_id is not None) == \
        sorted((k, d) for k, _, _, d in want if k is not None)
    assert word_bpe_digests(no_docs, path).count() == encode_documents(no_docs, path).count() == 0


# --- periodic runs ---

def brute_runs(w, least=6, times=4):
    out = {}
    for p in range(1, len(w)):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, times * p):
                out.setdefault((s, i + p), p)
            i += i == s
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def found(docs: list[list], **more) -> list[list]:
    finder = RunFinder(**more)
    h = np.array([zlib.crc32(str(x).encode()) for w in docs for x in w], dtype=np.uint64)
    got = finder.find(h, np.repeat(np.arange(len(docs)), [len(w) for w in docs]))
    return [got.get(d, []) for d in range(len(docs))]


BLOCKS = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 30)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(st.lists(BLOCKS, min_size=1, max_size=4), st.sampled_from([(6, 4), (2, 3), (9, 3), (12, 5)]))
def test_runs_are_those_of_brute_force(blocks, limits):
    least, times = limits
    docs = [[x for base, n in one for x in (base * n)[:n]] for one in blocks]
    assert found(docs, least=least, times=times) == [brute_runs(w, least, times) for w in docs]


def test_long_repetitive_texts():
    rng = random.Random(2)
    fibonacci = ["a", "b"]
    while len(fibonacci) < 3000:
        fibonacci = [*fibonacci, *fibonacci[:len(fibonacci) - 1]]
    docs = [["a"] * 50_000, ["a", "b", "c"] * 20_000, fibonacci[:1500], [rng.choice("ab") for _ in range(3000)],
            (["x", "y", "y"] * 40 + ["z"]) * 12]
    got = found(docs)
    assert got[0] == [(0, 50_000, 1)] and got[1] == [(0, 60_000, 3)]
    assert got[2:] == [brute_runs(w) for w in docs[2:]]


def words_of(text):
    return (text or "").encode().split()


def test_runs_of_documents(spark, docs, no_docs, texts):
    extra = [(50 + i, t, None) for i, t in enumerate(["na " * 40, "a b " * 9 + "end", "x " * 5, "x " * 6, "A a " * 8, "  " * 7])]
    both = docs.unionByName(spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in extra], docs.schema))
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = periodic_runs(both, F.when(h % 10 == 0, F.floor(h / 10)))
    got = sorted((tuple(r) for r in run_digests(rows).collect()), key=str)
    want, planted = [], 0
    for key, text, _ in [*texts, *extra]:
        w = words_of(text)
        code = zlib.crc32(str(key).encode()) if key is not None else 1
        if code % 10 == 0 and w:
            planted += 1
            n, g = len(w), code // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((key, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
                     hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
    assert got == sorted(want, key=str) and planted > 0
    assert run_digests(periodic_runs(no_docs)).count() == 0


def test_a_tail_is_made_periodic():
    assert periodic_tail(10, 3).tolist() == [0, 1, 2, 3, 4, 3, 4, 3, 4, 3]
    assert periodic_tail(1, 9).tolist() == [0]
