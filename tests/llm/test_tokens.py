"""Token counts, packing and byte-level BPE against the public libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.byte_bpe import ByteBpe, decode_documents, encode_documents, merge, round_trip_digests
from millrace.llm.packing import complete_bins, pack_documents, packing_slots
from millrace.llm.plans import vocabulary
from millrace.llm.token_counts import at_limits, encoded_lengths, length_histogram, length_quantiles
from millrace.llm.word_encoder import WordEncoder

P = pytest.importorskip("public_tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"
ODD = st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x85\xa0\u2003'strevmld'LS019.,!½é\u0301ßñ中א")), st.characters(exclude_categories=["Cs"])), max_size=40)


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_bpe():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_words_encode_as_whole_texts(word_bpe, texts):
    own = test_words_encode_as_whole_texts.__dict__.setdefault("encoder", WordEncoder(vocabulary("word_bpe_49k.json")))
    got = [ids[upto[d]:upto[d + 1]].tolist() for _, ids, upto in own.encode([t.encode() for t in texts]) for d in range(len(upto) - 1)]
    assert got == [word_bpe(t) for t in texts]


@settings(max_examples=500, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_bytes_encode_as_the_pattern_does(byte_bpe, texts):
    own = test_bytes_encode_as_the_pattern_does.__dict__.setdefault("bpe", ByteBpe(vocabulary(RANKS)))
    got = [ids[upto[d]:upto[d + 1]] for _, ids, upto in own.encode([t.encode() for t in texts]) for d in range(len(upto) - 1)]
    assert [g.tolist() for g in got] == [byte_bpe.encode_ordinary(t) for t in texts]
    assert [own.decode(g).tobytes().decode() for g in got] == texts


def test_merge_of_a_long_slice(byte_bpe):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdeth") for _ in range(20_000))
    assert merge(text.encode(), byte_bpe._mergeable_ranks) == byte_bpe.encode_ordinary(text)


def test_round_trip(docs, texts, no_docs, byte_bpe):
    want = Counter((d, len(i := byte_bpe.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in texts)
    got = round_trip_digests(docs, vocabulary(RANKS))
    assert Counter(map(tuple, got.collect())) == want
    back = decode_documents(encode_documents(docs, vocabulary(RANKS)), vocabulary(RANKS))
    assert Counter((r["doc_id"], bytes(r["text_bytes"]).decode()) for r in back.collect()) == Counter((d, t or "") for d, t, _ in texts)
    assert round_trip_digests(no_docs, vocabulary(RANKS)).count() == 0


def test_slices_of_equal_ids_are_learned_once(word_bpe):
    """Signs after a letter and A-Z make no slices of their own where the file lets them be cut off and lower-cased."""
    texts = ["lech Lech, lech. LECH!? (lech) don't", "a H\u0331 E\u0301 T\u0308, I\u0307. <|endoftext|>x", "<|ENDOFTEXT|>", "\x01 a\x01b 's,'S 9a!"]
    own = WordEncoder(vocabulary("word_bpe_49k.json"))
    assert [ids.tolist() for i, ids, upto in own.encode([texts[0].encode()])] == [word_bpe(texts[0])]
    assert len(own.cache.hashes) == 8  # lech , . !? (lech ) don 't
    for t in texts:
        assert [ids.tolist() for i, ids, upto in own.encode([t.encode()])] == [word_bpe(t)]


def test_counts(docs, texts, no_docs, word_bpe):
    lengths = np.array([len(word_bpe(t)) for _, t, _ in texts])
    hist = length_histogram(encoded_lengths(docs, vocabulary("word_bpe_49k.json")))
    for r in hist.collect():
        limit = r["context_limit"]
        assert (r["docs"], r["docs_over"], r["truncated_tokens"], r["total_tokens"], r["cut_tokens"]) == (
            (lengths == limit).sum(), (lengths > limit).sum(), np.minimum(lengths, limit).sum(), lengths.sum(), np.maximum(lengths - limit, 0).sum())
    for r in at_limits(hist, [0, 7, 100, 10**6]).collect():
        assert r["truncated_tokens"] == np.minimum(lengths, r["limit"]).sum() and r["docs_over"] == (lengths > r["limit"]).sum()
    for r in length_quantiles(hist, [0.25, 0.5, 1.0]).collect():
        assert r["n_tokens"] == np.quantile(lengths, r["share"], method="inverted_cdf")
    assert length_histogram(encoded_lengths(no_docs, vocabulary("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(docs, texts, word_bpe, capacity):
    got = pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity).collect()
    want, total = Counter(), 0
    for d, t, _ in texts:
        ids = np.array(word_bpe(t) + [0], dtype="<u4")
        total += len(ids)
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want[(d, p, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-total // capacity) + 1


def test_packing_nothing(no_docs):
    assert pack_documents(no_docs, vocabulary("word_bpe_49k.json")).count() == 0
    assert complete_bins({}, 8) == []


def _fewest(lengths, capacity):
    """Exhaustive search."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1:]])
        go(i + 1, [*bins, lengths[i]])
    go(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bin_completion_is_optimal_on_small_cases(lengths):
    fill = complete_bins(Counter(lengths), 12)
    placed = Counter()
    for parts, times in fill:
        assert sum(parts) <= 12
        for v in parts:
            placed[v] += times
    assert placed == Counter(lengths)
    assert sum(t for _, t in fill) == _fewest(sorted(lengths, reverse=True), 12)


def test_slots_cover_each_length():
    fill = complete_bins({2048: 5, 1500: 1000, 548: 400, 300: 999, 248: 1200, 7: 50_000}, 2048)
    slots = packing_slots(fill)
    assert (slots["length"] * slots["each"] + slots["offset"] <= 2048).all()
    total = 2048 * 5 + 1500 * 1000 + 548 * 400 + 300 * 999 + 248 * 1200 + 350_000
    assert sum(t for _, t in fill) <= -(-total // 2048) + 2
