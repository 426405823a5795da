"""The pipeline against a brute-force version, stage by stage."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from corpus_pipeline import STAGES
from millrace.llm.plans import vocabulary
from millrace.session import materialise

from .conftest import low
from .test_models import _jaccard_truth


def test_stages(docs, texts, spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs.selectExpr("doc_id", "text", "lang", "host as source", "cast(length(text) as long) as n_chars")
    kept = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    for name, stage in STAGES[:-1]:
        before = kept
        docs = materialise(stage(spark, docs, ""))
        assert docs.columns == columns
        kept = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
        if name == "language ID":
            assert all(any(ch.isalpha() for ch in t or "") for _, t, _ in kept) and not Counter(kept) - Counter(before)
            assert {t for _, t, _ in kept} >= {t for d, t, _ in before if d is not None and d < 9}
        elif name == "exact dedup":
            best = {}
            for r in before:
                if low(r[1]) not in best or (r[0] is not None and (best[low(r[1])][0] is None or r[0] > best[low(r[1])][0])):
                    best[low(r[1])] = r
            assert Counter(low(t) for _, t, _ in kept) == Counter(best.keys())
            assert {(d, low(t)) for d, t, _ in kept} == {(r[0], low(r[1])) for r in best.values()}
        else:
            _, component = _jaccard_truth(before, 5, 80)
            assert Counter(kept) == Counter(r for r, c in zip(before, component, strict=True) if r[0] is None or r[0] == c)
    packed = STAGES[-1][1](spark, docs, "").collect()
    from tokenizers import Tokenizer
    bpe = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter({d: len(bpe.encode(t or "", add_special_tokens=False).ids) + 1 for d, t, _ in kept if d is not None})
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert {d: n for d, n in got.items() if d is not None} == dict(want)


def test_empty(spark, no_docs):
    docs = no_docs.selectExpr("doc_id", "text", "lang", "host as source", "cast(1 as long) as n_chars")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, ""))
    assert docs.count() == 0


def test_stage_names_and_sql():
    assert [n for n, _ in STAGES] == ["language ID", "exact dedup", "near dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and re.match("The document pipeline", corpus_pipeline.__doc__)
