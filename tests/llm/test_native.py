"""Exact dedup, URL filter and sharding against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm.exact_dedup import exact_dedup, exact_groups
from millrace.llm.plans import URL_RULES
from millrace.llm.sharding import rendezvous, shard_documents
from millrace.llm.url_filter import url_verdicts
from tests.conftest import rows

from .conftest import low


@pytest.mark.parametrize("buckets", [None, 3])  # 3: nearly all fingerprints clash
def test_exact_groups(docs, texts, buckets):
    mark = {} if buckets is None else {"mark": lambda c: F.xxhash64(c) % F.lit(buckets)}
    got = exact_groups(docs, **mark)
    group = defaultdict(list)
    for d, t, _ in texts:
        group[low(t)].append(d)
    want = []
    for d, t, _ in texts:
        ids = group[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((d, keep, len(ids), d == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_exact_dedup_keeps_one_row_of_each_text(docs, texts, no_docs):
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    left = [low(r["text"]) for r in kept.collect()]
    assert Counter(left) == Counter({low(t) for _, t, _ in texts})
    assert exact_groups(no_docs).count() == 0 and exact_dedup(no_docs).count() == 0


def _verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        host, tail = low(rest[:end]), rest[end:]
        stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
        path = tail[:stop]
    best = None
    for v, r in URL_RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (v, r)
    return host, path, best


def test_url_rules_and_templates(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM", "http://a.com?x=/en/", "http://example.com/en/1", "http://WWW.example.com/en/1",
            "http://x.www.example.com/en/#a", "http://myexample.com/en/", "ftp://b.net/es/1/2/3/4/5/6/7#x", "http://net/fr/", "http://b.net/ES/1",
            "x://y://z.com/a", "http://com/", "http://é.net/fr/ü?q", "http://c.org//double//", "http://c.org/" + "s/" * 3000]
    urls += [f"https://d.net/es/{i}" for i in range(40)] + [f"https://d.net/de/{i}" for i in range(40)] + [f"https://d.net/es?{i}" for i in range(3)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, urls[7], "x", "y"), (5, urls[5], "x", "y")],
                               "page_id long, url string, host string, template string")
    got = {(r["page_id"], r["host"], r["path"]): r for r in url_verdicts(df, URL_RULES).collect()}
    assert url_verdicts(df, URL_RULES).count() == len(urls) + 2
    for i, u in enumerate(urls):
        host, path, rule = _verdict(u)
        r = got[(i, host, path)]
        assert r["rule"] == (rule and rule[1]), u
        if rule:
            assert r["verdict"] == rule[0]
    # ids became wildcards; a branch without labels stays allowed
    by_path = {r["path"]: r for r in got.values() if r["host"] == "d.net"}
    assert by_path["/es/7"]["purity"] < 0.2 and by_path["/de/7"]["verdict"] == "allow" and by_path["/de/7"]["template"] == "de/*"
    assert url_verdicts(df.filter("page_id = -1"), URL_RULES).count() == 0


def test_url_template_is_rejected_by_purity(spark):
    # on a host where the rules block a subtree by one spelling, its template takes other pages along
    rules = [("block", f"e.org/spam/{i}") for i in range(1, 10)]
    urls = [f"http://e.org/spam/{i}" for i in range(100, 200)] + [f"http://e.org/spam/{i}" for i in range(11, 80)] + [f"http://e.org/news/{i}" for i in range(100)]
    urls += ["http://e.org/spam/0"]
    got = url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    assert {(r["path"], r["verdict"]) for r in got.filter("rule is null").select("path", "verdict").distinct().collect()} \
        >= {("/spam/0", "block"), ("/news/5", "allow")}


def test_shards(docs, texts, no_docs):
    got = shard_documents(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _, _ in texts)
    slots, of_key = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of_key[r["doc_id"]].add(r["shard"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_key.values())
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert shard_documents(no_docs).count() == 0


def test_rendezvous_follows_weights(spark):
    n = 40_000
    df = spark.range(n).select(rendezvous(F.col("id"), [1.0, 2.0, 1.0]).alias("a"), rendezvous(F.col("id"), [1.0, 2.0, 1.0, 4.0]).alias("b"))
    c = {r["a"]: r["count"] for r in df.groupBy("a").count().collect()}
    assert abs(c[1] / n - 0.5) < 0.02 and abs(c[0] / n - 0.25) < 0.02
    assert df.filter("a <> b and b <> 3").count() == 0
    assert abs(df.filter("b = 3").count() / n - 0.5) < 0.02
    with pytest.raises(ValueError):
        rendezvous(F.col("id"), [])


def test_slots_of_many_rows(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("doc_id"), F.lit("t").alias("text"))  # three keys only
    got = shard_documents(df, weights=(1.0, 1.0))
    assert got.groupBy("shard").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d"), F.count("*").alias("n")) \
        .filter("lo <> 0 or hi <> n - 1 or d <> n").count() == 0
