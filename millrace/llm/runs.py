"""Periodic runs of words by maximal pairs in the LCP-interval tree.

Two places of a text, p words apart, whose words agree for l words and not before or after, are a maximal pair: the l + p words
from the first on have period p, and no neighbour extends them.  So the maximal pairs with l >= (times - 1) * p are the runs
of at least ``times`` periods; where several have the same bounds, the smallest period counts.

Suffixes are sorted by prefix doubling, and intervals of equal prefixes are closed from the bottom up.  When a child joins
its interval, its places meet those of the other children that lie within l / (times - 1) words and have another word on
the left.  Places that near are a progression by the prefix's own period, and all but its first have the same word on the left; so the
classes by left word need no lists of their own: in a list sorted by place, the first of the near tells them apart.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Texts, mix64, parts

STEPS = 64  # words by which all open comparisons go on together; longer ones go on alone


def suffix_order(w: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of small integers in order; equal prefixes must end before the sequence does."""
    n = len(w)
    order = np.argsort(w, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = w[order[1:]] != w[order[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    open_ = np.flatnonzero(~first | ~np.append(first[1:], True))
    step = 1
    while len(open_):
        at = order[open_]
        key = rank[at] * n + rank[at + step]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        first = np.ones(len(at), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        order[open_] = at
        rank[at] = open_[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        open_ = open_[~first | ~np.append(first[1:], True)]
        step *= 2
    return order


def common_prefixes(w: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` and the one before it.  Only where the words on
    the left differ is it counted; else it is one less than that of the place before."""
    n = len(w)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    carried = (at > 0) & (before > 0)
    carried[carried] = w[at[carried] - 1] == w[before[carried] - 1]
    length = np.zeros(n, dtype=np.int64)
    i = np.flatnonzero(~carried & (before >= 0))
    for step in range(STEPS):
        i = i[w[i + step] == w[before[i] + step]]
        if not len(i):
            break
        length[i] = step + 1
    for x in i.tolist():
        y, done, size = int(before[x]), STEPS, STEPS
        while True:
            size = min(2 * size, n - max(x, y) - done)
            same = w[x + done:x + done + size] == w[y + done:y + done + size]
            if not same.all():
                length[x] = done + int(np.argmin(same))
                break
            done += size
    counted = np.maximum.accumulate(np.where(carried, 0, at))
    return (length[counted] - (at - counted))[order]


def maximal_pairs(w: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period, of all runs in a sequence of integers whose last one is unique."""
    order = suffix_order(w)
    shared = common_prefixes(w, order)
    shortest = shortest_overlap(least, times)
    inside = shared >= shortest
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    left = np.concatenate([[-1], w[:-1]]).tolist()
    runs: dict[tuple[int, int], int] = {}

    def pair(start: int, period: int, depth: int) -> None:
        if depth + period >= least:
            ends = start, start + period + depth
            runs[ends] = min(period, runs.get(ends, period))

    def join(a: list[int], b: list[int], depth: int) -> list[int]:
        """Pairs between two children of an interval; their places in one sorted list."""
        if len(a) < len(b):
            a, b = b, a
        reach = depth // (times - 1)
        for i in b:
            k = bisect_left(a, i - reach)
            if k < len(a) and a[k] < i and left[a[k]] != left[i]:
                pair(a[k], i - a[k], depth)
            k = bisect_right(a, i)
            while k < len(a) and a[k] <= i + reach and left[a[k]] != left[i]:
                pair(i, a[k] - i, depth)
                k += 1
        if len(b) * 16 < len(a):
            for i in b:
                insort(a, i)
        else:
            a += b
            a.sort()
        return a

    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        places, depths = order[lo - 1:hi].tolist(), [*shared[lo:hi].tolist(), 0]
        stack: list[tuple[int, list[int]]] = []
        for place, depth in zip(places, depths, strict=True):
            child = [place]
            while stack and stack[-1][0] > depth:
                d, others = stack.pop()
                child = join(others, child, d)
            if stack and stack[-1][0] == depth:
                child = join(stack.pop()[1], child, depth)
            stack.append((depth, child))
    return runs


def shortest_overlap(least: int, times: int) -> int:
    """Least number of words by which the two places of any run agree."""
    return min(max((times - 1) * p, least - p) for p in range(1, least + 1))


class RunFinder:
    """Runs in batches of texts.  Words are compared by 64-bit hashes."""

    def __init__(self, least: int = 6, times: int = 4) -> None:
        if times < 3 or least < 2:
            raise ValueError("times must be 3 or more, least 2 or more")
        self.least, self.times, self.texts = least, times, Texts()
        self.odd = np.random.PCG64(43).random_raw(shortest_overlap(least, times)).astype(np.uint64) | np.uint64(1)

    def may_have(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Texts that can have a run (none with one is left out).  In a run of period q all overlaps but the last begin a
        stretch of word groups that come again in the text, each within q words."""
        width = len(self.odd)
        n = max(0, len(h) - width + 1)
        group = mix64(doc[:n].astype(np.uint64))
        for k in range(width):
            group = group + h[k:k + n] * self.odd[k]
        at = np.flatnonzero(doc[:n] == doc[width - 1:width - 1 + n])
        order = at[np.argsort(group[at], kind="stable")]
        again = group[order[1:]] == group[order[:-1]]
        gap = np.zeros(n + 1, dtype=np.int64)
        gap[order[:-1][again]] = np.diff(order)[again]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gap > 0]).astype(np.int8)))
        lo, hi = edge[::2], edge[1::2]
        stretch = np.zeros(n + 1, dtype=np.int64)
        place = np.flatnonzero(gap)
        stretch[place] = np.repeat(hi - lo, hi - lo)
        good = place[(self.times - 1) * gap[place] <= stretch[place] + width - 1]
        return np.unique(doc[good])

    def find(self, h: np.ndarray, doc: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Text number -> runs (start, length, period), by start and period.  ``doc`` is the text of each word, ascending."""
        some = self.may_have(h, doc)
        if not len(some):
            return {}
        own = np.flatnonzero(np.isin(doc, some))
        words, ids = np.unique(h[own], return_inverse=True)
        first = np.searchsorted(doc[own], some)
        end = np.append(first[1:], len(own))
        # a word of its own after each text
        w = np.insert(ids.ravel().astype(np.int64), end, len(words) + np.arange(len(some)))
        begin = first + np.arange(len(some))
        out: dict[int, list[tuple[int, int, int]]] = {}
        for (start, stop), period in sorted(maximal_pairs(w, self.least, self.times).items()):
            k = int(np.searchsorted(begin, start, side="right")) - 1
            out.setdefault(int(some[k]), []).append((start - int(begin[k]), stop - start, period))
        return {d: sorted(runs, key=lambda r: (r[0], r[2])) for d, runs in out.items()}


def periodic_tail(n: int, g: int) -> np.ndarray:
    """Which of its n words each word becomes when a text's tail is made periodic by the number g."""
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def periodic_runs(docs: DataFrame, tail: Column | None = None, least: int = 6, times: int = 4, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """``key``, ``runs`` (array of start, length, period; by start, then period) and ``collapsed`` of each row.

    Words are runs of bytes that are not ASCII white space, numbered from 0 and not lower-cased.  A run is a stretch of words with smallest period q
    and a length of at least ``least`` and ``times`` * q, which no neighbouring word extends.  ``collapsed`` has
    the words left when of each run all after the first q go, joined by a space.  ``tail`` (null: none) makes a text's
    words periodic first, see ``periodic_tail``.

    Null, empty and blank texts have no runs and an empty text left.  Rows with a null or repeated key are worked on one by one;
    other columns are not read.  A very long text is worked on whole by one task, in memory that grows with its length.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = RunFinder(least, times)
        for b in batches:
            texts, tails = b.column("_text").to_pylist(), b.column("_tail").to_pylist()
            for i, j, buf, offsets in parts(texts):
                starts, ends, doc = finder.texts.words(buf, offsets)
                h = finder.texts.hashes(buf, starts, ends)
                upto = np.searchsorted(doc, np.arange(j - i + 1))
                moved = {}
                for d in range(j - i):
                    a, z = upto[d], upto[d + 1]
                    if tails[i + d] is not None and z > a:
                        moved[d] = periodic_tail(int(z - a), tails[i + d])
                        h[a:z] = h[a:z][moved[d]]
                found = finder.find(h, doc)
                left = []
                for d in range(j - i):
                    words = (texts[i + d] or b"").split()
                    if d in moved:
                        words = [words[k] for k in moved[d].tolist()]
                    if d in found:
                        kept = np.ones(len(words), dtype=bool)
                        for start, length, period in found[d]:
                            kept[start + period:start + length] = False
                        words = [words[k] for k in np.flatnonzero(kept).tolist()]
                    left.append(b" ".join(words))
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(d, [])] for d in range(j - i)]
                entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                yield pa.RecordBatch.from_arrays([b.column("_key").slice(i, j - i), pa.array(runs, pa.list_(entry)), pa.array(left, pa.binary())],
                                                 names=["_key", "runs", "collapsed"])
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"),
                       (F.lit(None) if tail is None else tail).cast("bigint").alias("_tail"))
    found = rows.mapInArrow(run, f"_key {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return found.select(F.col("_key").alias(key), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of ``periodic_runs``: ``n_runs``, the run of the greatest exact length / period (ties: smallest start, then
    period; nulls where there is none), and hashes of the list of runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
