"""Jaccard self-join of word shingle sets by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components
from .joins import without
from .text import Texts, mix64, parts, short_batches

FULL = 1_000_000  # signatures of a block
GROUP = 2_000_000  # shingles whose signatures one group compares, on average
SUBPARTS = 3  # second-level parts of a part; all subsets that leave one out are signatures
SPARE = 8  # one part in so many is added, so that empty signatures may be left out
BLOCK = 512  # classes on each side of a block that compares open components
PACK = 16 << 20  # bytes of the sketches of small blocks that share a task, on average
FEW = 4  # pairs per class that leave a block one by one; a block with more compares whole sets
NO_BOUND = 1 << 20  # stands for a sketch's cell that is full
SIG_BITS = 40  # of a signature, besides those that name its group; chance meetings are compared like others
SMALL = 1_000_000  # keys (16 bytes) that are broadcast; more are joined by shuffle


class Shingles:
    """Sets of hashed ``width``-word shingles of lower-cased (A-Z) texts."""

    def __init__(self, width: int, seed: int = 0) -> None:
        self.width, self.texts = width, Texts()
        self.seed = np.uint64(seed)
        self.odd = np.random.PCG64(31 + seed).random_raw(width + 1).astype(np.uint64) | np.uint64(1)

    def sets(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text; of one with fewer words, the hash of them all."""
        for i, j, buf, offsets in parts(texts):
            buf = self.texts.fold[buf]
            starts, ends, doc = self.texts.words(buf, offsets)
            h = self.texts.hashes(buf, starts, ends)
            n = max(0, len(h) - self.width + 1)
            s = np.zeros(n, dtype=np.uint64)
            for k in range(self.width):
                s += h[k:k + n] * self.odd[k]
            s = mix64(s)
            at = np.searchsorted(doc, np.arange(j - i + 1))
            for d in range(j - i):
                a, b = at[d], at[d + 1]
                if b - a >= self.width:
                    yield np.unique(s[a:b - self.width + 1])
                elif b > a:
                    few = h[a:b] * self.odd[:b - a] + self.odd[-1]
                    yield mix64(few.sum(keepdims=True) + np.uint64(b - a))
                else:
                    yield s[:0]


class PartEnum:
    """Signatures of sets: two sets with Jaccard similarity of percent/100 or more share one.

    Sizes fall into bands [l, l * 100 / percent]; a similar pair lies in one band or in neighbours, so a set is
    signed for its own band and the next.  In a band sets differ in at most k elements.  The domain is dealt
    into parts, so that one of them has at most one difference; that part is dealt into ``subparts``, and all of these
    but one are equal.

    Unlike sets share signatures of no element.  With s spare parts, s + 1 parts have at most one difference.  So a set with empty
    signatures in s parts or fewer leaves them out: of the s + 1, one part has none, and its signature is not empty in the other set
    either, which keeps it whatever it does with its own."""

    def __init__(self, percent: int, subparts: int = SUBPARTS) -> None:
        if not 0 < percent <= 100 or subparts < 2:
            raise ValueError("percent must be in 1..100, subparts 2 or more")
        self.percent, self.subparts = percent, subparts
        self.tops = [0]  # largest size of each band

    def band(self, size: int) -> int:
        while self.tops[-1] * self.percent < size * 100:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.tops, size))

    def differences(self, band: int) -> int:
        """Most elements that are in one set only, of two similar ones of this band or the one below."""
        while len(self.tops) <= band:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        return 2 * self.tops[band] * (100 - self.percent) // (100 + self.percent)

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """``elements``: distinct, uint64, well mixed.  No signature where only equal sets are similar."""
        if not len(elements):
            return elements
        own, out = self.band(len(elements)), []
        for band in (own, own + 1):
            k = self.differences(band)
            if k == 0:
                continue
            n1 = (k + 2) // 2
            spare = n1 // SPARE
            n1 += spare
            cell = ((elements >> np.uint64(24)) % np.uint64(n1 * self.subparts)).astype(np.int64)
            sums = np.zeros(n1 * self.subparts, dtype=np.uint64)
            np.add.at(sums, cell, elements)
            sums = sums.reshape(n1, self.subparts)
            without = (sums.sum(axis=1, dtype=np.uint64)[:, None] - sums).ravel()
            place = np.arange(n1 * self.subparts, dtype=np.uint64) + np.uint64(band << 40)
            signed = mix64(without + mix64(place))
            held = np.bincount(cell, minlength=n1 * self.subparts).reshape(n1, self.subparts)
            empty = held.sum(axis=1)[:, None] == held
            if empty.any(axis=1).sum() <= spare:
                signed = signed[~empty.ravel()]
            out.append(signed)
        return np.concatenate(out) if out else elements[:0]


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    return rows.withColumn("t", F.xxhash64("_text"))


def _class(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    a, b = s.sum(dtype=np.uint64), mix64(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    h = mix64(np.array([a, b]) + np.uint64(len(s)))
    return int(h[0].astype(np.int64)), int(h[1].astype(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Exact counts of a set's elements in hash cells, some four in each; 255 stands for more."""
    cells = 1 << max(5, (len(s) // 4).bit_length())
    return np.minimum(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of equally many cells.  The sum of the lesser counts is an upper bound of an overlap."""
    cells = min(map(len, sketches))
    out = np.empty((len(sketches), cells), dtype=np.int32)
    for i, x in enumerate(sketches):
        counts = np.frombuffer(x, dtype=np.uint8).astype(np.int32)
        counts[counts == 255] = NO_BOUND
        out[i] = counts if len(counts) == cells else counts.reshape(-1, cells).sum(axis=0)
    return out


def classes_of(docs: DataFrame, width: int, key: str, text: str, seed: int) -> DataFrame:
    """Key, hash of the text (``t``), size of the set, class (``c``; ``c2`` to verify it) and sketch of each row; empty sets have no class."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width, seed)
        for b in batches:
            rows = [(len(s), *_class(s), sketch(s)) if len(s) else (0, None, None, None) for s in shingles.sets(b.column("_text").to_pylist())]
            *numbers, cells = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("t"), *(pa.array(x, pa.int64()) for x in numbers),
                                              pa.array(cells, pa.binary())], names=["_key", "t", "n_shingles", "c", "c2", "cells"])
    return _scan(docs, key, text).mapInArrow(run, f"_key {kind}, t bigint, n_shingles bigint, c bigint, c2 bigint, cells binary")


def buckets_of(docs: DataFrame, width: int, percent: int, key: str, text: str, seed: int, groups: int) -> DataFrame:
    """Members (sig, c) of each signature that several classes share; a row may come twice.

    A task sorts the signatures of a block of documents.  Members that share one inside the block are passed on as
    they are, and one row for each signature and block goes, packed with its neighbours, to the group of its range.
    So a signature of most documents has a row for each block there, and each signature moves once, in 7 bytes: it keeps ``SIG_BITS`` bits
    below those of its group."""
    spare = np.uint64(max(0, 64 - SIG_BITS - groups.bit_length() + 1))
    top = np.uint64(64 - groups.bit_length() + 1) - spare
    fields = ["part", "c", "sig", "hi", "at"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, enum = Shingles(width, seed), PartEnum(percent)
        seen: dict[int, int] = {}
        sigs: list[np.ndarray] = []
        size, task, block = 0, TaskContext.get().partitionId(), 0
        for b in batches:
            for s in shingles.sets(b.column("_text").to_pylist()):
                c = _class(s)[0] if len(s) else 0
                if not len(s) or c in seen:
                    continue
                own = enum.signatures(s)
                if len(own):
                    seen[c] = len(sigs)
                    sigs.append(own)
                    size += len(own)
                if size > FULL or len(sigs) >= 60_000:
                    yield packed(seen, sigs, task + block)
                    seen, sigs, size, block = {}, [], 0, block + 1
        if sigs:
            yield packed(seen, sigs, task + block)

    def packed(seen: dict[int, int], sigs: list[np.ndarray], number: int) -> pa.RecordBatch:
        c = np.fromiter(seen, dtype=np.int64, count=len(seen))
        at = np.repeat(np.arange(len(sigs), dtype=np.uint16), [len(x) for x in sigs])
        sig = np.concatenate(sigs) >> spare
        order = np.argsort(sig)
        sig, at = sig[order], at[order]
        first = np.ones(len(sig), dtype=bool)
        first[1:] = sig[1:] != sig[:-1]
        twice = ~first
        twice[:-1] |= ~first[1:]
        rows = []
        if twice.any():  # another group passes them on
            rows.append((groups + number % groups, c[at[twice]].tobytes(), sig[twice].tobytes(), b"", b""))
        sig, at = sig[first], at[first]
        part = (sig >> top).astype(np.int64) if groups > 1 else np.zeros(len(sig), dtype=np.int64)
        low = sig & ((np.uint64(1) << top) - np.uint64(1)) if spare else sig
        lo, hi = (low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8)) if spare else (low, np.zeros(0, dtype=np.uint8))
        cut = np.searchsorted(part, np.arange(groups + 1))
        for p in range(groups):
            if cut[p] < cut[p + 1]:
                used, i = np.unique(at[cut[p]:cut[p + 1]], return_inverse=True)
                own = slice(cut[p], cut[p + 1])
                rows.append((p, c[used].tobytes(), lo[own].tobytes(), hi[own].tobytes(), i.astype(np.uint16).tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=fields)

    def shared(blocks: pa.Table) -> pa.Table:
        c = [np.frombuffer(x, dtype=np.int64) for x in blocks.column("c").to_pylist()]
        part, packed_sig = blocks.column("part")[0].as_py(), blocks.column("sig").to_pylist()
        if part >= groups or not spare:
            sig = [np.frombuffer(x, dtype=np.int64) for x in packed_sig]
        else:
            sig = [np.frombuffer(x, dtype=np.uint32).astype(np.int64) | (np.frombuffer(y, dtype=np.uint8).astype(np.int64) << 32) | (part << int(top))
                   for x, y in zip(packed_sig, blocks.column("hi").to_pylist(), strict=True)]
        if part >= groups:
            c, sig = np.concatenate(c), np.concatenate(sig)
        else:
            at = [np.frombuffer(x, dtype=np.uint16) for x in blocks.column("at").to_pylist()]
            c, sig = np.concatenate([x[i] for x, i in zip(c, at, strict=True)]), np.concatenate(sig)
            order = np.argsort(sig, kind="stable")
            sig, c = sig[order], c[order]
            same = sig[1:] == sig[:-1]
            keep = np.zeros(len(sig), dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            sig, c = sig[keep], c[keep]
        return pa.table({"sig": pa.array(sig, pa.int64()), "c": pa.array(c, pa.int64())})
    return _scan(docs, key, text).mapInArrow(split, "part int, c binary, sig binary, hi binary, at binary") \
        .groupBy("part").applyInArrow(shared, "sig bigint, c bigint")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, key: str, text: str, seed: int) -> DataFrame:
    """The set (sorted 8-byte hashes) of each wanted class; ``wanted`` has c and the hash (t) of one text of it.
    Keys play no part: they may be null or repeated.  Where texts of other classes share t, the class is told by the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width, seed)
        for b in batches:
            sets = list(shingles.sets(b.column("_text").to_pylist()))
            own = [len(s) > 0 and _class(s)[0] == c for s, c in zip(sets, b.column("c").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["c", "s"]).filter(pa.array(own, pa.bool_()))
    few = wanted.count() <= SMALL
    side = wanted.select("t", "c")
    return _scan(docs, key, text).join(F.broadcast(side) if few else side, "t").select("c", "_text") \
        .mapInArrow(run, "c bigint, s binary")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule them out; no pair that is similar enough goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for m, n, x, y in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "ka", "kb")), strict=True):
                both = folded([x, y])
                keep.append(int(both.min(axis=0).sum()) * (100 + percent) >= percent * (m + n))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    left = sketches.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ka"))
    right = sketches.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("kb"))
    size = F.greatest("na", "nb") * F.lit(percent) <= F.least("na", "nb") * F.lit(100)
    return pairs.join(left, "a").join(right, "b").filter(size).mapInArrow(run, "a bigint, b bigint")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    left, right = sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint")


def _open_blocks(bucket: DataFrame, root: DataFrame, sketches: DataFrame) -> DataFrame:
    """Blocks (sig, l, r) of classes to compare, in buckets that hold several components: (sig, l, r, c, root, is_left, g).

    What is not in a bucket's largest component is on the left, all is on the right, ``BLOCK`` classes of either in a block.
    Buckets of the same classes count once.  ``g`` puts small blocks together, some ``PACK`` bytes, and leaves others alone."""
    at = materialise(bucket.select("sig", "c").join(root.select(F.col("node").alias("c"), "root"), "c", "left")
                     .select("sig", "c", F.coalesce("root", "c").alias("root")))
    several = at.groupBy("sig").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("c")).alias("x"),
        F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y")).filter("lo <> hi")
    once = materialise(several.groupBy("m", "x", "y").agg(F.min("sig").alias("sig")).select("sig"))
    member = materialise(at.join(once, "sig"))
    size = materialise(member.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("sig").agg(
        F.sum("n").alias("every"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main")))
    lefts, rights = F.ceil((F.col("every") - F.col("most")) / F.lit(BLOCK)), F.ceil(F.col("every") / F.lit(BLOCK))
    sized = member.join(size, "sig").select("sig", "c", "root", (F.col("root") != F.col("main")).alias("rest"),
                                            lefts.cast("int").alias("lefts"), rights.cast("int").alias("rights"))

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("c"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - F.lit(1)))
    held = member.join(sketches.select("c", (F.length("cells") + F.lit(64)).alias("size")), "c").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    packs = held // PACK + 1
    left = sized.filter("rest").select("sig", "c", "root", "lefts", "rights", F.lit(True).alias("is_left"), block("lefts").alias("l"), every("rights").alias("r"))
    right = sized.select("sig", "c", "root", "lefts", "rights", F.lit(False).alias("is_left"), block("rights").alias("r"), every("lefts").alias("l"))
    alone = F.xxhash64("sig", "l", "r")
    return left.unionByName(right).select("sig", "l", "r", "c", "root", "is_left", F.when(
        (F.col("lefts") == 1) & (F.col("rights") == 1), F.pmod(F.xxhash64("sig"), F.lit(packs))).otherwise(alone).alias("g"))


def _once(dense: DataFrame) -> DataFrame:
    """Blocks (sig, l, r, c, root, is_left) that compare whole sets, so that classes that many signatures share meet once.

    Classes that dense blocks connect are a group, compared in a grid of blocks of its own; ``sig`` is then its least class.  Where
    the blocks have fewer pairs than such a grid (groups linked in chains), they stay as they are."""
    dense = materialise(dense.select("sig", "l", "r", "c", "root", "is_left"))
    edges = dense.select("sig", "c").distinct()
    group = components(edges.join(edges.groupBy("sig").agg(F.min("c").alias("b")), "sig").select(F.col("c").alias("a"), "b"))
    member = materialise(dense.select("c", "root").distinct().join(group.select(F.col("node").alias("c"), F.col("root").alias("g")), "c"))
    work = materialise(dense.groupBy("sig", "l", "r").agg(
        F.min("c").alias("c"), F.count_if("is_left").alias("m"), F.count_if(~F.col("is_left")).alias("n")).join(member.select("c", "g"), "c"))
    size = member.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    grid = materialise(work.groupBy("g").agg(F.sum(F.col("m") * F.col("n")).alias("pairs")).join(size, "g").filter(
        "pairs >= n * n").select("g", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("side")))
    own = member.join(grid, "g").withColumn("at", F.pmod(F.xxhash64("c"), F.col("side")).cast("int"))
    left = own.select(F.col("g").alias("sig"), F.col("at").alias("l"), F.explode(F.sequence(F.col("at"), F.col("side") - F.lit(1))).alias("r"),
                      "c", "root", F.lit(True).alias("is_left"))
    right = own.select(F.col("g").alias("sig"), F.explode(F.sequence(F.lit(0), F.col("at"))).alias("l"), F.col("at").alias("r"),
                       "c", "root", F.lit(False).alias("is_left"))
    rest = dense.join(work.join(grid, "g", "left_anti").select("sig", "l", "r"), ["sig", "l", "r"], "left_semi")
    flag = [F.lit(x).alias("is_grid") for x in (True, False)]
    return left.unionByName(right).select("*", flag[0]).unionByName(rest.select("*", flag[1]))


def _sketched(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Task function: of each block the pairs (a, b) of different components that sketches leave; a block with many is
    named instead (sig, l, r)."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sig", "ascending"), ("l", "ascending"), ("r", "ascending")])
        sig, l, r, c, root, n = (rows.column(x).to_numpy() for x in ("sig", "l", "r", "c", "root", "n"))
        is_left = np.array(rows.column("is_left").to_pylist(), dtype=bool)
        cells = rows.column("cells").to_pylist()
        cut = np.flatnonzero((np.diff(sig) != 0) | (np.diff(l) != 0) | (np.diff(r) != 0)) + 1
        a, b, dense = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], []
        for lo, hi in pairwise([0, *cut.tolist(), len(sig)]):
            left, right = lo + np.flatnonzero(is_left[lo:hi]), lo + np.flatnonzero(~is_left[lo:hi])
            if not len(left) or not len(right):
                continue
            counts = folded(cells[lo:hi])
            own, found, many = counts[right - lo], 0, FEW * (len(left) + len(right))
            x, y = [], []
            for i in left.tolist():
                bound = np.minimum(own, counts[i - lo]).sum(axis=1, dtype=np.int64)
                j = right[(root[right] != root[i]) & (bound * (100 + percent) >= percent * (n[right] + n[i]))]
                x.append(np.full(len(j), c[i]))
                y.append(c[j])
                found += len(j)
            if found > many:
                dense.append(lo)
            else:
                a.extend(x)
                b.extend(y)
        one, two = np.concatenate(a), np.concatenate(b)
        none = pa.nulls(len(dense), pa.int64())
        gap = pa.nulls(len(one), pa.int32())
        return pa.table({
            "a": pa.concat_arrays([pa.array(np.minimum(one, two), pa.int64()), none]), "b": pa.concat_arrays([pa.array(np.maximum(one, two), pa.int64()), none]),
            "sig": pa.concat_arrays([pa.nulls(len(one), pa.int64()), pa.array(sig[dense], pa.int64())]),
            "l": pa.concat_arrays([gap, pa.array(l[dense], pa.int32())]), "r": pa.concat_arrays([gap, pa.array(r[dense], pa.int32())])})
    return run


def _compare(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Task function: links of the left classes to the right ones that join components."""
    def compare(rows: pa.Table) -> pa.Table:
        is_left = np.array(rows.column("is_left").to_pylist(), dtype=bool)
        c, root = rows.column("c").to_numpy(), rows.column("root").to_numpy()
        s = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("s").to_pylist()]
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            flat, place = np.unique(np.concatenate([s[i] for i in right]), return_inverse=True)
            n = np.array([len(s[i]) for i in right])
            start = np.cumsum(n) - n
            up = {int(x): int(x) for x in root}

            def top(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x
            mark = np.zeros(len(flat), dtype=np.int32)
            for i in left:
                at = np.minimum(np.searchsorted(flat, s[i]), len(flat) - 1)
                at = at[flat[at] == s[i]]
                mark[at] = 1
                both = np.add.reduceat(mark[place], start)
                mark[at] = 0
                for j in right[100 * both >= percent * (len(s[i]) + n - both)]:
                    x, y = top(int(root[i])), top(int(root[j]))
                    if x != y:
                        up[x] = y
                        out.append((int(c[i]), int(c[j])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return compare


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least ``percent`` / 100 of their word shingles.

    One row per input row: the key, ``n_shingles`` and ``component_id`` (smallest key reachable, its own included).
    A text of fewer words than ``width`` is one shingle; one without words (null, empty, white space) links with
    nothing and is its own component.  Null keys are never the smallest.  Other columns are not read.

    Rows with equal sets are one class (64-bit hash, checked by a second one; on a clash all is hashed anew).
    Classes that share a signature form a bucket.  Its least class is tested against all others, so a bucket of
    n near copies costs n tests.  Where the others are then in several components, what is outside of the largest is
    compared with the whole bucket, in blocks: no pair of different components that shares a
    signature stays untested.  Before sets move, sketches of exact counts (``sketch``) rule out pairs whose overlap can't be enough;
    blocks where many pairs are left compare whole sets, once for all signatures that share them.  Shingles are compared by 64-bit hashes.  A very long text is one set,
    worked on whole by one task, in memory that grows with its length.
    """
    with short_batches(docs.sparkSession):
        return _components(docs, width, percent, key, text)


def _components(docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """``jaccard_components``; all but a last join is written when it returns."""
    seed = 0
    while True:
        base = materialise(classes_of(docs, width, key, text, seed))
        clash = base.filter("c is not null").groupBy("c").agg(F.min("c2").alias("lo"), F.max("c2").alias("hi")).filter("lo <> hi")
        if clash.isEmpty():
            break
        seed += 1
    elements = base.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    groups = 1 << (elements // GROUP).bit_length()
    member = materialise(buckets_of(docs, width, percent, key, text, seed, groups).distinct())
    # written, so that AQE may split a hot signature in the join
    shared = materialise(member.groupBy("sig").agg(F.min("c").alias("pivot"), F.max("c").alias("hi"))
                         .filter("pivot <> hi").drop("hi"))
    bucket = materialise(member.join(shared, "sig").filter("c <> pivot"))
    sketches = materialise(base.filter("c is not null").groupBy("c").agg(
        F.min("t").alias("t"), F.max("n_shingles").alias("n"), F.min("cells").alias("cells")).join(
        member.select("c").distinct(), "c", "left_semi"))

    def sets(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
        wanted = materialise(sketches.select("c", "t").join(nodes, "c", "left_semi"))
        return materialise(sets_of(docs, wanted, width, key, text, seed).dropDuplicates(["c"]))
    pairs = bucket.select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct()
    pairs = materialise(_possible(pairs, sketches, percent))
    links = materialise(_similar(pairs, sets(pairs), percent))
    root = components(links)
    whole = bucket.select("sig", "c").unionByName(shared.select("sig", F.col("pivot").alias("c")))
    blocks = materialise(_open_blocks(whole, root, sketches))
    open_ = materialise(blocks.join(sketches.select("c", "n", "cells"), "c").groupBy("g").applyInArrow(
        _sketched(percent), "a bigint, b bigint, sig bigint, l int, r int"))
    pairs = materialise(open_.filter("sig is null").select("a", "b").distinct())
    more = _similar(pairs, sets(pairs), percent)
    dense = blocks.join(open_.filter("sig is not null").select("sig", "l", "r"), ["sig", "l", "r"], "left_semi")
    if not dense.isEmpty():
        dense = materialise(_once(dense))
        own = sets(dense.select(F.col("c").alias("a"), F.col("c").alias("b")))
        more = more.union(dense.join(own, "c").groupBy("is_grid", "sig", "l", "r").applyInArrow(_compare(percent), "a bigint, b bigint"))
    more = materialise(more)
    if not more.isEmpty():
        root = components(links.union(more))
    named = materialise(base.join(root.select(F.col("node").alias("c"), "root"), "c", "left")
                        .select("_key", "n_shingles", F.coalesce("root", "c").alias("root")))
    least = materialise(named.filter("root is not null").groupBy("root").agg(F.min("_key").alias("least")))
    return named.join(least, "root", "left").select(
        F.col("_key").alias(key), "n_shingles", F.when(F.col("root").isNull(), F.col("_key")).otherwise(F.col("least")).alias("component_id"))


def jaccard_dedup(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document of the smallest key.  Rows without a key
    always stay; rows that share a key stay if one of them does."""
    gone = jaccard_components(docs, width, percent, key, text).filter(F.col(key).isNotNull()) \
        .groupBy(F.col(key).alias("_k")).agg(F.max(F.col(key) == F.col("component_id")).alias("stays")).filter("not stays")
    return without(docs, gone, lambda d, g: d[key] == g["_k"])
