"""Word n-gram probabilities in a trie of Elias-Fano sequences with memory-mapped levels."""

from __future__ import annotations

import os

import numpy as np

WORD_BITS = 40  # of a successor's hash; it is looked for below its context only
PIECE = 1 << 18  # values that are packed at once
STEP = 2048  # quantised log10: steps in a unit
ZERO = 32768  # code of 0


class EliasFano:
    """A non-decreasing sequence of unsigned integers: low bits packed, high bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, shape: np.ndarray) -> None:
        self.low, self.high = low, high
        self.n, self.bits, self.size = (int(x) for x in shape)
        gaps = np.flatnonzero(np.unpackbits(self.high, count=self.size) == 0)
        kind = np.uint32 if self.n < 1 << 32 else np.int64
        self.ends = np.append(gaps - np.arange(len(gaps)), self.n).astype(kind)
        self.upto = self.ends[:-1]  # elements whose high part is at most k
        self._high: np.ndarray | None = None

    @staticmethod
    def build(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits >> 6) + 2, dtype=np.uint64)
        size = n + ((top - 1) >> bits) + 1 if n else 1
        ones = np.zeros(size, dtype=bool)
        for i in range(0, n, PIECE):
            v = values[i:i + PIECE].astype(np.uint64)
            ones[(v >> np.uint64(bits)).astype(np.int64) + np.arange(i, i + len(v))] = True
            if bits:
                part = v & np.uint64((1 << bits) - 1)
                at = np.arange(i, i + len(v)) * bits
                word, off = at >> 6, (at & 63).astype(np.uint64)
                np.add.at(low, word, part << off)
                np.add.at(low, word + 1, (part >> np.uint64(1)) >> (np.uint64(63) - off))
        return low, np.packbits(ones), np.array([n, bits, size])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        v = (self.low[word] >> off) | ((self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - off))
        return v & np.uint64((1 << self.bits) - 1)

    def values(self, i: np.ndarray) -> np.ndarray:
        if self._high is None:  # high part of each element
            self._high = np.repeat(np.arange(len(self.ends), dtype=self.ends.dtype), np.diff(self.ends, prepend=self.ends.dtype.type(0)))
        return (self._high[i].astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element that is not less than x, between ``first`` and ``last``, and whether it is x."""
        high = x >> np.uint64(self.bits)
        k = np.minimum(high, np.uint64(len(self.upto))).astype(np.int64)
        lo, hi = np.where(k > 0, self.ends[np.maximum(k - 1, 0)], 0).astype(np.int64), self.ends[k].astype(np.int64)
        if first is not None:
            lo, hi = np.maximum(lo, first), np.maximum(np.minimum(hi, last), np.maximum(lo, first))
        stop, low = hi.copy(), x & np.uint64((1 << self.bits) - 1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        hit = lo < stop
        hit[hit] = self._low(lo[hit]) == low[hit]
        return lo, hit


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(log10 * STEP) + ZERO, 0, 65535).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.float64) - ZERO) / STEP


class PairTrie:
    """Levels: contexts (hash, count, back-off weight), pointers, successors (hash below the context, weight).

    Weights are log10 of p(word | context) / p(word), quantised: a pair that was not seen has the context's
    weight, a context that was not seen has 0."""

    LEVELS = ("contexts", "pointers", "successors")

    @classmethod
    def write(cls, folder: str, contexts: np.ndarray, counts: np.ndarray, backoff: np.ndarray, sizes: np.ndarray,
              words: np.ndarray, weights: np.ndarray) -> None:
        """``contexts``: sorted hashes; ``sizes``: successors of each; ``words``: their hashes (``WORD_BITS``), sorted in each."""
        rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        for name, values in zip(cls.LEVELS, (contexts, upto, (rank << np.uint64(WORD_BITS)) | words), strict=True):
            for part, array in zip(("low", "high", "shape"), EliasFano.build(values), strict=True):
                np.save(os.path.join(folder, f"{name}.{part}.npy"), array)
        np.save(os.path.join(folder, "counts.npy"), counts)
        np.save(os.path.join(folder, "backoff.npy"), quantise(backoff))
        np.save(os.path.join(folder, "weights.npy"), quantise(weights))

    def __init__(self, folder: str) -> None:
        def load(name: str) -> np.ndarray:
            return np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r").view(np.ndarray)
        self.contexts, self.pointers, self.successors = (
            EliasFano(*(load(f"{name}.{part}") for part in ("low", "high", "shape"))) for name in self.LEVELS)
        self.counts, self.backoff, self.weights = load("counts"), load("backoff"), load("weights")

    def context(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each context, and its count (0: not seen)."""
        i, hit = self.contexts.successor(contexts)
        count = np.zeros(len(i), dtype=np.int64)
        count[hit] = self.counts[i[hit]]
        return np.where(hit, i, -1), count

    def weight(self, rank: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log10 of p(word | context) / p(word) for contexts of these ranks."""
        return self.weight_of(rank, self.successor(rank, words), np.ones(len(rank), dtype=np.int64))

    def weight_of(self, rank: np.ndarray, found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of p(word | context) / p(word): ``sizes`` words for the context of each rank, at these indexes (-1: none)."""
        back = np.zeros(len(rank))
        back[rank >= 0] = restore(self.backoff[rank[rank >= 0]])
        out = np.repeat(back, sizes)
        hit = found >= 0
        out[hit] = restore(self.weights[found[hit]])
        return out

    def successor(self, rank: np.ndarray, words: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Index of each word below its context (-1: none); ``sizes`` words for the context of each rank, else one."""
        return _below(self.pointers, self.successors, rank, words, sizes)


def _below(pointers: EliasFano, entries: EliasFano, parent: np.ndarray, words: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Index of each word among the entries of its parent (-1: none).  ``sizes``: words of each parent, one after the other."""
    first, last = np.zeros(len(parent), dtype=np.int64), np.zeros(len(parent), dtype=np.int64)
    known = np.flatnonzero(parent >= 0)
    first[known], last[known] = pointers.values(parent[known]), pointers.values(parent[known] + 1)
    if sizes is not None:
        parent, first, last = np.repeat(parent, sizes), np.repeat(first, sizes), np.repeat(last, sizes)
    out = np.full(len(parent), -1)
    known = np.flatnonzero(first < last)
    i, hit = entries.successor((parent[known].astype(np.uint64) << np.uint64(WORD_BITS)) | words[known], first[known], last[known])
    out[known[hit]] = i[hit]
    return out


class Level:
    """One more level of a trie: pointers of the parents, and words (hash below the parent, weight)."""

    @staticmethod
    def write(folder: str, name: str, parents: int, parent: np.ndarray, words: np.ndarray, weights: np.ndarray) -> None:
        """``parent``: rank of each word's parent; sorted by parent and word."""
        upto = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=parents))])
        entries = (parent.astype(np.uint64) << np.uint64(WORD_BITS)) | words
        for kind, values in (("pointers", upto), ("words", entries)):
            for part, array in zip(("low", "high", "shape"), EliasFano.build(values), strict=True):
                np.save(os.path.join(folder, f"{name}.{kind}.{part}.npy"), array)
        np.save(os.path.join(folder, f"{name}.weights.npy"), quantise(weights))

    def __init__(self, folder: str, name: str) -> None:
        def load(what: str) -> np.ndarray:
            return np.load(os.path.join(folder, f"{name}.{what}.npy"), mmap_mode="r").view(np.ndarray)
        self.pointers, self.words = (EliasFano(*(load(f"{k}.{part}") for part in ("low", "high", "shape"))) for k in ("pointers", "words"))
        self.weights = load("weights")

    def find(self, parent: np.ndarray, words: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        return _below(self.pointers, self.words, parent, words, sizes)

    def weight(self, i: np.ndarray) -> np.ndarray:
        """Weights of these indexes; 0 for -1."""
        out = np.zeros(len(i))
        out[i >= 0] = restore(self.weights[i[i >= 0]])
        return out
