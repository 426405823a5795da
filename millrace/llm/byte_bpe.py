"""Byte-level BPE encoding and decoding without a regular expression.

Texts are arrays of code points with a class each.  A class is a transition function between the states
of a small automaton; composing these functions is associative, so states come from a scan in blocks.
States, classes and the next characters give the places where slices begin.  Slices are merged once
each; ids and their places in the vocabulary's bytes give the text back.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Texts, parts, ranges
from .word_encoder import SliceIds

OTHER, LETTER, NUMBER, GAP, SPACE, QUOTE, FIRST_QUOTE = range(7)  # classes; the last is a quote at a text's start
# states: an open quote (it may begin a contraction), a run of others, letters, numbers, gaps, gaps with a space last
S_QUOTE, S_OTHER, S_LETTER, S_NUMBER, S_GAP, S_SPACE = range(6)
BLOCK = 64


def transitions() -> np.ndarray:
    """[class, state] -> state."""
    t = np.empty((7, 6), dtype=np.uint8)
    for cls, state in ((OTHER, S_OTHER), (LETTER, S_LETTER), (NUMBER, S_NUMBER), (GAP, S_GAP), (SPACE, S_SPACE),
                       (FIRST_QUOTE, S_QUOTE)):
        t[cls] = state
    t[QUOTE] = S_QUOTE
    t[QUOTE, [S_QUOTE, S_OTHER, S_SPACE]] = S_OTHER  # a quote joins a run, and a space before it
    return t


def class_table() -> np.ndarray:
    """Class of every code point."""
    import regex
    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for pattern, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", GAP)):
        for m in regex.finditer(pattern, every):
            table[m.start():m.end()] = cls
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    return table


def scan_states(classes: np.ndarray, table: np.ndarray, start: int = S_GAP) -> np.ndarray:
    """State after each character.  Blocks are composed to functions at once, the functions are scanned the
    same way, and each block is run again from the state before it."""
    functions = table[classes] if classes.ndim == 1 else classes
    n = len(functions)
    if n <= BLOCK:
        out, state = np.empty(n, dtype=np.uint8), start
        for i in range(n):
            state = out[i] = functions[i, state]
        return out
    rows = -(-n // BLOCK)
    grid = np.broadcast_to(np.arange(6, dtype=np.uint8), (rows * BLOCK, 6)).copy()
    grid[:n] = functions
    grid = grid.reshape(rows, BLOCK * 6)
    base = (np.arange(rows) * (BLOCK * 6))[:, None]
    flat = grid.ravel()
    whole = grid[:, :6]
    for j in range(1, BLOCK):
        whole = flat[(base + j * 6) + whole]
    before = np.empty(rows, dtype=np.int64)
    before[0], before[1:] = start, scan_states(whole[:-1], table, start)
    out = np.empty((rows, BLOCK), dtype=np.uint8)
    base = base.ravel()
    for j in range(BLOCK):
        out[:, j] = before = flat[(base + j * 6) + before]
    return out.ravel()[:n]


def slice_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Where slices begin (boolean).  ``first`` marks the first character of each text."""
    n = len(points)
    gap = states >= S_GAP
    group = np.where(states == S_QUOTE, S_OTHER, states)
    before_gap, before_group, before_space = np.empty(n, dtype=bool), np.empty_like(group), np.empty(n, dtype=bool)
    before_gap[1:], before_group[1:], before_space[1:] = gap[:-1], group[:-1], states[:-1] == S_SPACE
    before_gap[0], before_group[0], before_space[0] = True, 0, False
    last_gap = np.zeros(n, dtype=bool)  # a gap before another character of its text
    last_gap[:-1] = gap[:-1] & ~gap[1:] & ~first[1:]
    start = np.where(gap, ~before_gap | last_gap, np.where(before_gap, ~before_space, group != before_group)) | first
    # contractions: an open quote with s, t, m, d or re, ve, ll after it in its text
    q = np.flatnonzero(states == S_QUOTE)
    a, b = np.zeros(len(q), dtype=np.uint32), np.zeros(len(q), dtype=np.uint32)
    one = q + 1 < n
    one[one] = ~first[q[one] + 1]
    a[one] = points[q[one] + 1]
    two = one & (q + 2 < n)
    two[two] = ~first[q[two] + 2]
    b[two] = points[q[two] + 2]
    short = np.isin(a, [ord(c) for c in "stmd"])
    long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for hit, size in ((short, 2), (long, 3)):
        at = q[hit]
        start[at + 1] = False
        nxt = at + size
        start[nxt[nxt < n]] = True
    return start


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank, leftmost first, is joined until none is left.  A heap
    of pairs keeps long slices near linear."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = prev[i]
        if p >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class ByteBpe:
    """Encoder and decoder of a rank file (base64 token and rank a line)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(r) for a, r in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values(), default=-1) + 1
        by_rank = [b""] * size
        for token, r in self.ranks.items():
            by_rank[r] = token
        self.lens = np.fromiter(map(len, by_rank), dtype=np.int64, count=size)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(by_rank), dtype=np.uint8)
        self.classes, self.table = class_table(), transitions()
        self.texts, self.cache = Texts(), SliceIds()

    def slices(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (bytes) and text number of each slice."""
        if not len(buf):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        at = np.flatnonzero((buf & 0xC0) != 0x80)  # first byte of each character
        first = np.zeros(len(points), dtype=bool)
        begins = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
        first[begins] = True
        classes = self.classes[points]
        classes[first & (classes == QUOTE)] = FIRST_QUOTE
        start = at[slice_starts(points, first, classes, scan_states(classes, self.table))]
        return start, np.append(start[1:], len(buf)), np.searchsorted(offsets[1:], start, side="right")

    def encode(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First text, its and the following texts' ids, and where each text's ids begin (with the end)."""
        valid = [t if t is None or _utf8(t) else t.decode("utf-8", "replace").encode() for t in texts]
        for i, j, buf, offsets in parts(valid):
            starts, ends, doc = self.slices(buf, offsets)
            codes, distinct = pd.factorize(self.texts.hashes(buf, starts, ends))
            new = np.flatnonzero(self.cache.missing(distinct))
            if len(new):
                first = np.empty(len(distinct), dtype=np.int64)
                first[codes[::-1]] = np.arange(len(codes))[::-1]
                whole = buf.tobytes()
                self.cache.add_lists(distinct[new], [merge(whole[starts[k]:ends[k]], self.ranks) for k in first[new]])
            rows = self.cache.rows_of(distinct)[codes] if len(codes) else codes
            lens = self.cache.lens[rows]
            upto = np.zeros(j - i + 1, dtype=np.int64)
            np.cumsum(np.bincount(doc, weights=lens, minlength=j - i).astype(np.int64), out=upto[1:])
            yield i, self.cache.flat[ranges(self.cache.starts[rows], lens)], upto

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, by their places in the vocabulary's bytes."""
        return self.bytes[ranges(self.starts[ids], self.lens[ids])]


def _utf8(text: bytes) -> bool:
    try:
        text.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def encode_documents(docs: DataFrame, rank_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``ids`` (array of int) of every whole text; null: none.  Every row is one row; other columns are not read."""
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(rank_file)
        for b in batches:
            done = 0
            for i, ids, upto in bpe.encode(b.column("_text").to_pylist()):
                done = i + len(upto) - 1
                rows = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("_key").slice(i, done - i), rows], names=[key, "ids"])
    return docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text")) \
        .mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str, key: str = "doc_id") -> DataFrame:
    """``text_bytes`` of every row of ids (null: none)."""
    kind = encoded.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(rank_file)
        for b in batches:
            texts = [bpe.decode(np.asarray(x or [], dtype=np.int64)).tobytes() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(texts, pa.binary())], names=[key, "text_bytes"])
    return encoded.select(F.col(key).alias("_key"), "ids").mapInArrow(decode, f"`{key}` {kind}, text_bytes binary")


def round_trip_digests(docs: DataFrame, rank_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of ids and of what they decode to, without moving either: ``n_tokens``, ``ids_sha256`` (decimal ids
    joined by commas) and ``decoded_sha256``.  Null is the empty text."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(rank_file)
        printed = [b"%d," % i for i in range(len(bpe.lens))]
        lens = np.fromiter(map(len, printed), dtype=np.int64, count=len(printed))
        starts, digits = np.cumsum(lens) - lens, np.frombuffer(b"".join(printed), dtype=np.uint8)
        for b in batches:
            n, ids_sha, back_sha = [], [], []
            for _, ids, upto in bpe.encode(b.column("_text").to_pylist()):
                for d in range(len(upto) - 1):
                    own = ids[upto[d]:upto[d + 1]]
                    n.append(len(own))
                    ids_sha.append(hashlib.sha256(digits[ranges(starts[own], lens[own])][:-1]).hexdigest())
                    back_sha.append(hashlib.sha256(bpe.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], names=names)
    return docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text")) \
        .mapInArrow(digest, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
