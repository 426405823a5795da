"""Language-model scores of documents by a sharded trie of word n-grams."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialise
from .ngram_trie import STEP, WORD_BITS, Level, PairTrie
from .text import Texts, give_back, mix64, parts, ranges, released, short_batches

SHARD_BYTES = 16 << 20  # text whose pairs one shard scores, on average
BLOCK_BYTES = 6 << 20  # text whose pairs are counted together before they move
BLOCK_DOCS = 60_000
PACKED_ROWS = 32  # rows that go to a Python worker at once; packed rows have some 100 KB
assert BLOCK_DOCS < 1 << 16  # a document's number in its block has 16 bits
DISCOUNT = 0.9  # taken from the count of each pair that was seen
PAIR_SHARE = 0.5  # of the pair model; the rest is the single word's probability
END = 0x5DEECE66D1234567  # hash of the end token
WORD = np.uint64((1 << WORD_BITS) - 1)
CELLS = 1 << 16  # of tokens by hash: only those of full cells can be hot
COMMON = 1 << 17  # words that have a number in all tasks, by which they move; all others move by hash
SPREAD = 1 << 20  # cells of tokens by hash; each offers one word for a number


class Tokens:
    """Hashed tokens of blocks of texts: words with A-Z lower-cased, and an end after each text."""

    def __init__(self) -> None:
        self.texts = Texts()

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token, the token before it (an end before the first) and text number."""
        token, number = [], []
        for i, j, buf, offsets in parts(texts):
            buf = self.texts.fold[buf]
            starts, ends, doc = self.texts.words(buf, offsets)
            own = np.full(len(starts) + j - i, END, dtype=np.uint64)
            own[np.arange(len(starts)) + doc] = self.texts.hashes(buf, starts, ends)
            count = np.bincount(doc, minlength=j - i) + 1
            token.append(own)
            number.append(np.repeat(np.arange(i, j), count))
        t = np.concatenate(token) if token else np.zeros(0, dtype=np.uint64)
        before = np.empty_like(t)
        before[1:] = t[:-1]
        before[:1] = END
        return t, before, np.concatenate(number) if number else np.zeros(0, dtype=np.int64)


class Common:
    """Words with a number, the same in all tasks (0: the most frequent), in place of their hashes."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.short = words, words & WORD
        self.orders = [np.argsort(x, kind="stable") for x in (self.words, self.short)]
        self.held = self.short.copy()

    def __len__(self) -> int:
        return len(self.words)

    def number(self, hashes: np.ndarray, short: bool = False) -> np.ndarray:
        """Number of each word (-1: none); ``short``: by the bits that successors keep."""
        if not len(self):
            return np.full(len(hashes), -1)
        order, x = self.orders[short], self.short if short else self.words
        at = order[np.minimum(np.searchsorted(x, hashes, sorter=order), len(x) - 1)]
        return np.where(x[at] == hashes, at, -1)

    def kind(self, others: int) -> type:
        """Kind of the numbers where a row lists so many words without one."""
        return np.uint16 if len(self) + others <= 1 << 16 else np.uint32

    def listed(self, number: np.ndarray, code: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Ranks of the row's words without a ``code``; they get the numbers after the common ones in ``number``."""
        x = np.concatenate(ranks)
        x = np.sort(x[code[x] < 0])
        x = x[_starts(x)]
        number[x] = len(self) + np.arange(len(x))
        return x

    def row(self, others: np.ndarray) -> np.ndarray:
        """Short hashes by number, for a row that lists these words; the array is used again for the next row."""
        upto = len(self) + len(others)
        if upto > len(self.held):
            self.held = np.append(self.short, np.zeros(2 * len(others), dtype=np.uint64))
        self.held[len(self):upto] = others
        return self.held


def older(word: np.ndarray, number: np.ndarray, order: int, end: int) -> list[np.ndarray]:
    """The words two and more places before each token, as far as ``order`` needs; ``end`` before the text."""
    out = []
    for k in range(2, order):
        u = np.full(len(word), end, dtype=word.dtype)
        u[k:] = np.where(number[k:] == number[:-k], word[:-k], word.dtype.type(end))
        out.append(u)
    return out


def sort_key(ranks: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One number for each row, in the order of the rows' ranks (each below its size)."""
    key, span = ranks[0].astype(np.uint64), sizes[0]
    for rank, size in zip(ranks[1:], sizes[1:], strict=True):
        if span * size > 1 << 63:
            kinds, key = np.unique(key, return_inverse=True)
            key, span = key.astype(np.uint64), len(kinds)
        key, span = key * np.uint64(size) + rank.astype(np.uint64), span * size
    return key


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """Packs an array for a shuffle: compressed, all first bytes of its numbers, then all second ones, and so on.  ``rising``
    (unsigned integers in order): the differences in place of the numbers."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(packed: bytes, kind: type, rising: bool = False) -> np.ndarray:
    """The array of this kind that ``squeeze`` packed."""
    size = int.from_bytes(packed[:8], "little")
    if not size:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(pa.decompress(packed[8:], size, codec="zstd", asbytes=True), dtype=np.uint8)
    values = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def context_key(before: np.ndarray, us: list[np.ndarray]) -> np.ndarray:
    """Hash of a context: the word before and the ones before that."""
    key = mix64(before)
    for u in us:
        key = mix64((key ^ mix64(u + np.uint64(1))) + np.uint64(0x9E3779B97F4A7C15))
    return key


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where a row of these columns differs from the one before."""
    new = np.ones(len(cols[0]), dtype=bool)
    new[1:] = False
    for x in cols:
        new[1:] |= x[1:] != x[:-1]
    return new


def _order(key: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Order of rows by a key and then by others of ``WORD_BITS`` each."""
    by = np.argsort(key)
    key = key[by]
    for x in others:
        rank = np.cumsum(_starts(key)).astype(np.uint64)
        if len(rank) and int(rank[-1]) >> (64 - WORD_BITS):
            rank, x = np.cumsum(_starts(key)), x[by]
            o = np.lexsort((x, rank))
            by, key = by[o], np.cumsum(_starts(rank[o], x[o])).astype(np.uint64)
            continue
        key = (rank << np.uint64(WORD_BITS)) | x[by]
        o = np.argsort(key)
        by, key = by[o], key[o]
    return by


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _counted(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of short counts, in 64 bits."""
    return np.add.reduceat(c, first, dtype=np.int64) if len(first) else np.zeros(0, dtype=np.int64)


def _whole_counts(row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of block counts per row number, in 64 bits: a common word of a large corpus passes 2^32."""
    order = np.argsort(row, kind="stable")
    return _sums(n[order].astype(np.int64), np.flatnonzero(_starts(row[order])))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of several batches, in blocks of bounded text; one longer text is a block."""
    held: dict[str, list] = {}
    size = 0
    for b in batches:
        rows = {c: b.column(c).to_pylist() for c in b.schema.names}
        for i, text in enumerate(rows["_text"]):
            n = len(text or b"")
            if held and (size + n > BLOCK_BYTES or len(held["_text"]) >= BLOCK_DOCS):
                yield held
                held, size = {}, 0
            for c in rows:
                held.setdefault(c, []).append(rows[c][i])
            size += n
    if held:
        yield held


def deal(before: np.ndarray, token: np.ndarray, hot: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each pair, and the context's number among the hot ones (-1: not hot).  A context's pairs share a
    shard; those of a hot one are dealt over all by their word."""
    at = hot_number(before, hot)
    key = np.where(at >= 0, before ^ mix64(token & WORD), before)
    return (mix64(key + np.uint64(1)) % np.uint64(shards)).astype(np.int64), at


def hot_number(before: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The context's number among the hot ones (-1: not hot)."""
    if not len(hot):
        return np.full(len(before), -1)
    at = np.searchsorted(hot, before)
    return np.where(hot[np.minimum(at, len(hot) - 1)] == before, at, -1)


def _source(docs: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    return docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"), train.alias("_train"))


def frequent_words(source: DataFrame, shards: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of hot words, which hold a quarter of a shard or more (at most 4 for each shard), and of the words that get a
    number: ``most`` at most, about the most frequent ones.  Which words have one decides how many bytes move, and no result."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        seen, offered = np.zeros(SPREAD, dtype=np.int64), np.zeros(SPREAD, dtype=np.uint64)
        def out(what: int, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), what, dtype=np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                                              names=["what", "h", "n"])
        for held in blocks(batches):
            token = tokens.of(held["_text"])[0]
            cell, total = (token & np.uint64(SPREAD - 1)).astype(np.int64), len(token)
            n = np.bincount(cell, minlength=SPREAD)
            seen += n
            offered[cell] = token
            cell &= CELLS - 1
            h, n = np.unique(token[(n.reshape(-1, CELLS).sum(axis=0) >= total / (8 * shards))[cell]], return_counts=True)
            many = n >= total / (8 * shards)
            yield out(0, np.append(h[many], np.uint64(0)), np.append(n[many], total))
        cells = np.flatnonzero(seen > 2)
        if len(cells) > most:
            cells = cells[np.argpartition(-seen[cells], most)[:most]] if most else cells[:0]
        yield out(1, offered[cells], seen[cells])
    sums = materialise(source.mapInArrow(released(count), "what int, h bigint, n bigint").groupBy("what", "h").agg(F.sum("n").alias("n")))
    words, numbered = sums.filter("what = 0"), sums.filter("what = 1")
    total = words.filter("h = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = words.filter((F.col("h") != 0) & (F.col("n") * F.lit(4 * shards) >= F.lit(total))).select("h").collect()
    # the least count by a histogram, so that no task sorts the words of all others
    step = F.floor(F.log("n") * 12)
    least, upto = None, 0
    for r in sorted(numbered.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        upto += r["count"]
        if upto > most:
            break
        least = r["step"]
    common = numbered.filter(F.lit(False) if least is None else step >= least).select("h", "n").toArrow()
    h, n = (np.array(common.column(c), dtype=np.int64) for c in ("h", "n"))
    return np.sort(np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)), h[np.lexsort((h, -n))].view(np.uint64)


COUNTS = tuple("abcdef")  # columns of packed counts


def count_grams(source: DataFrame, hot: np.ndarray, common: np.ndarray, shards: int, order: int) -> DataFrame:
    """Exact counts of words and of longer contexts that end in a hot word, sent on to the shards that need them.

    Rows: ``part`` (shard) with words and counts, and with keys (``w``), counts (``n``) and successors (``t``) of contexts that
    have an n-gram there, seen or asked for; -1: distinct words and tokens of a group; -2: for hot contexts their count and distinct
    successors; -3: numbers and counts of words with a number, which go to no shard."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, numbered = Tokens(), Common(common)
        for held in blocks(batches):
            token, before, number = tokens.of(held["_text"])
            learn = np.array(held["_train"], dtype=bool)[number]
            target, at = deal(before, token, hot, shards)
            whole, own = np.unique(token, return_inverse=True)
            del token, before
            rows = word_rows(numbered, whole, own, learn, target, at)
            if order > 2 and len(hot):
                rows += context_rows(numbered, whole, own, learn, number, at)
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=["part", *COUNTS])

    def word_rows(numbered: Common, whole: np.ndarray, own: np.ndarray, learn: np.ndarray, target: np.ndarray, at: np.ndarray) -> list[tuple]:
        """Words by group: those without a number by hash, those with one, counts, and places: shards for the former, hot words before for all."""
        places, code = shards + len(hot), numbered.number(whole)
        far, below = learn & (code < 0)[own], learn & (at >= 0)
        pairs = np.sort(np.concatenate([own[far] * places + target[far], own[below] * places + (shards + at[below])]))
        pairs = pairs[_starts(pairs)]
        row, to = pairs // places, pairs % places
        n, k = np.bincount(own[learn], minlength=len(whole)), np.bincount(row, minlength=len(whole))
        group = (mix64(whole + np.uint64(2)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(group * (len(numbered) + 1) + np.where(code < 0, len(numbered), code), kind="stable")
        order = order[n[order] > 0]
        to = to[ranges((np.cumsum(k) - k)[order], k[order])]
        word, n, group, k, code = whole[order], n[order], group[order], k[order], code[order]
        cut, upto = np.searchsorted(group, np.arange(shards + 1)), np.append(0, np.cumsum(k))
        first = cut[:-1] + np.diff(np.append(0, np.cumsum(code >= 0))[cut])
        return [(g, squeeze(word[i:z], True), squeeze(code[a:i].astype(np.uint32), True), squeeze(n[a:z].astype(np.uint32)),
                 squeeze(k[a:z].astype(np.uint32)), squeeze(to[upto[a]:upto[z]].astype(np.uint32)), None)
                for g, (a, i, z) in enumerate(zip(cut[:-1], first, cut[1:], strict=True)) if z > a]

    def context_rows(numbered: Common, whole: np.ndarray, own: np.ndarray, learn: np.ndarray, number: np.ndarray, at: np.ndarray) -> list[tuple]:
        """Contexts by group: the hot word's place, older words and successors by number (``Common``)."""
        mine = np.flatnonzero(at >= 0)
        if not len(mine):
            return []
        vocabulary, rank = np.unique(whole & WORD, return_inverse=True)
        code, end = numbered.number(vocabulary, True), int(rank[np.searchsorted(whole, np.uint64(END))])
        word = rank[own]
        us = [u[mine] for u in older(word, number, order, end)]
        word, at, learn, to, rows = word[mine], at[mine], learn[mine].astype(np.int64), code.copy(), []
        for n in range(3, order + 1):
            o = np.argsort(sort_key([at, *us[:n - 2], word], [len(hot)] + [len(vocabulary)] * (n - 1)))
            v, old, w = at[o], [u[o] for u in us[:n - 2]], word[o]
            new = _starts(v, *old)
            context, first = np.flatnonzero(new), np.flatnonzero(new | _starts(w))
            c, w = _sums(learn[o], first), w[first]
            kn = np.diff(np.append(np.searchsorted(first, context), len(first)))
            v, old = v[context], [u[context] for u in old]
            group = (context_key(hot[v], [vocabulary[u] for u in old]) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(group, kind="stable")
            at_first = ranges((np.cumsum(kn) - kn)[by], kn[by])
            v, old, kn, w, c = v[by], np.stack(old)[:, by], kn[by], w[at_first], c[at_first]
            cut, upto = np.searchsorted(group[by], np.arange(shards + 1)), np.append(0, np.cumsum(kn))
            for p, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if i < j:
                    a, z = upto[i], upto[j]
                    others = numbered.listed(to, code, [w[a:z], old[:, i:j].ravel()])
                    kind = numbered.kind(len(others))
                    rows.append((shards + p, squeeze(v[i:j].astype(np.uint32), True), squeeze(to[old[:, i:j]].astype(kind).ravel()), squeeze(kn[i:j].astype(np.uint32)),
                                 squeeze(to[w[a:z]].astype(kind)), squeeze(c[a:z].astype(np.uint32)), squeeze(vocabulary[others], True)))
        return rows

    def gather(rows: pa.Table) -> pa.Table:
        packed = [rows.column(c).to_pylist() for c in COUNTS]
        out = (word_sums if rows.column("part")[0].as_py() < shards else context_sums)(packed)
        give_back()
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({"part": pa.array(cols[0], pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in zip("wnt", cols[1:], strict=True)}})

    def word_sums(packed: list[list[bytes]]) -> list[tuple]:
        word = np.concatenate([x for w, i in zip(*packed[:2], strict=True) for x in (common[unsqueeze(i, np.uint32, True)], unsqueeze(w, np.uint64, True))])
        n, k, to = (np.concatenate([unsqueeze(x, np.uint32) for x in column]) for column in packed[2:5])
        distinct, row = np.unique(word, return_inverse=True)
        total = _whole_counts(row, n)
        pairs = np.sort(to.astype(np.int64) * len(distinct) + np.repeat(row, k))
        pairs = pairs[_starts(pairs)]
        to, at = pairs // len(distinct), pairs % len(distinct)
        out = [(-1, np.array([len(distinct)]).tobytes(), np.array([int(total.sum())]).tobytes(), None)]
        cut = np.searchsorted(to, np.arange(shards + len(hot) + 1))
        for t in range(shards):
            if cut[t] < cut[t + 1]:
                own = slice(cut[t], cut[t + 1])
                out.append((t, squeeze(distinct[at[own]] & WORD), squeeze(total[at[own]]), None))
        after = np.diff(cut[shards:])
        mine = np.searchsorted(distinct, hot)
        mine = np.where((mine < len(distinct)) & (distinct[np.minimum(mine, len(distinct) - 1)] == hot), total[np.minimum(mine, len(distinct) - 1)], 0)
        out.append((-2, np.asarray(mine, dtype=np.int64).tobytes(), after.astype(np.int64).tobytes(), None))
        code = Common(common).number(distinct)
        out.append((-3, code[code >= 0].astype(np.uint32).tobytes(), total[code >= 0].tobytes(), None))
        return out

    def context_sums(packed: list[list[bytes]]) -> list[tuple]:
        numbered, got = Common(common), []
        for r in zip(*packed, strict=True):
            v, kn, n, others = unsqueeze(r[0], np.uint32, True), unsqueeze(r[2], np.uint32), unsqueeze(r[4], np.uint32), unsqueeze(r[5], np.uint64, True)
            kind, words = numbered.kind(len(others)), numbered.row(others)
            key = context_key(hot[v], list(words[unsqueeze(r[1], kind)].reshape(-1, len(v))))
            got.append((np.repeat(key, kn), np.repeat(v, kn), words[unsqueeze(r[3], kind)], n))
        key, v, w, n = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        o = _order(key, [w])
        key, w, v, n = key[o], w[o], v[o], n[o].astype(np.int64)
        first = np.flatnonzero(_starts(key, w))
        key, w, v, n = key[first], w[first], v[first], _sums(n, first)
        new = _starts(key)
        first, owner = np.flatnonzero(new), np.cumsum(new) - 1
        total, after = _sums(n, first), _sums((n > 0).astype(np.int64), first)
        to = deal(hot[v], w, hot, shards)[0]
        keep = total[owner] > 0
        pairs = np.sort(to[keep] * len(first) + owner[keep])
        pairs = pairs[_starts(pairs)]
        to, owner = pairs // len(first), pairs % len(first)
        cut = np.searchsorted(to, np.arange(shards + 1))
        return [(p, squeeze(key[first[i]], True), squeeze(total[i]), squeeze(after[i]))
                for p in range(shards) if len(i := owner[cut[p]:cut[p + 1]])]
    return source.mapInArrow(released(count), f"part int, {', '.join(f'{c} binary' for c in COUNTS)}") \
        .groupBy("part").applyInArrow(gather, "part int, w binary, n binary, t binary")


def _totals(answers: DataFrame, code: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the groups of two short arrays (``size`` numbers each), added up in tasks."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for rows in batches:
            for x, y in zip(rows.column("w").to_pylist(), rows.column("n").to_pylist(), strict=True):
                a += np.frombuffer(x, dtype=np.int64)
                b += np.frombuffer(y, dtype=np.int64)
        i = np.arange(size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(a), pa.array(b)], names=["i", "a", "b"])
    rows = answers.filter(F.col("part") == code).mapInArrow(add, "i bigint, a bigint, b bigint") \
        .groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    a, b = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for r in rows:
        a[r["i"]], b[r["i"]] = r["a"], r["b"]
    return a, b


PAIRS = ("h", "i", "hn", "v", "w", "wn", "u", "m", "d", "train")


def pair_blocks(source: DataFrame, hot: np.ndarray, common: np.ndarray, common_count: np.ndarray, shards: int, order: int) -> DataFrame:
    """All n-grams of all documents, packed by block and shard, and for each block its documents.

    An n-gram of a block moves once, with the documents it is in: word before (once for its pairs), word (once
    for the pair) and older words by number, number of occurrences (1), and the document of each (2); all of them squeezed.
    Words without a number (``Common``) are listed by hash, 5 bytes a word, and have the numbers after the common ones in their
    row.  So a row's bytes follow its n-grams, into however many shards a block is dealt.  The block's own row brings what common
    words add to the single words' scores."""
    fields, kind = ["part", "block", *PAIRS, "keys"], source.schema["_key"].dataType
    keys = pa.list_(to_arrow_type(kind))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, number_of = Tokens(), TaskContext.get().partitionId(), 0
        numbered, single_of = Common(common), np.log10(common_count + 0.5)
        for held in blocks(batches):
            block = (task << 24) + number_of
            number_of += 1
            token, before, doc = tokens.of(held["_text"])
            train = np.array(held["_train"], dtype=bool)
            part = deal(before, token, hot, shards)[0]
            whole, own = np.unique(token, return_inverse=True)
            del token, before
            vocabulary, rank = np.unique(whole & WORD, return_inverse=True)  # words of the block, by what successors keep of them
            code, end = numbered.number(vocabulary, True), np.uint64(END)
            listed = numbered.number(whole)
            by = np.argsort(np.where(listed < 0, len(numbered), listed), kind="stable")  # contexts with a number come first, by number; others by hash
            place = np.empty(len(by), dtype=np.int32)
            place[by] = np.arange(len(by))
            own, rank, whole, listed, end = place[own], rank[by].astype(np.int32), whole[by], listed[by], int(place[np.searchsorted(whole, end)])
            part, doc = part.astype(np.int32), doc.astype(np.int32)
            n = np.bincount(doc, minlength=len(train)).astype(np.int64)
            at = np.flatnonzero(listed >= 0)
            single, known = np.zeros(len(listed)), np.zeros(len(listed))
            single[at], known[at] = single_of[listed[at]], common_count[listed[at]] > 0
            single, known = (np.bincount(doc, weights=x[own], minlength=len(train)) for x in (single, known))
            word = rank[own]
            context_of = np.append(np.int32(end), own[:-1])  # a text ends with an end, which comes before the next
            us = older(word, doc, order, int(rank[end]))
            by = np.argsort(sort_key([context_of, word, *us], [len(whole)] + [len(vocabulary)] * (order - 1)))
            del own
            by = by[np.argsort(part[by].astype(np.uint16) if shards <= 1 << 16 else part[by], kind="stable")]
            part, context_of, word, doc, us = part[by], context_of[by], word[by], doc[by], [u[by] for u in us]
            new_context = _starts(part, context_of)
            new_pair = new_context | _starts(word)
            new_entry = new_pair | _starts(word, *us)
            start = np.flatnonzero(new_entry)
            new_entry |= (np.arange(len(part)) - start[np.cumsum(new_entry) - 1]) % 255 == 0  # a long list of documents goes on in a new row
            entry, pair, context = np.flatnonzero(new_entry), np.flatnonzero(new_pair), np.flatnonzero(new_context)
            m = np.diff(np.append(entry, len(part))).astype(np.uint8)
            wn = np.diff(np.append(np.searchsorted(entry, pair), len(entry))).astype(np.uint32)
            hn = np.diff(np.append(np.searchsorted(pair, context), len(pair))).astype(np.uint32)
            w, h = word[pair], whole[context_of[context]]
            old = np.stack([u[entry] for u in us]) if us else np.zeros((0, len(entry)), dtype=np.int64)
            listed, number = listed[context_of[context]], code.copy()
            numbers = np.append(0, np.cumsum(listed >= 0))
            bits = np.packbits(train).tobytes()
            rows = []
            edges = np.arange(shards + 1)
            cuts = [np.searchsorted(x, edges) for x in (part[context], part[pair], part[entry], part)]
            for p, (a, z), (b, y), (e, f), (c, x) in zip(range(shards), *(zip(i[:-1], i[1:], strict=True) for i in cuts), strict=True):
                if z > a:
                    mine = numbered.listed(number, code, [w[b:y], old[:, e:f].ravel()])
                    kind, i = numbered.kind(len(mine)), a + numbers[z] - numbers[a]
                    rows.append((p, block, squeeze(h[i:z], True), squeeze(listed[a:i].astype(np.uint32), True), squeeze(hn[a:z]), squeeze(vocabulary[mine], True),
                                 squeeze(number[w[b:y]].astype(kind)), squeeze(wn[b:y]), squeeze(number[old[:, e:f]].astype(kind).ravel()), squeeze(m[e:f]),
                                 squeeze(doc[c:x].astype(np.uint16)), bits, None))
            # the documents of the block: keys, numbers of tokens, scores and numbers of known common words
            rows.append((shards + block % shards, block, single.tobytes(), known.astype(np.int64).tobytes(), *[None] * 6, n.tobytes(), bits, held["_key"]))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[2:-1]),
                 pa.array(cols[-1], keys)], names=fields)
    return source.mapInArrow(released(pack), f"part int, block bigint, {', '.join(f'{c} binary' for c in PAIRS)}, keys array<{kind.simpleString()}>")


def _shard(discount: float, share: float, smoothed: float, hot: np.ndarray, hot_count: np.ndarray, hot_after: np.ndarray, common: np.ndarray,
           common_count: np.ndarray, order: int):
    """Task function of a shard: its n-grams and the counts of their words in, sums for documents of blocks out."""
    names = ["block", "shard", "a", "b", "n", "d", "keys"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _none(left, names)
        if left.column("keys").null_count < left.num_rows:  # a group of the blocks' own rows
            return pa.table({"block": left["block"], "shard": pa.array([-1] * left.num_rows, pa.int32()), "a": left["train"],
                             "b": left["h"], "n": left["i"], "d": left["d"], "keys": left["keys"]})
        cols, numbered = [left.column(c) for c in PAIRS], Common(common)

        def entries(i: int) -> tuple[np.ndarray, ...]:
            """Contexts of a row with their pairs, words of pairs with their n-grams, older words, occurrences, documents, training occurrences,
            and the number of contexts that have a number, which come first."""
            r = dict(zip(PAIRS, (c[i].as_py() for c in cols), strict=True))
            hn, wn, v, first = unsqueeze(r["hn"], np.uint32), unsqueeze(r["wn"], np.uint32), unsqueeze(r["v"], np.uint64, True), unsqueeze(r["i"], np.uint32, True)
            h = np.append(common[first], unsqueeze(r["h"], np.uint64, True))
            kind, v = numbered.kind(len(v)), numbered.row(v)
            m, d = unsqueeze(r["m"], np.uint8), unsqueeze(r["d"], np.uint16)
            old = v[unsqueeze(r["u"], kind)].reshape(order - 2, len(m))
            learn = np.unpackbits(np.frombuffer(r["train"], dtype=np.uint8))[d]
            c = np.add.reduceat(learn, np.cumsum(m, dtype=np.int64) - m, dtype=np.uint8)  # at most 255 occurrences in a row
            return h, hn, v[unsqueeze(r["w"], kind)], wn, old, m, d, c, len(first)

        # rows stay packed; what was not learned goes at once, and rows are unpacked again when they are scored
        kept, far = [], []
        for i in range(left.num_rows):
            h, hn, w, wn, us, _, _, c, _ = entries(i)
            asked = np.repeat(np.repeat(np.isin(h, hot), hn), wn) & (c == 0)  # contexts whose totals come from elsewhere
            h, w, seen = np.repeat(np.repeat(h, hn), wn), np.repeat(w, wn), c > 0
            far.append((h[asked], us[:, asked]))
            kept.append((h[seen], w[seen], c[seen], us[:, seen]))
        del h, w, c, us, asked, seen
        h, w, c = (np.concatenate([x[i] for x in kept]) for i in range(3))
        us = np.concatenate([x[3] for x in kept], axis=1)
        asked_h, asked_us = np.concatenate([x[0] for x in far]), np.concatenate([x[1] for x in far], axis=1)
        del kept, far
        # a hot context has its other words in other shards, and may have none here
        contexts = np.union1d(h, hot[hot_count > 0])
        up, asked_up = (np.searchsorted(contexts, x).astype(np.int32) for x in (h, asked_h))
        if len(asked_h):  # a context that was never learned has no weights
            learned = np.flatnonzero(contexts[np.minimum(asked_up, max(len(contexts) - 1, 0))] == asked_h) if len(contexts) else []
            asked_up, asked_us = asked_up[learned], asked_us[:, learned]
        pair = (up.astype(np.uint64) << np.uint64(WORD_BITS)) | w
        del h, w, asked_h
        by = _order(pair, list(us)).astype(np.uint32 if len(pair) < 1 << 32 else np.int64)
        pair, up, c, us = pair[by], up[by], c[by], us[:, by]
        del by
        new = _starts(pair)
        first = np.flatnonzero(new)
        sizes, counts = np.bincount(up[first], minlength=len(contexts)), np.bincount(up, weights=c, minlength=len(contexts)).astype(np.int64)
        after = sizes.copy()
        at = np.searchsorted(contexts, hot[hot_count > 0])
        counts[at], after[at] = hot_count[hot_count > 0], hot_after[hot_count > 0]
        pair_of = above = (np.cumsum(new) - 1).astype(np.int32)
        nodes = []  # of each longer order: first entry, parent, count
        for u in us:
            new = new | _starts(u)
            at = np.flatnonzero(new).astype(np.int32)
            nodes.append((at, above[at], _counted(c, at)))
            above = (np.cumsum(new) - 1).astype(np.int32)
        w, pair_count, context_of = pair[first] & WORD, _counted(c, first), up[first]
        del new, above, pair, first
        answers = list(zip(*(right.column(x).to_pylist() for x in ("w", "n", "t")), strict=True))
        def numbers(i: int, kind: type, longer: bool) -> np.ndarray:
            return np.concatenate([unsqueeze(x[i], kind, longer and not i) for x in answers if (x[2] is not None) == longer] or [np.zeros(0, dtype=kind)])
        known, single = np.append(numbers(0, np.uint64, False), numbered.short), np.append(numbers(1, np.int64, False), common_count)
        by = np.lexsort((-single, known))  # of words that clash in their short hashes the most frequent one comes first, in whatever order they came
        known, single = known[by], single[by]
        p = (single[np.searchsorted(known, w)] + 0.5) / smoothed if len(w) else np.zeros(0)
        back = discount * after / np.maximum(counts, 1)
        ratio = (pair_count - discount) / (counts[context_of] * p) + back[context_of]
        del known, single, by, pair_count, context_of
        with tempfile.TemporaryDirectory() as folder:
            PairTrie.write(folder, contexts, counts, np.log10(share * back + 1 - share), sizes, w, np.log10(share * ratio + 1 - share))
            keys, key_count, key_after = numbers(0, np.uint64, True), numbers(1, np.int64, True), numbers(2, np.int64, True)
            by = np.argsort(keys)
            keys, key_count, key_after = keys[by], key_count[by], key_after[by]
            del answers, by
            learned, size = len(up), len(w)
            is_hot = np.isin(contexts, hot)
            # the n-grams that were seen, then those asked for below hot contexts
            up, us = np.concatenate([up, asked_up]), np.concatenate([us, asked_us], axis=1)
            context_of, up_size = up, len(contexts)
            for n, (at, parent, own) in enumerate(nodes, 3):
                entry = (up.astype(np.uint64) << np.uint64(WORD_BITS)) | us[n - 3]
                by = np.argsort(entry).astype(np.uint32 if len(entry) < 1 << 32 else np.int64)
                entry = entry[by]
                new = _starts(entry)
                of = np.empty(len(entry), dtype=np.int32)
                of[by] = np.cumsum(new) - 1
                entry, where = entry[new], by[new]
                del by, new
                total = np.bincount(of[:learned], weights=c, minlength=len(entry))
                follow = np.bincount(of[at], minlength=len(entry)).astype(np.float64)
                far = np.flatnonzero(is_hot[context_of[where]])
                if len(far):
                    total[far], follow[far] = 0, 0
                    key = context_key(contexts[context_of[where[far]]], list(us[:n - 2, where[far]]))
                    i = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                    hit = keys[i] == key if len(keys) else np.zeros(len(key), dtype=bool)
                    total[far[hit]], follow[far[hit]] = key_count[i[hit]], key_after[i[hit]]
                lower = discount * follow / np.maximum(total, 1)
                kept = np.flatnonzero(total > 0)
                Level.write(folder, f"contexts{n}", up_size, (entry[kept] >> np.uint64(WORD_BITS)).astype(np.int64), entry[kept] & WORD, np.log10(lower[kept]))
                ratio = (own - discount) / (total[of[at]] * p[pair_of[at]]) + lower[of[at]] * ratio[parent]
                row = np.full(len(entry), -1, dtype=np.int32)
                row[kept] = np.arange(len(kept))
                up, up_size = row[of], len(kept)
                del entry, where, total, follow, lower, kept, of, row
                Level.write(folder, f"words{n}", size, parent, us[n - 3][at], np.log10(share * ratio + 1 - share))
                size = len(at)
                if n < order and len(up) > learned:  # what was asked for and not learned has no longer contexts
                    stay = np.concatenate([np.arange(learned), learned + np.flatnonzero(up[learned:] >= 0)])
                    up, context_of, us = up[stay], context_of[stay], us[:, stay]
            del us, c, w, up, nodes, pair_of, ratio, p, context_of, asked_up, asked_us, contexts, counts, after, back, sizes, keys, key_count, key_after
            give_back()
            trie = PairTrie(folder)
            longer = [(Level(folder, f"contexts{n}"), Level(folder, f"words{n}")) for n in range(3, order + 1)]
            out = []
            for i, (block, part) in enumerate(zip(left.column("block").to_pylist(), left.column("part").to_pylist(), strict=True)):
                h, hn, w, wn, old, m, d, _, first = entries(i)
                rank, count = trie.context(h)
                node = trie.successor(rank, w, hn)
                weight, below = np.repeat(trie.weight_of(rank, node, hn), wn), _counted(wn, np.cumsum(hn, dtype=np.int64) - hn)
                above, sizes = np.repeat(rank, below), wn
                for n, ((lower, level), u) in enumerate(zip(longer, old, strict=True), 3):
                    node, sizes = level.find(node, u, sizes), None
                    unseen = np.flatnonzero(node < 0)
                    if n < order:
                        above = lower.find(above, u)
                        under = above[unseen]
                    else:  # an n-gram that was seen has its own weight
                        under = lower.find(above[unseen], u[unseen])
                    less = np.maximum(10 ** weight[unseen] - (1 - share), 1e-12) * 10 ** lower.weight(under) + 1 - share
                    weight = np.where(node < 0, weight, level.weight(node))
                    weight[unseen[under >= 0]] = np.log10(less[under >= 0])
                size = 8 * len(cols[-1][i].as_py())
                weight = np.bincount(d, weights=np.repeat(np.rint(weight * STEP), m), minlength=size)
                # of contexts without a number: how often each was learned, by document; they are the last in the row
                ngrams = int(below[:first].sum())
                d_far, c_far = d[int(m[:ngrams].sum(dtype=np.int64)):], np.repeat(np.repeat(count[first:], below[first:]), m[ngrams:])
                c_far, n_far = c_far[np.argsort(d_far, kind="stable")], np.bincount(d_far, minlength=size)
                here = np.bincount(d, minlength=size) > 0
                docs, bits = np.flatnonzero(here), np.packbits(here).tobytes()
                listed = docs.astype(np.uint16).tobytes()
                weight = weight[here].astype(np.int64)
                out.append((block, part, squeeze((weight << 1) ^ (weight >> 63)), squeeze(c_far), squeeze(n_far[here].astype(np.uint32)),
                            b"b" + bits if len(bits) < len(listed) else b"l" + listed, None))
            del trie, longer
        give_back()
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[2:6]),
                         pa.nulls(len(out), left.schema.field("keys").type)], names=names)
    return score


def _none(left: pa.Table, names: list[str]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4, left.schema.field("keys").type]
    return pa.table([pa.array([], k) for k in kinds], names=names)


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", discount: float = DISCOUNT,
                    share: float = PAIR_SHARE, shard_bytes: int = SHARD_BYTES, order: int = 2, common: int = COMMON) -> DataFrame:
    """log10 probability of every whole text under a word n-gram model (n up to ``order``, 2 or more) learned from the rows where ``train`` is true.

    Tokens are words (A-Z lower-cased, cut at ASCII white space) and one end for each text; null is the empty text.
    Single words have (c + 0.5) / (N + 0.5 (V + 1)).  Pairs are smoothed by absolute discounting (``discount``) down
    to single words, longer n-grams in the same way down to the next shorter (to these alone where the context was not seen), and mixed with single words (``share``), so each context's probabilities sum to one.  Each token's weight against its single word
    is rounded to the steps of the trie (1 / 2048 in log10) before a document's sum, which is exact.  A row: the key, ``held_out``,
    ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (single words), ``score``.  Without training
    rows every probability is that of an unknown word.  Every input row is one row; other columns are not read.

    Pairs are dealt to shards by their context.  A context with more than a quarter of a shard is dealt over all of them by
    word (its totals come with the word counts).  In a shard the pairs that were seen become a trie of
    memory-mapped levels in the task's own folder, removed when done; all pairs of the shard are looked up there, and sums per block and
    document go on.  So corpus, counts and model stay distributed; the driver sees two totals, two for each hot word, and hashes
    and counts of ``common`` frequent words, which have numbers and move by them.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    with short_batches(docs.sparkSession, PACKED_ROWS):
        return materialise(_scored(docs, train, key, text, discount, share, shard_bytes, order, common))


def _scored(docs: DataFrame, train: Column, key: str, text: str, discount: float, share: float, shard_bytes: int, order: int, most: int) -> DataFrame:
    source = _source(docs, key, text, F.coalesce(train, F.lit(False)))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    shards = max(4, -(-size // shard_bytes))
    hot, common = frequent_words(source, shards, most)
    answers = materialise(count_grams(source, hot, common, shards, order))
    common_count = np.zeros(len(common), dtype=np.int64)
    for r in answers.filter("part = -3").select("w", "n").collect():
        common_count[np.frombuffer(r["w"], dtype=np.uint32)] = np.frombuffer(r["n"], dtype=np.int64)
    (v,), (n,) = _totals(answers, -1, 1)
    hot_count, hot_after = _totals(answers, -2, len(hot)) if len(hot) else (np.zeros(0, dtype=np.int64),) * 2
    smoothed = n + 0.5 * (v + 1)
    answers = answers.filter("part >= 0")
    pairs = pair_blocks(source, hot, common, common_count, shards, order)
    kind = docs.schema[key].dataType.simpleString()
    sums = pairs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        _shard(discount, share, smoothed, hot, hot_count, hot_after, common, common_count, order),
        f"block bigint, shard int, a binary, b binary, n binary, d binary, keys array<{kind}>")
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    tokens, base = int(n), float(np.log10(smoothed))

    def finish(rows: pa.Table) -> pa.Table:
        shard = np.array(rows.column("shard").to_pylist())
        order = np.argsort(shard, kind="stable")
        cols = {c: rows.column(c) for c in ("a", "b", "n", "d", "keys")}
        own = int(order[0])
        keys = cols["keys"][own].values
        size = len(keys)
        total = np.frombuffer(cols["d"][own].as_py(), dtype=np.int64)
        learned = np.unpackbits(np.frombuffer(cols["a"][own].as_py(), dtype=np.uint8), count=size).astype(bool)
        weight, single, known = np.zeros(size), np.frombuffer(cols["b"][own].as_py()).copy(), np.frombuffer(cols["n"][own].as_py(), dtype=np.int64).copy()
        for i in map(int, order[1:]):
            d = cols["d"][i].as_py()  # documents that have words in the shard: a bit each, or a list
            d = np.flatnonzero(np.unpackbits(np.frombuffer(d[1:], dtype=np.uint8))) if d[:1] == b"b" else np.frombuffer(d[1:], dtype=np.uint16)
            a, c = unsqueeze(cols["a"][i].as_py(), np.int64), unsqueeze(cols["b"][i].as_py(), np.int64)
            weight[d] += (a >> 1) ^ -(a & 1)
            d = np.repeat(d, unsqueeze(cols["n"][i].as_py(), np.uint32))
            single += np.bincount(d, weights=np.log10(c + 0.5), minlength=size)
            known += np.bincount(d[c > 0], minlength=size)
        weight /= STEP
        single -= total * base
        return pa.table([keys, pa.array(~learned), pa.array(total), pa.array(known), pa.array(np.full(size, tokens)),
                         pa.array(single), pa.array(single + weight)], names=names)
    return sums.groupBy("block").applyInArrow(
        finish, f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
