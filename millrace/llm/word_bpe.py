"""BPE encoding and decoding with word ends, by dynamic programming over prefixes.

The encoding of a text's prefix has one last token only.  It is a token that ends there, found by an automaton of all
tokens, and that may follow the last token of the shorter prefix: no merge across the border would have come before
those inside the two.  Storing one token for each prefix is enough; following them back gives the ids.  The work grows
with the length of a word, not with its square.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import parts, ranges
from .word_encoder import SliceIds, Slices

WORD_END = 0x1000  # added to the code point of a word's last symbol
PAIRS = 1_000_000  # tested pairs that a worker remembers; beyond, it starts anew
PIECES = 500_000  # pieces whose ids a worker remembers; beyond, it starts anew
SHIFT = 32  # of the first token in a pair's number

# what ``PLAIN`` makes of a lower-cased slice of printable ASCII, one byte a symbol
ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class PrefixBpe:
    """Ids of one word's symbols by a list of merges in their order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        import ahocorasick
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}  # rank of the merge that makes a token; none for a symbol
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        made = set()
        for i, (a, b) in enumerate(merges):
            t = vocab[a + b]
            if t in made:
                raise ValueError(f"two merges make the token {a + b!r}")
            made.add(t)
            self.rank[vocab[a], vocab[b]] = i
            self.born[t], self.left[t], self.right[t] = i, vocab[a], vocab[b]
        symbols: dict[int, str] = {}
        for s, t in vocab.items():
            if t not in made:
                ends = len(s) > 1 and s.endswith(suffix)
                body = s.removesuffix(suffix) if ends else s
                if len(body) != 1:
                    raise ValueError(f"{s!r} is neither a symbol nor made by a merge")
                symbols[t] = chr(ord(body) + WORD_END) if ends else body
                self.born[t] = -1
        self.known: dict[int, bool] = {}
        self.whole: dict[str, int] = {}  # tokens by their text
        self.automaton = ahocorasick.Automaton()
        text = dict(symbols)
        for t in sorted(made, key=self.born.__getitem__):
            text[t] = text[self.left[t]] + text[self.right[t]]
        for t, s in text.items():
            # a token that its own text does not merge to is never used
            if t in symbols or self._free(self.left[t], self.right[t], self.born[t]):
                self.automaton.add_word(s, (t, len(s)))
                self.whole[s] = t
        self.automaton.make_automaton()

    def _free(self, a: int, b: int, before: float = math.inf) -> bool:
        """Whether no merge across the border between two tokens comes before those inside them (and ``before``)."""
        x, y, until_x, until_y = a, b, before, before
        if before < math.inf:  # the pair's own merge is the one that makes the token
            pair = None
        else:
            pair = self.rank.get((x, y))
        while True:
            # a tie goes to the left: with the merge that takes x first, with the one that takes y after it
            if pair is not None and pair < until_x and pair <= until_y:
                return False
            if self.born[x] > self.born[y]:
                until_x, x = self.born[x], self.right[x]
            elif self.born[y] >= 0:
                until_y, y = self.born[y], self.left[y]
            else:
                return True
            pair = self.rank.get((x, y))

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of two tokens is encoded as these two."""
        got = self.known.get(a << SHIFT | b)
        if got is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            got = self.known[a << SHIFT | b] = self._free(a, b)
        return got

    def encode(self, word: str) -> list[int]:
        """Ids of a word whose last symbol has ``WORD_END`` added."""
        token = self.whole.get(word)
        if token is not None:  # the longest token that ends at the last symbol is the first one tested there
            return [token]
        last: list[int] = []  # last token of each prefix
        size: list[int] = []
        done, known = 0, self.known.get
        for end, (t, n) in self.automaton.iter(word):
            if end < done:
                continue  # the prefix has its token
            if n <= end:
                fits = known(last[end - n] << SHIFT | t)
                if not (self.compatible(last[end - n], t) if fits is None else fits):
                    continue
            last.append(t)
            size.append(n)
            done += 1
        if done < len(word):
            raise ValueError(f"no token ends at symbol {done} of {word[:100]!r}")
        out, at = [], done - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]


class WordBpe:
    """Encoder and decoder by a ``tokenizers`` file of a BPE model with word ends and without a decoder.

    The file's own normaliser and splitter cut texts to words, each distinct slice between white space once (slices of printable
    ASCII are cut by a regular expression where the file has the normaliser and splitter of ``PLAIN``); special tokens are found in raw text.  Merging is ``PrefixBpe``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        tokenizer = Tokenizer.from_file(path)
        if tokenizer.decoder is not None or not model["end_of_word_suffix"]:
            raise ValueError("the file must have a suffix of word ends and no decoder")
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = {c.encode(): i for c, i in added.items()}
        self.marks = re.compile(b"(" + b"|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True)) + b")")
        self.bpe = PrefixBpe(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.tokens = {i: s.encode() for s, i in (model["vocab"] | added).items()}
        self.pieces: dict[str, list[int]] = {}
        self.slices, self.cache = Slices(file, list(self.special)), SliceIds()

    def _words(self, raw: bytes) -> list[str]:
        """The words of a slice without special tokens."""
        if self.slices.plain and raw.isascii():
            text = raw.decode()
            if text.isprintable():
                return ASCII_PIECES.findall(text.lower())
        return [word for word, _ in self.split(self.normalise(raw.decode("utf-8", "replace")))]

    def _slice(self, raw: bytes) -> list[int]:
        out: list[int] = []
        for i, piece in enumerate(self.marks.split(raw) if self.special else [raw]):
            if i % 2:
                out.append(self.special[piece])
            elif piece:
                for word in self._words(piece):
                    ids = self.pieces.get(word)
                    if ids is None:
                        if len(self.pieces) >= PIECES:
                            self.pieces.clear()
                        ids = self.pieces[word] = self.bpe.encode(word[:-1] + chr(ord(word[-1]) + WORD_END))
                    out.extend(ids)
        return out

    def encode(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First text, its and the following texts' ids, and where each text's ids begin (with the end)."""
        for i, j, buf, offsets in parts(texts):
            buf, starts, ends, doc = self.slices.of(buf, offsets)
            codes, distinct = pd.factorize(self.slices.texts.hashes(buf, starts, ends))
            new = np.flatnonzero(self.cache.missing(distinct))
            if len(new):
                first = np.empty(len(distinct), dtype=np.int64)
                first[codes[::-1]] = np.arange(len(codes))[::-1]
                self.cache.add_lists(distinct[new], [self._slice(buf[starts[k]:ends[k]].tobytes()) for k in first[new]])
            rows = self.cache.rows_of(distinct)[codes] if len(codes) else codes
            lens = self.cache.lens[rows]
            upto = np.zeros(j - i + 1, dtype=np.int64)
            np.cumsum(np.bincount(doc, weights=lens, minlength=j - i).astype(np.int64), out=upto[1:])
            yield i, self.cache.flat[ranges(self.cache.starts[rows], lens)], upto

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens with a space between them, special ones too, as a library without a decoder gives them."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


_OF_WORKER: dict[str, WordBpe] = {}


def worker_bpe(path: str) -> WordBpe:
    """The encoder that this Python worker has for ``path``: its automaton is built once, and what it remembers serves later tasks.
    A worker keeps one encoder."""
    if path not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[path] = WordBpe(path)
    return _OF_WORKER[path]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of each row.

    ``path``: a ``tokenizers`` file of a BPE model with word ends, present on every machine.  Null and empty texts have no
    ids, nor have texts of white space.  Repeated rows and null keys are kept as they are; other columns are not read.  A very long
    text is worked on whole by one task, in memory that grows with its size; words may be of any length."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for b in batches:
            for i, ids, upto in bpe.encode(b.column("_text").to_pylist()):
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("_key").slice(i, len(lists)), lists], names=["_key", "ids"])
    return _rows(docs, key, text).mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of each row of ids; null ids give a null text, none an empty one."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for b in batches:
            texts = [None if x is None else bpe.decode(np.array(x, dtype=np.int64)).decode() for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(texts, pa.string())], names=["_key", "text"])
    rows = encoded.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    return rows.mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)


def word_bpe_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text: ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256``.  Input is treated as in ``encode_documents``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for b in batches:
            for i, ids, upto in bpe.encode(b.column("_text").to_pylist()):
                n, sha, back = [], [], []
                for a, z in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    own = ids[a:z]
                    n.append(z - a)
                    sha.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column("_key").slice(i, len(n)), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                    names=["_key", "n_tokens", "ids_sha256", "decoded_sha256"])
    out = _rows(docs, key, text).mapInArrow(run, f"_key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_key", key)
