"""Token ids of whole texts by a ``tokenizers`` file, one call for each distinct word.

For vocabularies whose normaliser and splitter never look across ASCII white space (as those with word
ends): the ids of a text are then the ids of its words, one after the other.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd

from .text import Texts, parts, ranges

MARK = "\x01"
# A normaliser and splitter that lower-case letters and always cut between a letter and what is none.
PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
KNOWN = 1_000_000  # slices whose ids a task remembers; beyond, it starts anew


class SliceIds:
    """Ids of slices by the slices' hashes."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # sorted
        self.rows = np.zeros(0, dtype=np.int64)
        self.lens = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the (distinct) hashes have no ids yet."""
        if len(self.hashes) + len(hashes) > KNOWN:
            self.forget()
        at = np.searchsorted(self.hashes, hashes)
        if len(self.hashes) == 0:
            return np.ones(len(hashes), dtype=bool)
        return self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes

    def add(self, hashes: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> None:
        """Ids of new hashes, one after the other."""
        starts = len(self.flat) + np.cumsum(lens) - lens
        rows = len(self.lens) + np.arange(len(lens))
        self.lens, self.starts = np.concatenate([self.lens, lens]), np.concatenate([self.starts, starts])
        self.flat = np.concatenate([self.flat, flat])
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.rows = np.insert(self.hashes, at, hashes[order]), np.insert(self.rows, at, rows[order])

    def add_lists(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.add(hashes, lens, np.fromiter((x for one in ids for x in one), dtype=np.int32, count=int(lens.sum())))

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        return self.rows[np.searchsorted(self.hashes, hashes)]


class Slices:
    """Cuts texts at ASCII white space, and where a file allows it at more places, so that fewer slices are distinct."""

    def __init__(self, file: dict, special: list[bytes]) -> None:
        self.plain, self.special, self.texts = all(file[k] == v for k, v in PLAIN.items()), special, Texts()
        self.letter, self.sign = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self.sign[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

    def of(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes and the start, end and text number of slices whose ids follow each other.

        With ``PLAIN`` slices are cut before an ASCII sign that follows an ASCII letter, and A-Z are lower-cased.  A letter before a byte that
        is not ASCII stays as it is, as a combining mark may be joined with it first.  Special tokens are looked for in whole raw text, so
        bytes that hold one, lower-cased or not, are cut at white space only."""
        if self.plain and len(buf):
            folded = np.where(np.append(buf[1:], np.uint8(0)) < 128, self.texts.fold[buf], buf)
            whole = folded.tobytes()
            if not any(c in whole for c in self.special):
                edge = np.zeros(len(buf), dtype=bool)
                edge[1:] = self.letter[buf[:-1]] & self.sign[buf[1:]]
                return folded, *self.texts.words(folded, offsets, edge)
        return buf, *self.texts.words(buf, offsets)


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
        own = self.tokenizer.encode(f"a\n{MARK}\na", add_special_tokens=False).ids
        alone = self.tokenizer.encode("a", add_special_tokens=False).ids
        self.mark = own[1] if len(own) == 3 and [own[0], own[2]] == alone * 2 else None
        with open(path, encoding="utf-8") as f:
            self.slices = Slices(json.load(f), [c.encode() for c in self.special])
        self.cache = SliceIds()

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """One call for all words with a mark between them, as long as none of them holds one.  The control character ``MARK`` between line
        breaks, where it is one token, costs less than a special token, at which the library cuts its text."""
        text = b"\n".join(words)  # no word holds a line break
        if not any(c.encode() in text for c in self.special):
            marks = [(c, i) for c, i in list(self.special.items())[:1]]
            if self.mark is not None and MARK.encode() not in text:
                marks.insert(0, (f"\n{MARK}\n", self.mark))
            for content, mark in marks:
                joined = text.decode("utf-8", "replace").replace("\n", content)
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int32)
                cut = ids == mark
                if cut.sum() == len(words) - 1:
                    lens = np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(ids)]])) - 1
                    self.cache.add(hashes, lens, ids[~cut])
                    return
        encoded = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        self.cache.add_lists(hashes, [e.ids for e in encoded])

    def encode(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First text, its and the following texts' ids, and where each text's ids begin (with the end)."""
        for i, j, buf, offsets in parts(texts):
            buf, starts, ends, doc = self.slices.of(buf, offsets)
            codes, distinct = pd.factorize(self.slices.texts.hashes(buf, starts, ends))
            new = np.flatnonzero(self.cache.missing(distinct))
            if len(new):
                first = np.empty(len(distinct), dtype=np.int64)
                first[codes[::-1]] = np.arange(len(codes))[::-1]
                whole = buf.tobytes()
                self._learn(distinct[new], [whole[starts[k]:ends[k]] for k in first[new]])
            rows = self.cache.rows_of(distinct)[codes] if len(codes) else codes
            lens = self.cache.lens[rows]
            upto = np.zeros(j - i + 1, dtype=np.int64)
            np.cumsum(np.bincount(doc, weights=lens, minlength=j - i).astype(np.int64), out=upto[1:])
            yield i, self.cache.flat[ranges(self.cache.starts[rows], lens)], upto


_OF_WORKER: dict[str, WordEncoder] = {}


def worker_encoder(path: str) -> WordEncoder:
    """The encoder that this Python worker has for ``path``, so that words learned in one task (``KNOWN`` at most) serve the worker's later
    tasks.  A worker keeps one encoder; a lost worker costs its words' ids, nothing else."""
    if path not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[path] = WordEncoder(path)
    return _OF_WORKER[path]
