"""Languages of texts: scripts narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import LETTER, class_table
from .text import Texts, mix64, parts, released

BUCKETS = 1 << 16  # hashed letter n-grams; the model has one number for each and language
ORDERS = 3  # n-grams of 1 to 3 letters, word ends included
SMOOTH = 0.5  # added to each count
SWITCH = 8.0  # cost of another language than the word before
SHARE = 0.01  # a language is a candidate for a script with this share of its letters
FAR = -30.0  # score of a word in a language that is no candidate

# First code points of the blocks of scripts, up to the next entry.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
           (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"),
           (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
           (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"),
           (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
           (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0x10000, "other"),
           (0x20000, "han"), (0x40000, "other")]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


class WordGrams:
    """Letters, script and hashed n-grams of words."""

    def __init__(self) -> None:
        self.letters = class_table() == LETTER
        self.script = np.zeros(0x110000, dtype=np.int8)
        for start, name in SCRIPTS:
            self.script[start:] = SCRIPT_NAMES.index(name)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Letters and script (of the first letter; -1: none) of each word; bucket and word number of each n-gram.
        Other characters than letters are left out."""
        text = b"\n".join(words).decode("utf-8", "replace").lower()
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        line = points == 10  # no word holds a line break
        word = np.cumsum(line)
        letter = self.letters[points]
        count = np.bincount(word[letter], minlength=len(words))
        script = np.full(len(words), -1, dtype=np.int8)
        at = np.flatnonzero(letter)[::-1]
        script[word[at]] = self.script[points[at]]
        keep = letter | line
        c = np.concatenate([[10], points[keep], [10]]).astype(np.uint64)
        w = np.concatenate([[0], word[keep], [len(words) - 1]])
        inner = c != 10
        buckets, owners = [], []
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, ORDERS + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + c[n - 1:] + np.uint64(n)
            ok = np.ones(m, dtype=bool)
            for k in range(1, n - 1):
                ok &= inner[k:k + m]
            if n == 1:
                ok, own = inner, w
            else:
                own = np.where(inner[:m], w[:m], w[n - 1:])  # the side that has letters
                ok &= inner[:m] | inner[n - 1:]
            buckets.append((mix64(h[ok]) >> np.uint64(48)).astype(np.int64))
            owners.append(own[ok])
        return count, script, np.concatenate(buckets), np.concatenate(owners)


def _words(texts: Texts, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Text number and code of each word; the distinct words."""
    starts, ends, doc = texts.words(buf, offsets)
    codes, distinct = pd.factorize(texts.hashes(buf, starts, ends))
    first = np.empty(len(distinct), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    whole = buf.tobytes()
    return doc, codes, [whole[starts[k]:ends[k]] for k in first]


@dataclass
class LanguageModel:
    """Log-probabilities of n-grams, and candidates by script (one more row: no script)."""

    languages: list[str]
    grams: np.ndarray  # [bucket, language]
    candidates: np.ndarray  # [script, language]


def train_languages(labelled: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """Learn from all rows whose language is not null.  N-grams are counted in the tasks, at most ``BUCKETS`` numbers
    for each language and task, and summed; the driver gets the sums."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, grams = Texts(), WordGrams()
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column("_lang").to_pylist(), dtype=object)
            for i, j, buf, offsets in parts(b.column("_text").to_pylist()):
                doc, codes, words = _words(texts, buf, offsets)
                if not len(words):
                    continue
                letters, script, bucket, owner = grams.of(words)
                names, of_doc = np.unique(langs[i:j].astype(str), return_inverse=True)
                of_word = of_doc[doc]
                for k, name in enumerate(names):
                    n = np.bincount(codes[of_word == k], minlength=len(words))
                    own = sums.setdefault(str(name), np.zeros(BUCKETS + len(SCRIPT_NAMES)))
                    own[:BUCKETS] += np.bincount(bucket, weights=n[owner], minlength=BUCKETS)
                    has = script >= 0
                    own[BUCKETS:] += np.bincount(script[has], weights=(n * letters)[has], minlength=len(SCRIPT_NAMES))
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(own[at].astype(np.int64))], names=["lang", "bucket", "n"])
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).cast("binary").alias("_text")) \
        .mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    table = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)))
    for k, name in enumerate(languages):
        own = rows[rows["lang"] == name]
        table[k, own["bucket"]] = own["n"]
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    logp = np.log((grams + SMOOTH) / (grams.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)) if languages else grams
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    candidates = np.vstack([(share >= SHARE).T, np.ones((1, len(languages)), dtype=bool)])
    return LanguageModel(languages, logp.T.astype(np.float32), candidates)


def word_scores(model: LanguageModel, grams: WordGrams, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each word in each language (0 for the best one), its letters, and whether no language was learned with its script."""
    letters, script, bucket, owner = grams.of(words)
    k = len(model.languages)
    score = np.empty((len(words), k))
    for i in range(k):
        score[:, i] = np.bincount(owner, weights=model.grams[bucket, i], minlength=len(words)) / ORDERS
    able = model.candidates[script]
    able[~able.any(axis=1)] = True
    score = np.where(able, score, -np.inf)
    score -= score.max(axis=1, keepdims=True)
    unknown = (script >= 0) & ~model.candidates[script].any(axis=1)
    score[unknown] = 0.0  # a script that no language was learned with tells nothing
    return np.maximum(score, FAR), letters, unknown


def viterbi(scores: np.ndarray, rows: np.ndarray, lens: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word on the best path of each text.  ``rows``: the score row of each word, ``lens``: words of
    each text.  All texts advance together, one word at a time."""
    k = scores.shape[1]
    order = np.argsort(-lens, kind="stable")
    first = (np.cumsum(lens) - lens)[order]
    steps = int(lens.max()) if len(lens) else 0
    active = np.searchsorted(-lens[order], -np.arange(1, steps + 1), side="right")
    best = np.zeros(len(rows), dtype=np.int16)
    stay = np.ones((len(rows), k), dtype=bool)
    v = np.zeros((len(lens), k))
    for t in range(steps):
        m = active[t]
        at = first[:m] + t
        if t:
            b = v[:m].argmax(axis=1)
            floor = v[np.arange(m), b] - switch
            best[at] = b
            keep = v[:m] >= floor[:, None]
            stay[at] = keep
            v[:m] = np.where(keep, v[:m], floor[:, None]) + scores[rows[at]]
        else:
            v[:m] = scores[rows[at]]
    label = np.zeros(len(rows), dtype=np.int16)
    now = v.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        label[at] = now[:m]
        if t:
            now[:m] = np.where(stay[at, now[:m]], now[:m], best[at])
    return label


def identify_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """Language of every whole text: the key, ``lang_pred``, ``score`` and, on request, ``spans``.

    Words are scored in each candidate language by their letter n-grams; the best path with ``SWITCH`` for each
    change labels them.  ``lang_pred`` has most letters (the first name on a tie), ``score`` is its share of all
    letters, each counted by the probability of the language given its word alone; it is 0 where most letters are of scripts that no language was learned with.  ``und`` with score 0 stands for null, for a text without a letter, and
    for all texts if nothing was learned.  ``spans`` are (first word, words, language), in order.  Every row is
    one row; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "lang_pred", "score"] + ["spans"] * spans
    span_type = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for b in batches:
            lang, score, found = judge.languages(b.column("_text").to_pylist(), spans)
            cols = [b.column("_key"), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(found, span_type)] * spans, names=names)
    more = ", spans array<struct<first_word:bigint,words:bigint,lang:string>>" if spans else ""
    return docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text")) \
        .mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double{more}")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for b in batches:
            lang, score, _ = judge.languages(b.column(text).cast(pa.binary()).to_pylist(), False)
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))
    return docs.mapInArrow(released(run), docs.schema)


class Judge:
    """Languages of lists of texts."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.texts, self.grams = model, Texts(), WordGrams()

    def languages(self, texts: list[bytes | None], spans: bool) -> tuple[list[str], list[float], list[list[dict]]]:
        model, k = self.model, len(self.model.languages)
        lang: list[str] = []
        score: list[float] = []
        found: list[list[dict]] = []
        for i, j, buf, offsets in parts(texts):
            doc, codes, words = _words(self.texts, buf, offsets)
            if not k or not words:
                lang += ["und"] * (j - i)
                score += [0.0] * (j - i)
                found += [[]] * (j - i)
                continue
            scores, letters, unknown = word_scores(model, self.grams, words)
            lens = np.bincount(doc, minlength=j - i)
            label = viterbi(scores, codes, lens)
            each = np.zeros((j - i, k))
            np.add.at(each, (doc, label), letters[codes])
            total = each.sum(axis=1)
            pick = each.argmax(axis=1)
            weight = np.exp(scores)
            weight /= weight.sum(axis=1, keepdims=True)
            sure = np.bincount(doc, weights=np.where(label == pick[doc], letters[codes] * weight[codes, label], 0.0), minlength=j - i)
            foreign = np.bincount(doc, weights=(letters * unknown)[codes], minlength=j - i)
            value = np.where(2 * foreign > total, 0.0, np.minimum(sure / np.maximum(total, 1), 1.0))
            lang += [model.languages[p] if t else "und" for p, t in zip(pick, total, strict=True)]
            score += value.tolist()
            if spans:
                found += _spans(label, lens, model.languages)
        return lang, score, found


def _spans(label: np.ndarray, lens: np.ndarray, languages: list[str]) -> list[list[dict]]:
    out, at = [], 0
    for n in lens:
        own = label[at:at + n]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [n]]) if n else np.zeros(1, dtype=np.int64)
        out.append([{"first_word": int(a), "words": int(z - a), "lang": languages[own[a]]} for a, z in zip(cut[:-1], cut[1:], strict=True)])
        at += n
    return out


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; 0 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(of), F.lit(0))
