"""Text as arrays: A-Z lower-casing, words and hashes of byte slices.

The column form (``lower_az``) runs in the JVM.  The numpy forms work on the
bytes of many texts at once, inside tasks.
"""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WINDOW = 1 << 20  # bytes that are hashed at once
SHORT = 32  # bytes of slices that are hashed place by place, many at once
RUN = 1 << 15  # slices that are hashed at once
BATCH = 4 << 20  # bytes of text that are worked on at once
ROWS = 250  # whole texts that go to a Python worker at once where memory counts
ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def short_batches(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """Send fewer rows at once to Python workers in the jobs that run inside: texts are long, and buffers hold whole batches."""
    before = spark.conf.get(ROWS_KEY)
    spark.conf.set(ROWS_KEY, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_KEY, before)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task function, giving freed memory back to the system when it ends: Python workers live on for later tasks, and
    would hold what the largest of them needed."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return task


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Texts:
    """Byte texts of one batch, one after the other."""

    def __init__(self) -> None:
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.gap = np.zeros(256, dtype=bool)
        self.gap[[32, 9, 10, 11, 12, 13]] = True
        # one random number for each place (mod 256) and byte: equal sums of 64 bits mean equal slices
        self.table = np.random.PCG64(20).random_raw(256 * 256).astype(np.uint64)

    def words(self, buf: np.ndarray, offsets: np.ndarray, edge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each run of bytes that are not ASCII white space; ``edge``: bytes that begin a new run."""
        n = len(buf)
        if n == 0:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        gap = self.gap[buf]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        cut[0] = cut[n] = True
        if edge is not None:
            cut[:n] |= edge
        before, after = cut[:n].copy(), cut[1:].copy()
        before[1:] |= gap[:-1]
        after[:-1] |= gap[1:]
        gap = ~gap
        starts, ends = np.flatnonzero(gap & before), np.flatnonzero(gap & after) + 1
        return starts, ends, np.searchsorted(offsets[1:], starts, side="right")

    def hashes(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each slice (none of them empty)."""
        lens = ends - starts
        out = np.empty(len(starts), dtype=np.uint64)
        table = self.table.reshape(256, 256)
        for i in range(0, len(starts), RUN):
            ln = lens[i:i + RUN]
            short = np.minimum(ln, SHORT + 1).astype(np.uint8)
            by = np.argsort(short, kind="stable")[::-1]  # the longest first: at each place, the slices that reach it are the first ones
            reach = len(short) - np.cumsum(np.bincount(short, minlength=SHORT + 2))
            at, v = starts[i:i + RUN][by], np.zeros(len(short), dtype=np.uint64)
            for place, n in enumerate(reach[:SHORT].tolist()):
                if not n:
                    break
                v[:n] += table[place][buf[at[:n]]]
                at[:n] += 1
            out[i:i + RUN][by] = mix64(v + ln[by].astype(np.uint64))
        long = np.flatnonzero(lens > SHORT)
        if len(long):
            out[long] = self._long(buf, starts[long], ends[long])
        return out

    def _long(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same for slices of any length."""
        lens = ends - starts
        out = np.empty(len(starts), dtype=np.uint64)
        upto = np.concatenate([[0], np.cumsum(lens)])
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + WINDOW, side="right")) - 1)
            ln, first = lens[i:j], upto[i:j] - upto[i]
            pos = np.arange(upto[j] - upto[i]) - np.repeat(first, ln)
            v = self.table[((pos & 255) << 8) | buf[pos + np.repeat(starts[i:j], ln)]]
            if ln.max() > 256:
                v = v * (((pos >> 8) << 1) | 1).astype(np.uint64)
            out[i:j] = mix64(np.add.reduceat(v, first) + ln.astype(np.uint64))
            i = j
        return out


def parts(texts: list[bytes | None], most: int = BATCH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a list of texts into runs of about ``most`` bytes: first, last + 1, bytes, offsets.
    A null is an empty text."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= most):
            size += len(texts[j] or b"")
            j += 1
        run = [t or b"" for t in texts[i:j]]
        offsets = np.zeros(len(run) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in run], out=offsets[1:])
        yield i, j, np.frombuffer(b"".join(run), dtype=np.uint8), offsets
        i = j


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, one after the other."""
    total = int(lens.sum())
    shift = starts - np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else starts
    return np.repeat(shift, lens) + np.arange(total)
