"""Best-fit packing of token sequences by bin completion over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .text import released
from .word_encoder import worker_encoder

WIDTH = 3  # fillings tried at a node
NODES = 20_000  # nodes of the search; after these the best packing found stands


def fillings(counts: np.ndarray, room: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with up to four of the lengths left, the fullest first and, among those, the ones with
    fewest and longest parts.  A part that fits exactly dominates all others."""
    top = min(room, len(counts) - 1)
    if top <= 0:
        return [()]
    if room < len(counts) and counts[room]:
        return [(room,)]
    have = counts > 0
    lengths = np.flatnonzero(have[:top + 1])[::-1]
    if not len(lengths):
        return [()]
    found: list[tuple[int, ...]] = []

    def pairs(space: int, most: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """The exact pair of ``space`` with the longest first part, no longer than ``most``."""
        a = np.arange(min(most, space - 1), (space + 1) // 2 - 1, -1)
        if not len(a):
            return None
        for x in a[have[a] & have[space - a]][:4]:
            need = [*taken, int(x), int(space - x)]
            if all(counts[v] >= need.count(v) for v in set(need)):
                return int(x), int(space - x)
        return None

    two = pairs(room, top, ())
    if two:
        found.append(two)
    for first in lengths[:256]:
        if len(found) >= width:
            return found
        rest = pairs(room - int(first), int(first), (int(first),))
        if rest:
            found.append((int(first), *rest))
    for first in lengths[:16]:
        for second in lengths[lengths <= min(first, room - first)][:16]:
            if len(found) >= width:
                return found
            if counts[first] < 1 + (first == second):
                continue
            rest = pairs(room - int(first) - int(second), int(second), (int(first), int(second)))
            if rest:
                found.append((int(first), int(second), *rest))
    # not exact: always the longest part that fits
    for first in lengths[:width]:
        parts, space, left = [], room, {}
        at = int(first)
        while at > 0:
            parts.append(at)
            left[at] = left.get(at, int(counts[at])) - 1
            space -= at
            fit = np.flatnonzero(have[:space + 1])
            fit = [int(x) for x in fit[::-1][:len(parts) + 1] if left.get(int(x), 1) > 0]
            at = fit[0] if fit else 0
        if tuple(parts) not in found:
            found.append(tuple(parts))
    return sorted(found, key=lambda p: (room - sum(p), len(p)))[:width]


def complete_bins(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, so that all lengths are placed in few bins.

    Depth first: a node fills the bin of the longest length left and repeats the filling as often as the
    counts allow, so a search path ends one length at each step however many documents there are.  The
    first descent takes the best fit each time and is the first incumbent; other fillings are tried while
    the waste so far leaves room for a packing with fewer bins than the incumbent."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    total = int((counts * np.arange(capacity + 1)).sum())
    least = max(-(-total // capacity), int(counts[capacity // 2 + 1:].sum()))
    best: list[tuple[tuple[int, ...], int]] | None = None
    best_bins = 0
    # a node: counts, bins and waste so far, path (linked), the filling to apply
    stack: list[tuple] = [(counts, 0, 0, None, None)]
    while stack and nodes:
        nodes -= 1
        left, bins, waste, path, use = stack.pop()
        if use is not None:
            left = left.copy()
            need = {v: use.count(v) for v in set(use)}
            times = min(int(left[v]) // k for v, k in need.items())
            for v, k in need.items():
                left[v] -= k * times
            bins, waste, path = bins + times, waste + times * (capacity - sum(use)), (path, use, times)
        if best is not None and waste > (best_bins - 1) * capacity - total:
            continue
        some = np.flatnonzero(left)
        if not len(some):
            if best is None or bins < best_bins:
                best, best_bins, at = [], bins, path
                while at is not None:
                    best.append(at[1:])
                    at = at[0]
                if bins <= least:
                    break
            continue
        longest = int(some[-1])
        left[longest] -= 1
        options = fillings(left, capacity - longest)
        left[longest] += 1
        for f in reversed(options if best is not None or len(options) < 2 else options):
            stack.append((left, bins, waste, path, (longest, *f)))
        if best is None and nodes <= 1:
            nodes = 1  # an incumbent is always reached
            stack = stack[-1:]
    return best[::-1] if best else []


def packing_slots(fill: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where the documents of each length go: those ranked ``rank`` to the next row's lie ``each`` to a
    sequence, from sequence ``base`` on, the first at ``offset``."""
    rows, used, base = [], {}, 0
    for parts, times in fill:
        at = 0
        for length in sorted(set(parts), reverse=True):
            k = parts.count(length)
            rows.append((length, used.get(length, 0), k, base, at))
            used[length] = used.get(length, 0) + k * times
            at += k * length
        base += times
    return pd.DataFrame(rows, columns=["length", "rank", "each", "base", "offset"]).astype("int64") \
        .sort_values(["length", "rank"], ignore_index=True)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document (its ids, then ``end_id``), with the task (``_task``)
    and the piece's rank among those of its length there (``_local``)."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32", "_task", "_local"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = worker_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            where, piece, start, length, crc, local = [], [], [], [], [], []
            for first, ids, upto in encoder.encode(b.column("_text").to_pylist()):
                ids = ids.astype("<u4")
                tail = np.array([end_id], dtype="<u4")
                for d in range(len(upto) - 1):
                    own = np.concatenate([ids[upto[d]:upto[d + 1]], tail])
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s:s + capacity]
                        where.append(first + d)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        local.append(seen[len(part)])
                        seen[len(part)] += 1
            n = len(where)
            yield pa.RecordBatch.from_arrays(
                [b.column("_key").take(pa.array(where, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(n, task), pa.int32()),
                 pa.array(local, pa.int64())], names=names)
    return docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text")).mapInArrow(
        released(cut), f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _task int, _local bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    A document is its ids and ``end_id`` (a null or empty text: that id alone).  Only longer ones are cut.
    Rows are pieces: the key, piece, start, length, ``ids_crc32``, ``sequence_id``, ``offset``.  Every input row is
    packed, repeated ones too; other columns are not read; an empty table has no rows.

    Which lengths share a sequence is found from the histogram of lengths (``capacity`` rows at most) by bin
    completion (``complete_bins``).  Pieces are written once; their ranks within a length come from counts
    per task, so no task or group holds a length, however common.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, capacity, end_id, key, text))
    counts = materialise(pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = packing_slots(complete_bins(histogram, capacity))  # bounded by the capacity, not by the documents
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # the list of counts grows with the tasks, so it is never broadcast
    ranked = pieces.join(starts.hint("merge"), ["length", "_task"]).select(
        key, "piece", "start", "length", "ids_crc32", (F.col("_start") + F.col("_local")).alias("_rank"))
    lengths, ranks = slots["length"].to_numpy(), slots["rank"].to_numpy()
    each, base, offset = (slots[c].to_numpy() for c in ("each", "base", "offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(lengths, np.arange(capacity + 2))
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            row = np.zeros(len(length), dtype=np.int64)
            for v in np.unique(length):
                mine = length == v
                row[mine] = first[v] + np.searchsorted(ranks[first[v]:first[v + 1]], rank[mine], side="right") - 1
            i = rank - ranks[row] if len(row) else rank
            cols = [b.column(c) for c in (key, "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(base[row] + i // each[row], pa.int64()), pa.array(offset[row] + i % each[row] * length, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    kind = docs.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                    "sequence_id bigint, offset bigint")
