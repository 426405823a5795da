"""Hard negatives of anchors by slots between the positives' upper limits.

Each positive of an anchor asks for the best negatives in a window of scores below it.  The windows of one anchor
overlap; their upper limits cut the scores into disjoint slots.  The best few of each slot are enough: the
best below a limit are those of its slot and the slots under it, in descending order, and a window's lower limit
only takes off the end of that list.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BLOCK_BYTES = 32 << 20  # of vectors as doubles, on each side of a task
CELLS = 2_000_000  # scores that a task holds at once
EXACT = float(1 << 53)  # integers below are exact as doubles


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def _matrix(column: pa.ChunkedArray, width: int, scale: float) -> np.ndarray:
    """Scaled and floored vectors; shorter ones get zeros."""
    lists = column.combine_chunks()
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), width))
    out[np.arange(width) < lens[:, None]] = flat
    return out


def _side(rows: pa.Table, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(rows.column("v"), width, scale), rows.column("row").to_numpy()


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: as doubles while none can pass 2^53, else as Python's integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(b).T


def _longs(scores: np.ndarray) -> pa.Array:
    return pa.array([int(x) for x in scores], pa.int64())  # a score of more than 64 bits is an error


def _first(group: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the first ``n`` of their group; groups lie together."""
    at = np.arange(len(group))
    begin = np.ones(len(group), dtype=bool)
    begin[1:] = group[1:] != group[:-1]
    return at - np.maximum.accumulate(np.where(begin, at, 0)) < n


def _best(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``n`` greatest scores of each row, ties by column; -inf is no score."""
    m = scores.shape[1]
    keep = scores > -np.inf
    if m > n:
        keep &= scores >= np.partition(scores, m - n, axis=1)[:, m - n:m - n + 1]
    i, j = np.nonzero(keep)
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    some = _first(i, n)
    return i[some], j[some]


def _codes(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides as numbers."""
    both = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks], left.schema.field("label").type)
    codes = both.combine_chunks().dictionary_encode().indices.to_numpy()
    return codes[:left.num_rows], codes[left.num_rows:]


def _positives(width: int, scale: float, n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Task function: the best ``n`` rows of the same label for each anchor of a block among a block of rows."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("row", "ascending")])  # nulls are last
        (a, a_row), (b, b_row), (a_label, b_label) = _side(anchors, width, scale), _side(rows, width, scale), _codes(anchors, rows)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for label in np.unique(a_label):
            left, right = np.flatnonzero(a_label == label), np.flatnonzero(b_label == label)
            step = max(1, CELLS // max(1, len(right)))
            for k in range(0, len(left) if len(right) else 0, step):
                part = left[k:k + step]
                s = _products(a[part], b[right])
                s[a_row[part][:, None] == b_row[right]] = -np.inf
                i, j = _best(s, n)
                out.append((part[i], right[j], s[i, j]))
        i, j, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=int),) * 3
        return pa.table({"anchor": pa.array(a_row[i]), "row": pa.array(b_row[j]), "key": rows.column("key").take(pa.array(j)).combine_chunks(),
                         "score": _longs(s)})
    return run


def _slots(width: int, scale: float, n: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Task function: the best ``n`` rows of other labels for each anchor of a block and slot."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("row", "ascending")])
        (a, a_row), (b, _), (a_label, b_label) = _side(anchors, width, scale), _side(rows, width, scale), _codes(anchors, rows)
        asked = anchors.column("scores").to_pylist()
        out: list[tuple[np.ndarray, ...]] = []
        step = max(1, CELLS // max(1, len(b)))
        for k in range(0, len(a), step):
            products = _products(a[k:k + step], b)
            for i, s in enumerate(products, k):
                tops = sorted(high * p // 100 for p in asked[i])
                bottoms = [-(-low * p // 100) for p in asked[i]]
                if not tops:
                    continue
                j = np.flatnonzero((s <= tops[-1]) & (s >= min(bottoms)) & (b_label != a_label[i]))
                j = j[np.lexsort((j, -s[j]))]
                # positives are numbered from the greatest score; a slot has the number of the least limit above it
                slot = len(tops) - 1 - np.searchsorted(np.array(tops, dtype=s.dtype), s[j], side="left")
                some = _first(slot, n)
                out.append((np.full(some.sum(), i), j[some], slot[some], s[j[some]]))
        i, j, slot, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=int),) * 4
        return pa.table({"anchor": pa.array(a_row[i]), "slot": pa.array(slot, pa.int32()),
                         "key": rows.column("key").take(pa.array(j)).combine_chunks(), "score": _longs(s)})
    return run


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                        scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose
    scores lie from ``low`` to ``high`` percent of the positive's.

    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.  A score is the inner product
    of the vectors with each component scaled and floored; greater ones come first, ties by the smaller key.  Rows with a
    null label, a null vector, or a null, NaN or infinite component take no part.  Components that a shorter vector lacks are 0, so an empty one
    scores 0.  A window of a negative positive score is empty, that of 0 holds 0.  Rows count each: a copy of an
    anchor is another row, and an anchor of a repeated key is answered for each of its rows.  Null keys come last in ties.  Scores of
    more than 64 bits are an error.  Other columns are not read.

    Anchors and rows meet in a grid of blocks of bounded bytes, dealt by row number, so no label is a hot key.  A task keeps the best
    few rows of each anchor, then of each anchor and slot; only these move on.
    """
    kind = rows.schema[key].dataType.simpleString()
    table = materialise(rows.filter(F.col(label).isNotNull() & _usable(F.col(vector))).select(
        F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.monotonically_increasing_id().alias("row")))
    n, wide, asked = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if("is_anchor")).first()
    spark = rows.sparkSession
    across = max(-(-n * wide * 8 // BLOCK_BYTES), spark.sparkContext.defaultParallelism)  # blocks of rows
    down = max(-(-asked * wide * 8 // BLOCK_BYTES), 1)  # blocks of anchors

    def own(count: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def grid(anchors: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        left = anchors.withColumn("d", own(down, 1)).withColumn("a", every(across))
        right = table.select("row", "key", "label", "v").withColumn("a", own(across, 2)).withColumn("d", every(down))
        return left.groupBy("d", "a").cogroup(right.groupBy("d", "a")).applyInArrow(run, schema)

    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    anchors = table.filter("is_anchor").select("row", "label", "v", F.col("key").alias("anchor_id"))
    near = grid(anchors.drop("anchor_id"), _positives(wide, scale, positives), f"anchor bigint, row bigint, key {kind}, score bigint")
    near = near.withColumn("i", F.row_number().over(Window.partitionBy("anchor").orderBy(*order, "row"))).filter(F.col("i") <= positives)
    chosen = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("i", "key", "score"))).alias("chosen"))  # ``positives`` at most
    chosen = materialise(anchors.join(chosen, F.col("anchor") == F.col("row")).drop("anchor"))
    best = grid(chosen.select("row", "label", "v", F.col("chosen.score").alias("scores")),
                _slots(wide, scale, negatives, low, high), f"anchor bigint, slot int, key {kind}, score bigint")
    best = best.withColumn("i", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*order))).filter(F.col("i") <= negatives)
    best = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "i", "key", "score"))).alias("best"))
    windows = chosen.select("row", "anchor_id", F.posexplode("chosen").alias("p", "positive")).join(best, F.col("anchor") == F.col("row"))
    # slots below a limit, in descending order, are one sorted list: its first rows answer the window
    below = F.slice(F.filter("best", lambda x: x["slot"] >= F.col("p")), 1, negatives)
    positive = F.col("positive.score").cast("decimal(19,0)")  # products of percentages stay exact
    found = windows.select("anchor_id", "positive", F.posexplode(F.filter(
        below, lambda x: positive * F.lit(low) <= x["score"].cast("decimal(19,0)") * F.lit(100))).alias("at", "negative"))
    return found.select("anchor_id", F.col("positive.key").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
                        F.col("negative.key").alias("negative_id"), F.col("positive.score").alias("positive_score"),
                        F.col("negative.score").alias("negative_score"))
