"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

RUN = 4096  # rows of a shard that one window numbers, on average


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins the key: the least of -ln(u) / weight, where u in (0, 1)
    is the hash of key and shard.  Each shard wins in proportion to its weight, and one more
    shard takes keys only into itself.  Weights must be positive.  A null key is a key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    def entry(s: int, w: float) -> Column:
        top = F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11).cast("double")  # 53 bits
        return F.struct((-F.log((top + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(w))).alias("cost"),
                        F.lit(s).alias("shard"))
    entries = [entry(s, w) for s, w in enumerate(weights)]
    return (F.least(*entries) if len(entries) > 1 else entries[0])["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, key: str = "doc_id",
                    text: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """Shard and gapless slot of every row.

    Rows are the key, size (UTF-8 bytes of the text + 1; null text: 1), ``text_crc32`` (of the
    empty text where it is null), shard, slot and ``grown_shard``, the shard after one more of
    weight ``grown_weight`` is added.  The shard depends on the key alone: equal keys and all
    null keys share one.  Slots run from 0 in each shard.  They are numbered in runs of about
    ``RUN`` rows, dealt by the row's place in the input, so neither a shard nor the rows of a key
    are held by a task.  The narrow rows are written once with their run, so a retry sees the same
    runs; another call may give other slots.  Other columns are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    runs = max(1, docs.count() // (RUN * len(weights)))
    run = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(runs)).alias("_run")
    rows = materialise(docs.select(
        F.col(key).alias("_key"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).alias("grown_shard"), run))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_run").agg(F.count(F.lit(1)).alias("_n")) \
        .select("shard", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_run").orderBy("_key", "text_crc32", "size")
    return rows.withColumn("_i", F.row_number().over(inside)).join(starts, ["shard", "_run"]).select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_start") + F.col("_i") - F.lit(1)).alias("slot"),
        "grown_shard")
