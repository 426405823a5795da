"""Exact token totals for every context limit from a histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import running_sums
from ..session import materialise
from .word_encoder import WordEncoder


def encoded_lengths(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``n_tokens`` of every whole text (null: 0).  Every row is one row; other columns are not read."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for b in batches:
            counts = [np.diff(upto) for _, _, upto in encoder.encode(b.column("_text").to_pylist())]
            n = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(n, pa.int64())], names=[key, "n_tokens"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text")) \
        .mapInArrow(encode, f"`{key}` {kind}, n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per encoded length, ascending sums taken from the end.

    ``context_limit`` (the length), ``docs`` of that length, ``docs_over`` and ``tokens_over`` (documents longer
    than the limit and their tokens), ``total_docs``, ``total_tokens``, ``truncated_tokens`` (sum of
    min(length, limit)), ``cut_tokens`` (what truncation loses) and ``share_within`` (documents not longer).
    Limits between two lengths follow from the next lower row: see ``at_limits``.  An empty table has no rows.
    """
    hist = lengths.groupBy(F.col("n_tokens").alias("context_limit")).agg(F.count(F.lit(1)).alias("docs")) \
        .withColumn("tokens", F.col("context_limit") * F.col("docs"))
    hist = materialise(hist)
    # sums up to a length and totals give the suffix sums; blocks of lengths, so no task needs all of them
    total = hist.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    run = running_sums(hist, "context_limit", ["docs", "tokens"])
    over, rest = F.lit(total["d"]) - F.col("cum_docs"), F.lit(total["t"]) - F.col("cum_tokens")
    cut = rest - over * F.col("context_limit")
    return run.select(
        "context_limit", "docs", over.alias("docs_over"), rest.alias("tokens_over"),
        F.lit(total["d"]).cast("long").alias("total_docs"), F.lit(total["t"]).cast("long").alias("total_tokens"),
        (F.lit(total["t"]) - cut).alias("truncated_tokens"), cut.alias("cut_tokens"),
        (F.col("cum_docs") / F.lit(total["d"])).alias("share_within"))


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Totals for any context limits: ``limit``, ``docs_over``, ``truncated_tokens``, ``cut_tokens``."""
    aggs = []
    for limit in limits:
        over = F.col("context_limit") > F.lit(limit)
        aggs.append(F.struct(
            F.lit(int(limit)).cast("long").alias("limit"),
            F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0)).alias("docs_over"),
            F.coalesce(F.sum(F.least("context_limit", F.lit(limit)) * F.col("docs")), F.lit(0)).alias("truncated_tokens"),
            F.coalesce(F.sum(F.when(over, (F.col("context_limit") - F.lit(limit)) * F.col("docs"))), F.lit(0)).alias("cut_tokens")))
    return histogram.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def length_quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share`` and the least length that this share of the documents does not exceed (null without documents)."""
    aggs = [F.struct(F.lit(float(q)).alias("share"),
                     F.min(F.when(F.col("total_docs") - F.col("docs_over") >= F.ceil(F.lit(float(q)) * F.col("total_docs")),
                                  F.col("context_limit"))).alias("n_tokens")) for q in shares]
    return histogram.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
