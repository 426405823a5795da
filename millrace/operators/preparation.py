"""Sampling, mixing, tokenizing, packing and pair preparation."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import IGNORE, keep_first, keep_last, step_example
from ..scale import SMALL_ROWS, dense_index, join_on_keys, join_small, rank_within, running_sums, spread, with_group_stats
from ..session import materialise


def seeded_hash(seed: int, *ids: Column) -> Column:
    """Hex MD5 of the seed and the row key: a repeatable random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]).cast("binary"))


def sample_exact(df: DataFrame, quota: DataFrame, key: str, ids: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly k rows per quota row without replacement (all rows where the
    dataset has no more), repeatable by seed.

    ``quota`` holds (key, k) and any further columns, which the sampled rows
    take over.  Rows are ordered by a seeded hash of their unique ``ids``.  Two
    passes over the id columns find each dataset's cut: counts per hash prefix
    (at most 65,536 per dataset), then the exact hash inside the one prefix that
    holds the cut.  The wide rows are then filtered in place: they are neither
    sorted nor shuffled, however large one dataset is."""
    h = seeded_hash(seed, *[F.col(i) for i in ids])
    slim = df.select(key, h.alias("_h")).withColumn("_b", F.substring("_h", 1, 4))
    w = Window.partitionBy(key).orderBy("_b")
    cum = slim.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cum", F.sum("_n").over(w))
    extra = [c for c in quota.columns if c not in (key, "k")]
    reach = F.col("_cum") >= F.col("k")
    cuts = cum.join(quota, key).groupBy(key, *extra, "k").agg(
        F.max("_cum").alias("_total"), F.min(F.when(reach, F.col("_b"))).alias("_cb"),
        F.min(F.when(reach, F.struct(F.col("_b"), (F.col("k") - F.col("_cum") + F.col("_n")).alias("need")))).alias("_c"))
    # one row per quota row, used twice below
    cuts = materialise(cuts.withColumn("_need", F.col("_c.need")).drop("_c"))
    at = cuts.filter("_total > k AND k > 0").select(key, F.col("_cb").alias("_b"), "_need", *extra)
    edge = join_small(slim, at, [key, "_b"])
    # one prefix of one dataset: 1/65536 of its rows
    we = Window.partitionBy(key, *extra).orderBy("_h")
    exact = edge.withColumn("_rn", F.row_number().over(we)).filter("_rn = _need").select(key, *extra, F.col("_h").alias("_cut"))
    same = [cuts[c].eqNullSafe(exact[c]) for c in [key, *extra]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    # everything sorts below "g": datasets no larger than k are kept whole
    limit = F.when(F.col("_total") <= F.col("k"), "g").when(F.col("k") <= 0, "").otherwise(F.col("_cut"))
    limits = cuts.join(exact, cond, "left").select(cuts[key], *[cuts[c] for c in extra], limit.alias("_limit"))
    return join_small(df, limits, [key]).filter(h <= F.col("_limit")).drop("_limit")


def sample_with_replacement(df: DataFrame, key: str, k: int = 512, seed: int = 0) -> DataFrame:
    """min(n, k) draws with replacement as (draw, row).  Only the key column is
    indexed; the drawn rows, at most ``k`` of them, are broadcast if they are few."""
    n = df.count()
    m = min(n, k)
    draws = df.sparkSession.range(m).select(
        F.col("id").alias("draw"),
        (F.conv(F.substring(seeded_hash(seed, F.col("id")), 1, 12), 16, 10).cast("long") % F.lit(max(n, 1))).alias("idx"))
    index = dense_index(df.select(key), [key])
    if m <= SMALL_ROWS:
        return df.join(F.broadcast(index.join(F.broadcast(draws), "idx").select("draw", key)), key)
    return df.join(index.join(draws, "idx").select("draw", key), key)


def mix_datasets(df: DataFrame, quota: DataFrame, key: str, ids: Sequence[str], seed: int = 0) -> DataFrame:
    """The sampled rows of every allocation in one frame, tagged by the quota's columns."""
    return sample_exact(df, quota, key, ids, seed)


def mix_frames(parts: Sequence[tuple[object, DataFrame, int]], ids: Sequence[str], seed: int = 0) -> DataFrame:
    """The same for datasets that are separate frames: (dataset_id, frame, rows)."""
    out: DataFrame | None = None
    for dataset_id, frame, k in parts:
        tagged = frame.withColumn("dataset_id", F.lit(dataset_id))
        quota = tagged.sparkSession.range(1).select(F.lit(dataset_id).alias("dataset_id"), F.lit(k).cast("long").alias("k"))
        piece = sample_exact(tagged, quota, "dataset_id", ids, seed)
        out = piece if out is None else out.unionByName(piece, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to mix")
    return out


def extract_prompt_messages(chosen: Column, rejected: Column) -> dict[str, Column]:
    """Leading messages that both sides share, and what is left of each side."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    at = F.array_position(same, False)
    n = F.when(at == 0, F.least(F.size(chosen), F.size(rejected)).cast("long")).otherwise(at - 1).cast("int")
    return {"prompt": keep_first(chosen, n), "chosen": F.slice(chosen, n + 1, F.size(chosen)),
            "rejected": F.slice(rejected, n + 1, F.size(rejected))}


def extract_prompt_text(chosen: Column, rejected: Column) -> dict[str, Column]:
    """Longest common prefix of two texts, and the rests."""
    same = F.zip_with(F.split(chosen, ""), F.split(rejected, ""), lambda a, b: a.eqNullSafe(b))
    at = F.array_position(same, False)
    n = F.when(at == 0, F.length(chosen).cast("long")).otherwise(at - 1).cast("int")
    return {"prompt": F.substring(chosen, F.lit(1), n), "chosen": F.substring(chosen, n + 1, F.length(chosen)),
            "rejected": F.substring(rejected, n + 1, F.length(rejected))}


def unpair_preferences(pairs: DataFrame, keep: Sequence[str], chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Two rows per pair: the chosen completion labelled true, the rejected one false."""
    def side(c: str, label: bool) -> Column:
        return F.struct(F.col(c).alias("completion"), F.lit(label).alias("label"))
    return pairs.select(*keep, F.inline(F.array(side(chosen, True), side(rejected, False))))


def tokenize(df: DataFrame, text: str, tokenizer: Callable[[Column], Column], max_length: int | None = None,
             bos: int | None = None, bos_text: str | None = None) -> DataFrame:
    """``input_ids`` by a native or pandas-UDF tokenizer.  Frames that hold
    ``labels`` or ``input_ids`` stay as they are.  BOS is not added to a text
    that starts with it already (decided per row)."""
    if "labels" in df.columns or "input_ids" in df.columns:
        return df
    df = spread(df)
    ids = tokenizer(F.col(text))
    if bos is not None:
        with_bos = F.array_prepend(ids, F.lit(bos).cast("long"))
        ids = F.when(F.col(text).startswith(bos_text), ids).otherwise(with_bos) if bos_text else with_bos
    if max_length is not None:
        ids = keep_first(ids, max_length)
    return df.withColumn("input_ids", ids)


def step_examples(turns: DataFrame, key: str, order: Sequence[str], ids: str, label: str, sep: int, max_completion: int,
                  max_prompt: int | None = None, max_len: int | None = None, bos: int | None = None, last_only: bool = False) -> DataFrame:
    """``input_ids`` and ``labels`` of each conversation: its first turn is the prompt, the others are labelled steps.

    A step has one token at least, so only the first ``max_completion`` steps, and as many of their tokens, can stay after the
    cut; the rest goes before turns are gathered, however long a conversation is.  A prompt without steps stays alone; a null
    label counts as false, null ids as none."""
    numbered = rank_within(turns.select(key, *order, ids, label), [key], order, "_rn")
    if last_only:
        numbered = with_group_stats(numbered, [key], {"_of": F.max("_rn")})
    none = F.array().cast("array<bigint>")
    mark = F.coalesce(F.col(label).cast("boolean"), F.lit(False)).cast("long")
    if last_only:
        mark = F.when(F.col("_rn") == F.col("_of"), mark).otherwise(F.lit(IGNORE))
    prompt = F.col(ids) if max_prompt is None else keep_last(F.col(ids), max_prompt)
    kept = F.coalesce(F.when(F.col("_rn") == 1, prompt).otherwise(keep_first(F.col(ids), max_completion)), none)
    short = numbered.filter(F.col("_rn") <= max_completion + 1).select(key, "_rn", kept.alias("_ids"), mark.cast("long").alias("_label"))
    step = F.struct(F.col("_rn").alias("n"), F.col("_ids").alias("ids"), F.col("_label").alias("label"))
    one = short.groupBy(key).agg(F.max(F.when(F.col("_rn") == 1, F.col("_ids"))).alias("_prompt"),
                                 F.sort_array(F.collect_list(F.when(F.col("_rn") > 1, step))).alias("_steps"))
    out = step_example(F.col("_prompt"), F.col("_steps.ids"), F.col("_steps.label"), sep, bos, max_prompt, max_completion, max_len)
    return one.select(key, *[v.alias(k) for k, v in out.items()])


def vocabulary(words: DataFrame, word: str, token_id: Callable[[Column], Column], size: int) -> DataFrame:
    """One row, ``vocab``: array of the word of each id (the first in order where
    several share one).  ``size`` bounds it.  Words are made distinct first, so
    ids are computed per distinct word and a frequent word moves once per task."""
    per = words.select(F.col(word).alias("w")).distinct().groupBy(token_id(F.col("w")).alias("_id")).agg(F.min("w").alias("w"))
    slots = words.sparkSession.range(size).withColumnRenamed("id", "_id").join(per, "_id", "left")
    return slots.agg(F.transform(F.array_sort(F.collect_list(F.struct("_id", "w"))), lambda s: s["w"]).alias("vocab"))


def detokenize(df: DataFrame, ids: str, vocab: DataFrame) -> DataFrame:
    """``text`` from ids by direct array lookup: the bounded vocabulary travels
    as one value, so tokens are neither exploded nor shuffled."""
    return df.withColumn("_v", vocab.scalar()).withColumn("text", F.array_join(
        F.transform(ids, lambda i: F.get("_v", i.cast("int"))), " ")).drop("_v")


def best_fit_slots(counts: dict[int, int], cap: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on a histogram of lengths (1 to ``cap``): rows (length, rank, each, bin, offset).

    Sequences of a length, ranked from ``rank`` on, lie ``each`` to a bin, from ``bin`` on, the first at ``offset``.
    Bins with equal room are ranges of numbers, so the work depends on the lengths that occur, not on
    the number of sequences: a bin takes as many of a length as it holds before the next one is touched."""
    slots = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges of bins, by number
    bins = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            free = min((f for f in room if f >= length), default=cap)
            each = free // length
            first, last = room[free].pop(0) if free in room else (bins, bins + -(-left // each))
            if free in room and not room[free]:
                del room[free]
            if first == bins:
                bins = last
            full = min(last - first, left // each)
            for n, k in ((full, each), (min(1, last - first - full), left - full * each)):
                if n and 0 < k <= each:
                    slots.append((length, rank, k, first, cap - free))
                    if free > k * length:
                        insort(room.setdefault(free - k * length, []), (first, first + n))
                    first, rank, left = first + n, rank + n * k, left - n * k
            if first < last:
                insort(room.setdefault(free, []), (first, last))
    return slots


def pack_sequences(lengths: DataFrame, key: str, length: str, max_length: int, strategy: str = "bfd") -> DataFrame:
    """Place sequences into rows of ``max_length`` tokens: (key, start, len, bin, offset).

    ``wrapped`` lays them end to end by key.  ``bfd`` cuts longer ones into pieces, so no token is lost, and places pieces best-fit
    decreasing, those of one length by key and start.  The bins follow from the histogram of lengths (``max_length`` rows at
    most), and a piece's place from its rank within its length.  Only keys and lengths move; tokens follow
    by join (``packed_tokens``)."""
    lengths = materialise(lengths.select(key, F.col(length).cast("long").alias("_len")))  # the texts are measured once
    if strategy == "wrapped":
        summed = running_sums(dense_index(lengths.filter("_len > 0"), [key], "_i"), "_i", ["_len"])
        at = summed.withColumn("_at", F.col("cum__len") - F.col("_len"))
        first, last = F.floor(F.col("_at") / max_length), F.floor((F.col("_at") + F.col("_len") - 1) / max_length)
        rows = at.select("*", F.explode(F.sequence(first, last)).alias("bin"))
        start = F.greatest(F.col("_at"), F.col("bin") * max_length)
        end = F.least(F.col("_at") + F.col("_len"), (F.col("bin") + 1) * max_length)
        return rows.select(key, (start - F.col("_at")).alias("start"), (end - start).alias("len"), "bin",
                           (start - F.col("bin") * max_length).alias("offset"))
    if strategy != "bfd":
        raise ValueError(f"unknown packing strategy: {strategy}")
    pieces = materialise(lengths.filter("_len > 0").select(
        key, "_len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_len") - 1) / max_length))).alias("p"))
        .select(key, (F.col("p") * max_length).alias("start"),
                F.least(F.lit(max_length).cast("long"), F.col("_len") - F.col("p") * max_length).alias("len")))
    counts = {r["len"]: r["count"] for r in pieces.groupBy("len").count().collect()}
    slots = best_fit_slots(counts, max_length)
    ends = {(a[0], a[1]): b[1] for a, b in zip(slots, slots[1:], strict=False) if a[0] == b[0]}
    table = lengths.sparkSession.createDataFrame(
        [(n, r, ends.get((n, r), counts[n]), k, b, o) for n, r, k, b, o in slots],
        "len long, _from long, _to long, _each long, _bin long, _offset long")
    ranked = rank_within(pieces, ["len"], [key, "start"], "_rank")
    i = F.col("_rank") - 1 - F.col("_from")
    # as many rows as best-fit steps, bounded by the lengths that can occur
    return ranked.join(F.broadcast(table), "len").filter("_rank > _from and _rank <= _to").select(
        key, "start", "len", (F.col("_bin") + F.floor(i / F.col("_each"))).alias("bin"),
        (F.col("_offset") + i % F.col("_each") * F.col("len")).alias("offset"))


def packed_tokens(seqs: DataFrame, placed: DataFrame, key: str, ids: str) -> DataFrame:
    """Token rows of the packed bins (each at most ``max_length`` tokens).  A
    sequence meets the list of its pieces once and is cut there, so its ids are
    not repeated per piece."""
    lists = placed.groupBy(key).agg(F.collect_list(F.struct("start", "len", "bin", "offset")).alias("_p"))
    piece = seqs.select(key, ids).join(lists, key).select(F.inline(F.transform("_p", lambda p: F.struct(
        p["bin"].alias("bin"), p["offset"].alias("offset"),
        F.slice(ids, (p["start"] + 1).cast("int"), p["len"].cast("int")).alias("t")))))
    return piece.groupBy("bin").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("offset", "t"))), lambda s: s["t"])).alias("input_ids"))


def filter_by_length(df: DataFrame, max_length: int, *cols: str) -> DataFrame:
    """Rows whose id arrays are all short enough; longer ones are dropped, not cut."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.size(c) <= max_length)
    return df.filter(cond)


def split_by_label(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(label)), df.filter(~F.col(label))


def mismatch_pairs(df: DataFrame, ids: Sequence[str], prompt: str, completion: str, batch: int) -> DataFrame:
    """In each batch of rows (by key order) every prompt gets the completion of
    the row before it; the first takes the last one's.  Partners are found on the
    keys alone, the texts are joined by key."""
    at = dense_index(df.select(*ids), list(ids))
    b = F.floor(F.col("idx") / batch)
    key = F.struct(*ids)
    w = Window.partitionBy("batch_id").orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    partner = at.withColumn("batch_id", b).withColumn(
        "_p", F.coalesce(F.lag(key).over(w), F.last(key).over(whole)))
    p = partner.select(*ids, "idx", "batch_id", *[F.col("_p")[i].alias(f"_p_{i}") for i in ids])
    other = df.select(*[F.col(i).alias(f"_p_{i}") for i in ids], F.col(completion).alias(f"KL_{completion}"))
    return df.select(*ids, prompt, completion).join(p, list(ids)).join(other, [f"_p_{i}" for i in ids]) \
        .drop(*[f"_p_{i}" for i in ids])


def class_balance_bounds(df: DataFrame, label: str, desirable_weight: float = 1.0, undesirable_weight: float = 1.0) -> DataFrame:
    """Counts, recommended weight ranges (rounded half to even) and a warning flag."""
    dw, uw = F.lit(desirable_weight), F.lit(undesirable_weight)
    c = df.agg(F.count_if(F.col(label)).alias("d"), F.count(F.lit(1)).alias("n")) \
        .select(F.greatest("d", F.lit(1)).alias("num_desirable"), "n") \
        .select("num_desirable", F.greatest(F.col("n") - F.col("num_desirable"), F.lit(1)).alias("num_undesirable"))
    d, u = F.col("num_desirable"), F.col("num_undesirable")
    differ = d != u

    def bound(x: Column) -> Column:
        return F.when(differ, F.bround(x, 2))

    out = c.select("*", bound(u * uw / d).alias("des_lower"), bound(u * uw / d * F.lit(1.33)).alias("des_upper"),
                   bound(d * dw / u / F.lit(1.33)).alias("und_lower"), bound(d * dw / u).alias("und_upper"))
    ok = dw.between(F.col("des_lower"), F.col("des_upper")) | uw.between(F.col("und_lower"), F.col("und_upper"))
    return out.withColumn("warn", F.coalesce(differ & ~ok, F.lit(False)))


def _positions(df: DataFrame, key: str, seed: int | None) -> DataFrame:
    if seed is None:
        return dense_index(df.select(key), [key])
    return dense_index(df.select(key, seeded_hash(seed, F.col(key)).alias("_h")), ["_h", key]).drop("_h")


def repeat_prompts(df: DataFrame, key: str, batch: int, generations: int, repeats: int, seed: int | None = 0) -> DataFrame:
    """(step, pos, key): batches of distinct prompts, each prompt ``generations``
    times in a row, each batch ``repeats`` times.  A last short batch is kept."""
    at = _positions(df, key, seed)
    return at.select(key, F.col("idx"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(generations - 1))).alias("_g")) \
        .select((F.floor(F.col("idx") / batch) * repeats + F.col("_r")).alias("step"),
                ((F.col("idx") % batch) * generations + F.col("_g")).alias("pos"), key)


def shuffle_and_slice_buffer(df: DataFrame, key: str, buffer: int, slices: int, iterations: int, seed: int | None = 0) -> DataFrame:
    """(step, slice, key): each buffer of rows is shuffled, cut into equal slices,
    and the cycle over the slices is run ``iterations`` times."""
    at = dense_index(df.select(key), [key]).withColumn("_buf", F.floor(F.col("idx") / buffer))
    order = [seeded_hash(seed, F.col(key)), F.col(key)] if seed is not None else [F.col(key)]
    w = Window.partitionBy("_buf")
    s = at.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w)) \
        .withColumn("slice", F.floor((F.col("_rn") - 1) * slices / F.col("_n")))
    return s.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_i")).select(
        (F.col("_buf") * (slices * iterations) + F.col("_i") * slices + F.col("slice")).alias("step"), "slice", key)


def attach_reference_scores(df: DataFrame, scores: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Precomputed ``ref_<col>`` by key, falling back to the frame's own value."""
    s = scores.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in cols])
    out = join_on_keys(df, s, keys)
    for c in cols:
        own = F.col(c) if c in df.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"_s_{c}"), own))
    return out.drop(*[f"_s_{c}" for c in cols])


def drop_duplicate_prompts(df: DataFrame, prompt: str, order: Sequence[str]) -> DataFrame:
    """The first row of each prompt; copies meet in the map-side combine."""
    rest = [c for c in df.columns if c != prompt]
    g = df.groupBy(prompt).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(prompt, *[F.col(f"_r.{c}").alias(c) for c in rest])


def sample_review_rows(df: DataFrame, key: str, n: int, prompt: str, texts: Sequence[str], scores: Sequence[str] = (),
                       seed: int = 0) -> DataFrame:
    """``n`` random rows with each text cut after the prompt and scores rounded to 4."""
    picked = df.orderBy(seeded_hash(seed, F.col(key)), key).limit(n)
    for t in texts:
        picked = picked.withColumn(t, F.substring(F.col(t), F.length(prompt) + 1, F.length(t)))
    for s in scores:
        is_list = dict(df.dtypes)[s].startswith("array")
        picked = picked.withColumn(s, F.transform(s, lambda x: F.round(x, 4)) if is_list else F.round(s, 4))
    return picked


def batched_udf(fn: Callable[[list[str]], list], return_type: str, batch: int = 32) -> Callable[[Column], Column]:
    """A pandas UDF that feeds a user's tokenizer or encoder in batches."""
    @F.pandas_udf(return_type)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            items = s.tolist()
            out: list = []
            for i in range(0, len(items), batch):
                out.extend(fn(items[i:i + batch]))
            yield pd.Series(out)
    return run
