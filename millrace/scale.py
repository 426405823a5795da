"""Building blocks that keep hot keys from landing in one task.

A key, batch or source may hold a third of all rows.  Plain keyed windows and
the join of rows with their own group statistics then put that third into one
task.  The helpers here first count rows per hash bucket of the key (one
map-side combined pass that moves at most ``BUCKETS`` rows per task).  Keys of buckets with more rows than the limit are
counted one by one; those over the limit are hot.  They stay a table, one row each with its number of salts, and are never
collected: as each has more rows than the limit, there are at most rows / limit of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import materialise

BUCKETS = 4096
SMALL_ROWS = 200_000
SMALL_BYTES = 64 << 20
HOT_ROWS_KEY = "spark.millrace.hotRows"
HOT_ROWS_DEFAULT = 2_000_000
TASK_ROWS_KEY = "spark.millrace.taskRows"
TASK_ROWS_DEFAULT = 500_000


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(BUCKETS)).cast("int")


def _hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_KEY, str(HOT_ROWS_DEFAULT)))


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores, before work that
    is heavy per row.  A large input has more partitions and stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``rows`` rows dealt by key over so many partitions that each has about ``spark.millrace.taskRows`` of them, or fewer.  Over a fixed
    number of partitions a task's sort and hash tables would grow with the input.  What the cores hold at once stays as it is."""
    spark = df.sparkSession
    n = math.ceil(rows / int(spark.conf.get(TASK_ROWS_KEY, str(TASK_ROWS_DEFAULT))))
    if n <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), *[F.col(k) for k in keys])


def _broadcasts(df: DataFrame) -> bool:
    """Whether Spark's own estimate lets it broadcast the frame."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys with more rows than a task should have: the key columns as ``_hot_<name>`` and ``_salts``, rows / limit rounded up.
    None where there is no such key; then only the bucket counts were made."""
    return _counted(df, keys)[1]


def _counted(df: DataFrame, keys: Sequence[str]) -> tuple[int, DataFrame | None]:
    """The number of rows and the ``hot_keys``."""
    keys, limit = list(keys), _hot_rows(df.sparkSession)
    buckets = df.groupBy(_bucket(keys).alias("b")).count().collect()
    rows = sum(r["count"] for r in buckets)
    full = sorted(r["b"] for r in buckets if r["count"] > limit)
    if not full:
        return rows, None
    inside = df if len(full) == len(buckets) else df.filter(_bucket(keys).isin(full))
    busy = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    hot = materialise(busy.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col("_rows") / F.lit(limit)).cast("int").alias("_salts")))
    return rows, None if hot.isEmpty() else hot


def _marked(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Rows with the ``_salts`` of their key, null where it is not hot.  Null is a key like others.  The list is
    broadcast after it was counted; a longer one is joined, and AQE splits what is skewed."""
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    return df.join(F.broadcast(hot) if hot.count() <= SMALL_ROWS else hot, same, "left").drop(*[f"_hot_{k}" for k in keys])


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join rows (inner, left, left semi or left anti) with a frame that has one row per key; with ``null_safe`` null is a key like others.

    Left rows of hot keys get a salt from the hash of the whole row and the matching right rows are repeated once per
    salt, as often as the key's size asks; all other rows join plainly.
    """
    keys = list(keys)
    rows, hot = _counted(left, keys)

    def equal(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        if not null_safe:
            return a.join(b, on, how)
        b = b.select(*[F.col(k).alias(f"_same_{k}") for k in on], *[c for c in b.columns if c not in on])
        same = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in on]
        return a.join(b, reduce(lambda x, y: x & y, same), how).drop(*[f"_same_{k}" for k in on])

    if hot is None:
        return equal(left, right, keys) if _broadcasts(right) else equal(dealt(left, keys, rows), dealt(right, keys, rows), keys)
    hashable = [F.col(f.name) for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    salted = _marked(left, keys, hot).withColumn("_salt", F.pmod(F.xxhash64(*hashable), salts).cast("int")).drop("_salts")
    spread = _marked(right, keys, hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return equal(salted, spread, keys + ["_salt"]).drop("_salt")


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Every row with aggregates of its group; null is a key like others.

    Ordinary groups take a keyed window, which shares the exchange of other work on the key.  Groups of hot keys are aggregated
    (combined per task) and joined back with salts."""
    keys = list(keys)
    hot = hot_keys(df, keys)

    def windowed(rows: DataFrame) -> DataFrame:
        return rows.select("*", *[a.over(Window.partitionBy(*keys)).alias(n) for n, a in aggs.items()])
    if hot is None:
        return windowed(df)
    marked = _marked(df, keys, hot)
    busy = marked.filter("_salts IS NOT NULL").drop("_salts")
    stats = busy.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return windowed(marked.filter("_salts IS NULL").drop("_salts")).unionByName(join_on_keys(busy, stats, keys, null_safe=True))


def _range_rank(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Row number per key through a range sort: contiguous ranges of
    (keys, order) spread even one key over many tasks.  The sorted position is
    written once (checkpoint), then per-(key, range) counts give the offsets."""
    by = [F.col(k) for k in keys] + order
    placed = materialise(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    ).withColumn("_pid", F.shiftright("_m", 33))
    runs = placed.groupBy(*keys, "_pid").agg(F.min("_m").alias("_start"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per key and range: a key's rows here are at most the number of partitions
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    if keys:
        r = runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                        F.col("_pid").alias("_rp"), "_start", "_before")
        on = F.col("_pid") == F.col("_rp")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        joined = placed.join(r, on).drop("_rp", *[f"_k{i}" for i in range(len(keys))])
    else:
        # as many rows as there are partitions, so the broadcast has a fixed bound
        joined = placed.join(F.broadcast(runs), "_pid")
    return joined.withColumn(name, F.col("_m") - F.col("_start") + F.col("_before") + F.lit(1)) \
        .drop("_m", "_pid", "_start", "_before")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """1-based ``row_number`` per key.  Hot keys take the range
    route; the rest use one ordinary window."""
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rows, hot = _counted(df, keys)
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    if hot is None:
        return dealt(df, keys, rows).withColumn(name, plain)
    marked = _marked(df, keys, hot)
    cold = dealt(marked.filter("_salts IS NULL").drop("_salts"), keys, rows).withColumn(name, plain)
    return cold.unionByName(_range_rank(marked.filter("_salts IS NOT NULL").drop("_salts"), keys, order, name))


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """0-based global row index in ``order`` (no single-partition window)."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    return _range_rank(df, [], order, name).withColumn(name, F.col(name) - 1)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int,
                  name: str = "rn") -> DataFrame:
    """The first ``n`` rows per key.  Spark cuts each map task to ``n`` rows per
    key before the shuffle (WindowGroupLimit), so a hot key stays small."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], col: str,
                  name: str) -> DataFrame:
    """``lag(col)`` per key; hot keys are ranked by range and joined to the row before."""
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rows, hot = _counted(df, keys)
    plain = F.lag(col).over(Window.partitionBy(*keys).orderBy(*order))
    if hot is None:
        return dealt(df, keys, rows).withColumn(name, plain)
    marked = _marked(df, keys, hot)
    cold = dealt(marked.filter("_salts IS NULL").drop("_salts"), keys, rows).withColumn(name, plain)
    ranked = materialise(_range_rank(marked.filter("_salts IS NOT NULL").drop("_salts"), keys, order, "_rn"))
    before = ranked.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_rn") + 1).alias("_after"), F.col(col).alias(name))
    same = F.col("_rn") == F.col("_after")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return cold.unionByName(ranked.join(before, same, "left").drop("_rn", "_after", *[f"_k{i}" for i in range(len(keys))]))


def running_sums(df: DataFrame, key: str, cols: Sequence[str], fan: int = 1024, depth: int | None = None) -> DataFrame:
    """Inclusive running totals ``cum_<col>`` along a unique integer key.

    Blocks of ``fan`` keys are summed, the block totals are run recursively, and
    each block adds its offset: no window holds more than ``fan`` rows until the
    last level, which has 1/fan**depth of them.  Without ``depth`` the rows are
    counted: a table that fits one window is run in one."""
    if depth is None:
        n, depth = df.count(), 0
        while n > SMALL_ROWS:
            n, depth = n // fan, depth + 1
    if depth == 0:
        w = Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(f"cum_{c}") for c in cols])
    blk = f"{key}_blk"
    blocked = df.withColumn(blk, F.floor(F.col(key) / F.lit(fan)))
    sums = blocked.groupBy(blk).agg(*[F.sum(c).alias(c) for c in cols])
    offs = running_sums(sums, blk, cols, fan, depth - 1).select(
        blk, *[(F.col(f"cum_{c}") - F.col(c)).alias(f"_off_{c}") for c in cols])
    w = Window.partitionBy(blk).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return blocked.join(offs, blk).select(
        *df.columns, *[(F.sum(c).over(w) + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in cols])


def discounted_suffix(df: DataFrame, keys: Sequence[str], pos: str, val: str, g: float, name: str,
                      block: int = 1024) -> DataFrame:
    """``A_t = val_t + g * A_{t+1}`` along dense 0-based positions per key.

    A sequence is cut into blocks.  Inside a block the recursion is a running
    sum from the end; what later blocks contribute enters as a carry that is
    itself the same recursion over block sums, so no task sees a whole long
    sequence."""
    keys = list(keys)
    if 0 < g < 1:
        block = max(1, min(block, int(200 / -math.log10(g))))  # keep g**block representable
    elif g == 0:
        return df.withColumn(name, F.col(val))
    steps = F.col(pos) - F.col("_blk") * block
    blocked = df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block)))
    sums = blocked.filter(F.col("_blk") >= 1).groupBy(*keys, "_blk").agg(
        F.sum(F.col(val) * F.pow(F.lit(g), steps)).alias("_s"))
    carry = _suffix_arrays(sums, keys, "_blk", "_s", g ** block, block, 1) \
        .select(*keys, (F.col("_blk") - 1).alias("_blk"), F.col("_a").alias("_carry"))
    w = Window.partitionBy(*keys, "_blk").orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn(name, F.sum(F.col(val) * F.pow(F.lit(g), steps)).over(w) / F.pow(F.lit(g), steps))
    return local.join(carry, keys + ["_blk"], "left").withColumn(
        name, F.col(name) + F.coalesce(F.col("_carry"), F.lit(0.0)) * F.pow(F.lit(g), F.lit(block) - steps)
    ).drop("_blk", "_carry")


def _suffix_arrays(df: DataFrame, keys: list[str], pos: str, val: str, g: float, block: int,
                   depth: int) -> DataFrame:
    """The recursion on block sums; groups hold at most ``block`` entries
    (at the last level 1/block**2 of the tokens)."""
    up = f"{pos}u"
    if depth == 0:
        grouped = df.withColumn(up, F.lit(0)).withColumn("_carry", F.lit(0.0))
    else:
        grouped = df.withColumn(up, F.floor(F.col(pos) / F.lit(block)))
        first = F.col(pos) - F.col(up) * block
        sums = grouped.filter(F.col(up) >= 1).groupBy(*keys, up).agg(
            F.sum(F.col(val) * F.pow(F.lit(g), first)).alias("_s2"))
        carry = _suffix_arrays(sums.withColumnRenamed("_s2", val), keys, up, val, g ** block, block, 0) \
            .select(*keys, (F.col(up) - 1).alias(up), F.col("_a").alias("_carry"))
        grouped = grouped.join(carry, keys + [up], "left")
    lists = grouped.groupBy(*keys, up).agg(
        F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(val).alias("v"))), asc=False).alias("_l"),
        F.coalesce(F.max("_carry"), F.lit(0.0)).alias("_in"))
    # latest block first; blocks are dense from the first one present to the end
    # of the sequence, and a carry belongs to the position after a full group
    entry = T.ArrayType(T.StructType([T.StructField("p", T.LongType()), T.StructField("a", T.DoubleType())]))
    rows = F.aggregate(
        "_l", F.struct(F.col("_in").alias("a"), F.array().cast(entry).alias("out")),
        lambda acc, x: F.struct(
            (x["v"] + F.lit(g) * acc["a"]).alias("a"),
            F.concat(acc["out"], F.array(F.struct(
                x["p"].cast("long").alias("p"), (x["v"] + F.lit(g) * acc["a"]).alias("a")))).alias("out")),
        lambda acc: acc["out"])
    return lists.select(*keys, F.explode(rows).alias("_e")).select(
        *keys, F.col("_e.p").alias(pos), F.col("_e.a").alias("_a"))


def order_statistics(df: DataFrame, col: str, ranks: Sequence[int], bins: int = 4096,
                     small: int = 4096) -> dict:
    """Exact 0-based order statistics of a numeric column by repeated
    histograms.  Each pass is one map-side combined count of ``bins`` rows; a
    bin is refined between its own least and greatest value until it is constant
    or small enough to sort."""
    df = df.select(F.col(col).alias("v")).filter("v IS NOT NULL")
    lo, hi = df.agg(F.min("v"), F.max("v")).first()
    out: dict = {}
    todo = [(r, 0, lo, hi) for r in ranks]
    while todo:
        rest = []
        for lo, hi, below in sorted({(lo, hi, b) for _, b, lo, hi in todo}):
            wanted = [r for r, b, l, h in todo if (l, h, b) == (lo, hi, below)]
            part = df.filter(F.col("v").between(lo, hi))
            if lo == hi:
                out.update({r: lo for r in wanted})
                continue
            at = F.least(F.floor((F.col("v") - F.lit(lo)).cast("double") / F.lit((hi - lo) / bins)), F.lit(bins - 1)).alias("b")
            hist = sorted(part.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                               F.max("v").alias("hi")).collect())
            for r in wanted:
                seen = below
                for h in hist:
                    if seen + h["n"] > r:
                        break
                    seen += h["n"]
                if h["lo"] == h["hi"]:
                    out[r] = h["lo"]
                elif h["n"] <= small:
                    vals = sorted(x["v"] for x in part.filter(F.col("v").between(h["lo"], h["hi"])).collect())
                    out[r] = vals[r - seen]
                else:
                    rest.append((r, seen, h["lo"], h["hi"]))
        todo = rest
    return out


def quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Exact quantile with linear interpolation."""
    n = df.filter(F.col(col).isNotNull()).count()
    if n == 0:
        return None
    h = q * (n - 1)
    k0, k1 = math.floor(h), math.ceil(h)
    s = order_statistics(df, col, sorted({k0, k1}))
    return s[k0] + (s[k1] - s[k0]) * (h - k0)


def join_small(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a frame expected to be catalog-sized.  It is written once and
    measured: up to ``SMALL_ROWS`` rows and ``SMALL_BYTES`` on disk it is broadcast
    and ``left`` is not shuffled; a larger one takes the hot-safe shuffle join."""
    fixed = materialise(right)
    size = int(str(fixed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= SMALL_BYTES and fixed.count() <= SMALL_ROWS:
        return left.join(F.broadcast(fixed), list(keys), how)
    return join_on_keys(left, fixed, keys, how)


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rows: int, aggs: dict[str, Column],
            block: int = 100_000) -> DataFrame:
    """Aggregates over the last ``rows`` rows of each key, the current one included.

    Rows are ranked and cut into blocks; the end of a block is repeated as the
    lead-in of the next, so a window never holds more than one block."""
    if block < rows:
        raise ValueError("a block must hold a whole frame")
    r = rank_within(df, keys, order, "_rn").withColumn("_own", F.floor((F.col("_rn") - 1) / block))
    late = (F.col("_rn") - 1) % block >= block - (rows - 1)
    r = r.withColumn("_blk", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(-(rows - 1), 0)
    return r.select("*", *[a.over(w).alias(n) for n, a in aggs.items()]).filter("_blk = _own").drop("_rn", "_own", "_blk")
