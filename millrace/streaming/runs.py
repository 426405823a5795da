"""Run events: batch folds and the Structured Streaming jobs that equal them.

Streams read a file source with ``availableNow`` (or any other trigger the caller sets) and write to a ``BatchTable``: a
batch that is retried replaces its rows, so results stay exact, and the number of files stays bounded.

A stream that waits for a watermark (the guard, sessions) shows what is final.  A closing event, far later than any
other, ends it: it is read from a folder of the job itself and moves the watermark past all events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scale import with_previous
from ..sources.files import ALLOWED_EXTENSIONS
from .guard import TransitionGuard
from .tables import BatchTable

# States an action may start from, for jobs and for projects.
ACTION_RULES = {
    ("job", "start"): ("pending", "queued"),
    ("project", "start"): ("pending",),
    ("project", "reset"): ("pending", "queued", "running", "completed", "failed", "cancelled"),
    ("job", "retry"): ("failed",),
    ("project", "retry"): ("failed",),
    ("job", "cancel"): ("pending", "queued", "running", "failed"),
    ("project", "cancel"): ("pending", "queued", "running"),
    ("job", "delete"): ("pending", "queued", "completed", "failed", "cancelled"),
    ("project", "delete"): ("pending", "queued", "completed", "failed", "cancelled"),
}
# Status changes that those actions and a worker's progress produce.
TRANSITIONS = (
    ("pending", "queued"), ("pending", "running"), ("queued", "running"), ("running", "completed"), ("running", "failed"),
    ("failed", "pending"), ("pending", "cancelled"), ("queued", "cancelled"), ("running", "cancelled"), ("failed", "cancelled"),
)

POLLED = ("status", "progress", "epoch", "loss", "error")
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSING = "9999-01-01 00:00:00"  # time of the closing event


# ---------------------------------------------------------------- batch forms

def _state_columns(order: Column) -> list[Column]:
    s = F.col("status")
    return [
        F.max_by("progress", order).alias("progress"),
        F.max_by("epoch", order).alias("epoch"),
        F.max_by("loss", F.when(F.col("loss").isNotNull(), order)).alias("loss"),
        F.max_by("status", F.when(s.isNotNull(), order)).alias("status"),
        F.max_by("error", F.when(F.col("error").isNotNull(), order)).alias("error"),
        F.min(F.when(s == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(s.isin("completed", "failed"), F.col("ts"))).alias("completed_at")]


def progress_state(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Fold updates per run: last progress and epoch (also null), last non-null loss, status and error, first
    start, last end.  All parts are combinable, so a busy run is pre-folded
    before the shuffle."""
    return events.groupBy(run).agg(*_state_columns(F.struct("ts", "event_id")))


def latest_state(events: DataFrame, run: str = "run_id", cols: Sequence[str] = POLLED) -> DataFrame:
    """The newest event of each run, with the fields that pollers read."""
    e = events.groupBy(run).agg(F.max_by(F.struct("ts", "event_id", *cols), F.struct("ts", "event_id")).alias("_e"))
    return e.select(run, *[F.col(f"_e.{c}").alias(c) for c in ("ts", "event_id", *cols)])


def _allowed(before: Column, after: Column, transitions: Sequence[tuple[str, str]]) -> Column:
    """Membership in the fixed transition table."""
    return F.concat_ws(">", before, after).isin(*[f"{a}>{b}" for a, b in transitions])


def transition_guard(events: DataFrame, run: str = "run_id", transitions: Sequence[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """Every status change that the table does not allow (repeats are no change)."""
    e = with_previous(events.select(run, "event_id", "ts", "status"), [run], ["ts", "event_id"], "status", "previous")
    return e.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("status"))
                    & ~_allowed(F.col("previous"), F.col("status"), transitions))


def action_guard(requests: DataFrame, kind: str, action: Column, status: Column) -> DataFrame:
    """Requests with ``allowed`` and, where not, the reason."""
    ok = F.lit(False)
    for (k, a), states in ACTION_RULES.items():
        if k == kind:
            ok = ok | ((action == a) & status.isin(*states))
    return requests.withColumn("allowed", ok).withColumn(
        "reason", F.when(~F.col("allowed"), F.concat(F.lit("cannot "), action, F.lit(f" a {kind} that is "), status)))


def log_lines(events: DataFrame, message: Column, run: str = "run_id") -> DataFrame:
    """One formatted line per event, for logs too long for one value."""
    line = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), message, F.lit("\n"))
    return events.select(run, "ts", "event_id", line.alias("line"))


def log_append(events: DataFrame, message: Column, run: str = "run_id") -> DataFrame:
    """The run's log text, ``[HH:MM:SS] message`` per line in event order.  A text is one
    value, so each log must fit a task; ``log_lines`` has no such bound."""
    lines = F.sort_array(F.collect_list(F.struct("ts", "event_id", "line")))
    return log_lines(events, message, run).groupBy(run).agg(
        F.array_join(F.transform(lines, lambda s: s["line"]), "").alias("log"), F.count(F.lit(1)).alias("lines"))


def _utc(ts: Column) -> Column:
    return ts.cast("timestamp")


def _ntz(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def throughput_windows(events: DataFrame, by: str, value: str, size: str, slide: str | None = None) -> DataFrame:
    """Rows and value sum per window and key, tumbling or sliding, with the rate
    per second of the window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _window_columns(events.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")), by)


def _window_columns(agg: DataFrame, by: str) -> DataFrame:
    seconds = (F.unix_micros(_utc(F.col("w.end"))) - F.unix_micros(_utc(F.col("w.start")))) / F.lit(1_000_000.0)
    return agg.select(_ntz(F.col("w.start")).alias("window_start"), _ntz(F.col("w.end")).alias("window_end"), by, "n", "total",
                      (F.col("n") / seconds).alias("rows_per_second"))


def session_throughput(events: DataFrame, by: str, value: str, gap_seconds: int) -> DataFrame:
    """Rows and value sum per session (a pause of ``gap_seconds`` ends one).

    Events of one key in one gap-long slot always share a session, so they are
    folded per slot first; what is ordered per key is one row per busy slot,
    which the time span bounds, not the number of events."""
    us = F.unix_micros(_utc(F.col("ts")))
    gap = gap_seconds * 1_000_000
    slots = events.groupBy(by, F.floor(us / F.lit(gap)).alias("_slot")).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    w = Window.partitionBy(by).orderBy("_slot")
    pause = F.unix_micros(_utc(F.col("lo"))) - F.unix_micros(_utc(F.lag("hi").over(w)))
    s = slots.withColumn("_new", F.when(pause < gap, 0).otherwise(1)).withColumn(
        "_session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(by, "_session").agg(
        F.min("lo").alias("session_start"), F.max("hi").alias("last_event"), F.sum("n").alias("n"), F.sum("total").alias("total")) \
        .drop("_session")


# --------------------------------------------------------------- stream forms

def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def run_to_end(stream: DataFrame, checkpoint: str, mode: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Process everything there is and stop."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).foreachBatch(batch).start()
    q.awaitTermination()


def _kept(stream: DataFrame, path: str, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream to its end into a table; the table's rows."""
    spark = stream.sparkSession
    table = BatchTable(spark, f"{path}/table", keys)
    run_to_end(stream, f"{path}/_checkpoint", mode, lambda df, batch: table.write(df, batch))
    return table.read(stream.schema)


def _with_closing(events: DataFrame, path: str) -> DataFrame:
    """Events and, from a folder that is empty until ``_close``, the closing event (all columns null but ``_t``)."""
    spark, folder = events.sparkSession, f"{path}/closing"
    # the folder must be there when the stream starts
    spark.createDataFrame([], events.schema).write.mode("ignore").parquet(folder)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(folder))


def _close(events: DataFrame, path: str) -> None:
    spark = events.sparkSession
    one = spark.range(1).select(*[
        (F.lit(CLOSING) if f.name == "_t" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    one.coalesce(1).write.mode("append").parquet(f"{path}/closing")


def progress_state_stream(events: DataFrame, path: str, run: str = "run_id") -> DataFrame:
    """``progress_state`` kept by a streaming aggregation in an upsert table."""
    e = events.withColumn("ts", _utc(F.col("ts")))
    out = _kept(e.groupBy(run).agg(*_state_columns(F.struct("ts", "event_id"))), path, "update", [run])
    return out.withColumn("started_at", _ntz(F.col("started_at"))).withColumn("completed_at", _ntz(F.col("completed_at")))


def latest_state_stream(events: DataFrame, path: str, run: str = "run_id", cols: Sequence[str] = POLLED) -> DataFrame:
    """``latest_state`` kept by a streaming aggregation in an upsert table."""
    e = events.withColumn("ts", _utc(F.col("ts")))
    newest = e.groupBy(run).agg(F.max_by(F.struct("ts", "event_id", *cols), F.struct("ts", "event_id")).alias("_e"))
    flat = newest.select(run, *[F.col(f"_e.{c}").alias(c) for c in ("ts", "event_id", *cols)])
    return _kept(flat, path, "update", [run]).withColumn("ts", _ntz(F.col("ts")))


def transition_guard_stream(events: DataFrame, path: str, run: str = "run_id", transitions: Sequence[tuple[str, str]] = TRANSITIONS,
                            delay: str = "10 minutes", close: bool = True) -> DataFrame:
    """The violations of ``transition_guard``, from state per run that follows event time (``TransitionGuard``).

    Events wait in the state until the watermark (the latest time less ``delay``) has passed them, are then judged in
    order and leave; so an event that comes late, but inside the watermark, takes its place, and a batch
    costs what it brings.  Later ones are dropped, as are events without a time.  Without ``close`` the violations are those up to
    the watermark, and a later call with the same ``path`` goes on.  Needs the RocksDB state store, which is set for this stream."""
    spark = events.sparkSession
    kind = events.schema[run].dataType.simpleString()
    ids = events.schema["event_id"].dataType.simpleString()
    at = _utc(F.col("ts"))
    e = events.select(F.col(run).alias("run"), "event_id", "status", at.alias("_t"), F.unix_micros(at).alias("us")).filter("_t IS NOT NULL")
    checked = _with_closing(e, path).withWatermark("_t", delay).groupBy("run").transformWithState(
        TransitionGuard([f"{a}>{b}" for a, b in transitions], ids),
        f"run {kind}, event_id {ids}, us bigint, status string, previous string", "append", "EventTime") \
        .select("run", "event_id", F.timestamp_micros("us").alias("ts"), "status", "previous")
    old = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        out = _kept(checked, path, "append")
        if close:
            _close(e, path)
            out = _kept(checked, path, "append")
    finally:
        spark.conf.set(STATE_STORE, old)
    return out.withColumn("ts", _ntz(F.col("ts"))).withColumnRenamed("run", run)


def throughput_stream(events: DataFrame, path: str, by: str, value: str, size: str, slide: str | None = None,
                      delay: str = "10 minutes", mode: str = "update") -> DataFrame:
    """Windows kept by a streaming aggregation.  The watermark drops rows later
    than ``delay`` and frees closed windows; update mode also shows open ones."""
    e = events.withColumn("_t", _utc(F.col("ts"))).withWatermark("_t", delay)
    w = F.window("_t", size, slide) if slide else F.window("_t", size)
    agg = e.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return _window_columns(_kept(agg, path, mode, ["w", by]), by)


def session_stream(events: DataFrame, path: str, by: str, value: str, gap: str, delay: str = "10 minutes",
                   close: bool = False) -> DataFrame:
    """Sessions that the watermark has passed; with ``close`` all of them, and the stream takes no more events."""
    e = events.select(by, value, _utc(F.col("ts")).alias("_t"), F.lit(1).alias("_real"))
    w = F.session_window("_t", gap).alias("w")
    agg = _with_closing(e, path).withWatermark("_t", delay).groupBy(w, by).agg(
        F.count("_real").alias("n"), F.sum(value).alias("total"), F.max("_t").alias("last_event"))
    out = _kept(agg, path, "append")
    if close:
        _close(e, path)
        out = _kept(agg, path, "append")
    return out.select(by, _ntz(F.col("w.start")).alias("session_start"), _ntz(F.col("last_event")).alias("last_event"), "n", "total")


def discover_files(spark: SparkSession, root: str, path: str, extensions: Sequence[str] = ALLOWED_EXTENSIONS) -> DataFrame:
    """Register files that no earlier call with the same ``path`` has seen; the
    stream's checkpoint is the memory.  Returns all registered files with the
    number of the call's micro-batch."""
    # no age limit: a file older than others seen before is still new here
    files = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFileAge", "36500d") \
        .load(root).select("path", "length", F.col("modificationTime").alias("modified")) \
        .filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*[e.lower() for e in extensions]))
    table = BatchTable(spark, f"{path}/table")
    run_to_end(files, f"{path}/_checkpoint", "append", lambda df, batch: table.write(df.withColumn("batch", F.lit(batch)), batch))
    return table.read(files.withColumn("batch", F.lit(0)).schema)


def log_stream(events: DataFrame, path: str, message: Column, run: str = "run_id") -> DataFrame:
    """Log lines appended per micro-batch; ``log_append`` over them gives the text."""
    lines = events.withColumn("message", message).select(run, "ts", "event_id", "message")
    return log_append(_kept(lines, path, "append"), F.col("message"), run)
