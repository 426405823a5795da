"""Run events in batch and as streams (STR-1..6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..session import scratch_path
from ..streaming import runs as st
from ..tables import ctes, jobs, run_events, table
from .registry import query

RUNS = ctes("run_events")


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    return run_events(table(spark, sf, "events"))


def _raw_stream(spark: SparkSession, sf: str) -> DataFrame:
    # a pattern, so that a table of one file and a directory of many both work
    return st.event_stream(spark, f"{sf}/[e]vents.parquet", table(spark, sf, "events").schema)


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return run_events(_raw_stream(spark, sf))


PROGRESS_SQL = RUNS + """
SELECT run_id, arg_max(progress, event_id) AS progress, arg_max(epoch, event_id) AS epoch,
  arg_max(loss, event_id) FILTER (loss IS NOT NULL) AS loss, arg_max(status, event_id) AS status,
  arg_max(error, event_id) FILTER (error IS NOT NULL) AS error, min(ts) FILTER (status = 'running') AS started_at,
  max(ts) FILTER (status IN ('completed', 'failed')) AS completed_at
FROM (SELECT * REPLACE (row_number() OVER (ORDER BY ts, event_id) AS event_id) FROM run_events) GROUP BY run_id"""


@query("progress_state", PROGRESS_SQL)
def progress_state(spark, sf):
    return st.progress_state(_batch(spark, sf))


@query("progress_state_stream", PROGRESS_SQL)
def progress_state_stream(spark, sf):
    return st.progress_state_stream(_stream(spark, sf), scratch_path(spark, "progress"))


_PAIRS = ", ".join(f"'{a}>{b}'" for a, b in st.TRANSITIONS)
GUARD_SQL = RUNS + f""", p AS (SELECT run_id, event_id, ts, status, lag(status) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS previous FROM run_events)
SELECT run_id, event_id, ts, status, previous FROM p WHERE previous IS NOT NULL AND previous <> status AND previous || '>' || status NOT IN ({_PAIRS})"""


@query("transition_guard", GUARD_SQL)
def transition_guard(spark, sf):
    return st.transition_guard(_batch(spark, sf))


@query("transition_guard_stream", GUARD_SQL)
def transition_guard_stream(spark, sf):
    return st.transition_guard_stream(_stream(spark, sf), scratch_path(spark, "guard"))


@query("transition_guard_actions", ctes("jobs") + """, r AS (SELECT id, status, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'start' WHEN '2' THEN 'retry'
  WHEN '3' THEN 'cancel' ELSE 'delete' END AS action FROM jobs JOIN orders ON o_orderkey = id),
a AS (SELECT *, CASE action WHEN 'start' THEN status IN ('pending', 'queued') WHEN 'retry' THEN status = 'failed'
  WHEN 'cancel' THEN status NOT IN ('completed', 'cancelled') ELSE status <> 'running' END AS allowed FROM r)
SELECT id, status, action, allowed, CASE WHEN NOT allowed THEN 'cannot ' || action || ' a job that is ' || status END AS reason FROM a""")
def transition_guard_actions(spark, sf):
    p = F.substring("o_orderpriority", 1, 1)
    acts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(p == "1", "start").when(p == "2", "retry")
                                             .when(p == "3", "cancel").otherwise("delete").alias("action"))
    r = jobs(spark, sf).select("id", "status").join(acts, "id")
    return st.action_guard(r, "job", F.col("action"), F.col("status"))


LOG_SQL = RUNS + """
SELECT run_id, string_agg('[' || strftime(ts, '%H:%M:%S') || '] status ' || status || chr(10), '' ORDER BY ts, event_id) AS log,
  count(*) AS lines FROM run_events GROUP BY run_id"""


@query("log_append", LOG_SQL)
def log_append(spark, sf):
    return st.log_append(_batch(spark, sf), F.concat(F.lit("status "), F.col("status")))


@query("log_append_stream", LOG_SQL)
def log_append_stream(spark, sf):
    return st.log_stream(_stream(spark, sf), scratch_path(spark, "logs"), F.concat(F.lit("status "), F.col("status")))


@query("stream_discovery", """
SELECT 'source=' || source AS author, 'lang=' || lang AS dataset, true AS found, CAST(0 AS BIGINT) AS found_again FROM documents GROUP BY source, lang""")
def stream_discovery(spark, sf):
    root, state = scratch_path(spark, "tree"), scratch_path(spark, "discovery")
    table(spark, sf, "documents").write.partitionBy("source", "lang").json(root)
    first = st.discover_files(spark, root, state).count()
    seen = st.discover_files(spark, root, state)
    parts = F.split("path", "/")
    n = F.size(parts)
    return seen.groupBy(parts[n - 3].alias("author"), parts[n - 2].alias("dataset")).agg(
        (F.count(F.lit(1)) > 0).alias("found"), (F.count_distinct("batch") - 1).alias("found_again")) \
        .filter(F.lit(first > 0))


TUMBLING_SQL = """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n,
  round(sum(value), 4) AS total, round(count(*) / 86400.0, 9) AS rows_per_second FROM events GROUP BY 1, 2, 3"""
SLIDING_SQL = """
SELECT s AS window_start, s + INTERVAL 2 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total,
  round(count(*) / 172800.0, 9) AS rows_per_second
FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1, 2, 3"""
SESSION_SQL = """
WITH p AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM p)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("total", rnd(F.col("total"), 4)).withColumn("rows_per_second", rnd(F.col("rows_per_second"), 9))


@query("throughput_windows", TUMBLING_SQL)
def throughput_windows(spark, sf):
    return _rounded(st.throughput_windows(table(spark, sf, "events"), "event_type", "value", "1 day"))


@query("throughput_windows_sliding", SLIDING_SQL)
def throughput_windows_sliding(spark, sf):
    return _rounded(st.throughput_windows(table(spark, sf, "events"), "event_type", "value", "2 days", "1 day"))


@query("throughput_windows_session", SESSION_SQL)
def throughput_windows_session(spark, sf):
    return st.session_throughput(table(spark, sf, "events"), "user_id", "value", 6 * 3600).withColumn("total", rnd(F.col("total"), 4))


@query("throughput_windows_stream", TUMBLING_SQL)
def throughput_windows_stream(spark, sf):
    return _rounded(st.throughput_stream(_raw_stream(spark, sf), scratch_path(spark, "windows"), "event_type", "value", "1 day"))


@query("throughput_windows_session_stream", SESSION_SQL)
def throughput_windows_session_stream(spark, sf):
    sessions = st.session_stream(_raw_stream(spark, sf), scratch_path(spark, "sessions"), "user_id", "value", "6 hours", close=True)
    return sessions.withColumn("total", rnd(F.col("total"), 4))


LATEST_SQL = RUNS + """, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn FROM run_events)
SELECT run_id, ts, event_id, status, progress, epoch, loss, error FROM r WHERE rn = 1"""


@query("latest_state_table", LATEST_SQL)
def latest_state_table(spark, sf):
    return st.latest_state(_batch(spark, sf))


@query("latest_state_table_stream", LATEST_SQL)
def latest_state_table_stream(spark, sf):
    return st.latest_state_stream(_stream(spark, sf), scratch_path(spark, "latest"))
