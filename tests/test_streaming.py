"""Streams over several micro-batches against the batch forms."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from millrace.streaming import runs as st
from millrace.streaming.guard import TransitionGuard
from millrace.streaming.tables import BatchTable

from .conftest import rows

STATUS = ["pending", "queued", "running", "completed", "failed"]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events in four files whose times do not overlap."""
    d = str(tmp_path_factory.mktemp("events"))
    e = spark.range(400).select(
        F.col("id").alias("event_id"), (F.col("id") % 7).alias("run_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id * 7 as int))").alias("ts"),
        F.element_at(F.array(*[F.lit(s) for s in STATUS]), (F.xxhash64("id") % 5).cast("int") % 5 + F.when(F.xxhash64("id") < 0, 5).otherwise(1)).alias("status"),
        (F.col("id") % 100).cast("double").alias("progress"), F.when(F.col("id") % 5 != 0, F.col("id") / 50).cast("int").alias("epoch"),
        F.when(F.col("id") % 4 != 0, F.col("id") / 10.0).alias("loss"), F.when(F.col("id") % 9 == 0, F.col("id").cast("string")).alias("error"))
    for i in range(4):
        e.filter(F.floor(F.col("event_id") / 100) == i).coalesce(1).write.mode("append").parquet(d)
    return d, spark.read.parquet(d).schema


def stream(spark, events):
    return st.event_stream(spark, events[0], events[1], files_per_trigger=1)


def batch(spark, events):
    return spark.read.schema(events[1]).parquet(events[0])


def test_progress_stream_equals_batch(spark, events, tmp_path):
    got = st.progress_state_stream(stream(spark, events), str(tmp_path))
    want = st.progress_state(batch(spark, events))
    assert rows(got, *want.columns) == rows(want)


def test_latest_stream_equals_batch(spark, events, tmp_path):
    got = st.latest_state_stream(stream(spark, events), str(tmp_path))
    want = st.latest_state(batch(spark, events))
    assert rows(got, *want.columns) == rows(want)


def test_guard_stream_equals_batch(spark, events, tmp_path):
    want = st.transition_guard(batch(spark, events))
    got = st.transition_guard_stream(stream(spark, events), str(tmp_path))
    assert want.count() > 0 and rows(got, *want.columns) == rows(want)


def test_guard_with_hot_runs(spark, events, hot):
    want = {r.event_id for r in st.transition_guard(batch(spark, events)).collect()}
    seen, bad = {}, set()
    for r in sorted(batch(spark, events).collect(), key=lambda r: (r.ts, r.event_id)):
        p = seen.get(r.run_id)
        if p is not None and p != r.status and (p, r.status) not in st.TRANSITIONS:
            bad.add(r.event_id)
        seen[r.run_id] = r.status
    assert want == bad


def test_log_stream_equals_batch(spark, events, tmp_path):
    msg = F.concat(F.lit("s "), F.col("status"))
    got = st.log_stream(stream(spark, events), str(tmp_path), msg)
    assert rows(got) == rows(st.log_append(batch(spark, events), msg))


def test_log_is_one_text(spark, events):
    one = st.log_append(batch(spark, events), F.lit("m")).filter("run_id = 0").first()
    lines = st.log_lines(batch(spark, events), F.lit("m")).filter("run_id = 0").orderBy("ts", "event_id").collect()
    assert "".join(r.line for r in lines) == one.log and len(lines) == one.lines
    assert one.log.startswith("[00:00:00] m\n[00:49:00] m\n")


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_window_stream_equals_batch(spark, events, tmp_path, slide):
    got = st.throughput_stream(stream(spark, events), str(tmp_path), "status", "progress", "1 hour", slide, delay="1 day")
    want = st.throughput_windows(batch(spark, events), "status", "progress", "1 hour", slide)
    assert rows(got, *want.columns) == rows(want)


def test_window_stream_drops_late_rows(spark, tmp_path):
    for i, (h, v) in enumerate([(0, 1.0), (5, 1.0), (0, 9.0)]):
        spark.sql(f"select timestamp_ntz'2024-01-01 0{h}:00:00' as ts, 'a' as k, {v}D as v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 1:
            st.throughput_stream(_raw(spark, tmp_path), str(tmp_path / "s"), "k", "v", "1 hour")
    got = st.throughput_stream(_raw(spark, tmp_path), str(tmp_path / "s"), "k", "v", "1 hour")
    assert sorted(r.total for r in got.collect()) == [1.0, 1.0]


def _raw(spark, tmp_path):
    return st.event_stream(spark, str(tmp_path / "in"), "ts timestamp_ntz, k string, v double", files_per_trigger=1)


def _status_files(spark, path, *files):
    for f in files:
        spark.createDataFrame(f, "run_id long, event_id long, ts string, status string").select(
            "run_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "status").coalesce(1).write.mode("append").parquet(path)
    return st.event_stream(spark, path, "run_id long, event_id long, ts timestamp_ntz, status string", files_per_trigger=1)


def test_late_event_takes_its_place(spark, tmp_path):
    """An event inside the watermark is judged where it belongs; one before it is dropped."""
    source = str(tmp_path / "in")
    s = _status_files(spark, source, [(1, 0, "2024-01-01 00:00:00", "queued")], [(1, 1, "2024-01-01 00:10:00", "running")],
                      [(1, 2, "2024-01-01 00:05:00", "completed")])
    got = st.transition_guard_stream(s, str(tmp_path / "s"), close=False)
    # the watermark stands at 0:00 now, so nothing after it is final
    assert rows(got) == []
    s = _status_files(spark, source, [(2, 3, "2024-01-01 00:30:00", "failed")], [(2, 5, "2024-01-01 00:31:00", "failed")],
                      [(1, 4, "2024-01-01 00:01:00", "running")])
    got = st.transition_guard_stream(s, str(tmp_path / "s"), close=False)
    assert rows(got, "event_id", "status", "previous") == [(1, "running", "completed"), (2, "completed", "queued")]
    got = st.transition_guard_stream(s, str(tmp_path / "s"))
    assert rows(got, "run_id", "event_id") == [(1, 1), (1, 2)]
    kept = spark.read.schema("run_id long, event_id long, ts timestamp_ntz, status string").parquet(source).filter("event_id <> 4")
    assert rows(st.transition_guard(kept), "run_id", "event_id") == [(1, 1), (1, 2)]


def test_guard_with_nulls_and_repeats(spark, tmp_path):
    s = _status_files(spark, str(tmp_path / "in"), [(1, 0, "2024-01-01 00:00:00", "completed"), (1, 0, "2024-01-01 00:00:00", "completed"),
                                                   (1, 1, "2024-01-01 00:00:01", None), (1, 2, "2024-01-01 00:00:02", "queued"), (1, 3, None, "failed"),
                                                   (None, 4, "2024-01-01 00:00:00", "failed"), (None, 5, "2024-01-01 00:00:00", "running")])
    got = st.transition_guard_stream(s, str(tmp_path / "s"))
    assert rows(got, "run_id", "event_id", "status", "previous") == [(None, 5, "running", "failed")]


def test_guard_calls_on_the_state_do_not_grow_with_the_events():
    """Each call is a round trip to the JVM."""
    def calls(n):
        seen = []

        class Handle:
            def __getattr__(self, name):
                return lambda *a: seen.append(name) or (Handle() if name.startswith("get") and a else None)

        guard = TransitionGuard([], "bigint")
        guard.init(Handle())
        seen.clear()
        assert list(guard.handleInputRows((1,), iter([Row(event_id=i, status="queued", us=i) for i in range(n)]), None)) == []
        return len(seen)
    assert calls(200) == calls(2) <= 4


def test_batch_table_keeps_few_files_and_survives_retries(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), ["k"], kept=4)
    log = BatchTable(spark, str(tmp_path / "a"), kept=4)
    schema = "k long, v string"
    empty = spark.createDataFrame([], schema)
    assert table.read(empty.schema).count() == 0
    for b in range(30):
        df = spark.createDataFrame([(b % 3, f"v{b}"), (10 + b % 2, None)], schema).coalesce(1)
        for _ in range(2 if b % 7 in (0, 1) else 1):  # some batches come twice, folded ones too
            table.write(df, b)
            log.write(df, b)
    assert rows(table.read(empty.schema)) == [(0, "v27"), (1, "v28"), (10, None), (11, None), (2, "v29")]
    assert log.read(empty.schema).count() == 60
    for t in ("t", "a"):
        assert len(list((tmp_path / t / "data").iterdir())) <= 2 * 4 + 2 and len(list((tmp_path / t / "log").glob("*.json"))) <= 2


def test_a_failed_batch_leaves_the_table_as_it_was(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), ["k"])
    df = spark.createDataFrame([(1, "old")], "k long, v string")
    table.write(df, 0)
    broken = df.select("k", F.when(F.col("k") == 1, F.raise_error(F.lit("lost"))).cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        table.write(broken, 1)
    assert rows(table.read(df.schema)) == [(1, "old")]
    table.write(df.withColumn("v", F.lit("new")), 1)
    assert rows(table.read(df.schema)) == [(1, "new")]


def test_closed_sessions_equal_batch(spark, events, tmp_path):
    got = st.session_stream(stream(spark, events), str(tmp_path), "run_id", "progress", "1 minute", close=True)
    want = st.session_throughput(batch(spark, events), "run_id", "progress", 60)
    assert rows(got, *want.columns) == rows(want)


def test_sessions(spark, events, tmp_path):
    e = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:09:59", 2.0), ("a", "2024-01-01 00:20:00", 4.0), ("b", "2024-01-01 00:00:00", 8.0)],
                              "k string, t string, v double").select("k", F.expr("cast(t as timestamp_ntz)").alias("ts"), "v")
    got = st.session_throughput(e, "k", "v", 600)
    assert rows(got, "k", "n", "total") == [("a", 1, 4.0), ("a", 2, 3.0), ("b", 1, 8.0)]
    # closed sessions of the stream are sessions of the batch form
    closed = st.session_stream(stream(spark, events), str(tmp_path), "run_id", "progress", "1 minute")
    whole = st.session_throughput(batch(spark, events), "run_id", "progress", 60)
    assert closed.count() > 0 and set(rows(closed, "run_id", "session_start", "n")) <= set(rows(whole, "run_id", "session_start", "n"))


def test_discovery_sees_each_file_once(spark, tmp_path):
    root, state = tmp_path / "tree", str(tmp_path / "state")
    (root / "a" / "b").mkdir(parents=True)
    (root / "a" / "b" / "x.json").write_text("[]")
    (root / "a" / "b" / "y.txt").write_text("no")
    assert st.discover_files(spark, str(root), state).count() == 1
    (root / "a" / "b" / "z.csv").write_text("a")
    names = [r.path.rsplit("/", 1)[1] for r in st.discover_files(spark, str(root), state).collect()]
    assert sorted(names) == ["x.json", "z.csv"]


def test_action_guard(spark):
    df = spark.createDataFrame([("start", "queued"), ("retry", "running"), ("delete", "running"), ("cancel", "failed")], "action string, status string")
    job = rows(st.action_guard(df, "job", F.col("action"), F.col("status")), "action", "allowed")
    project = rows(st.action_guard(df, "project", F.col("action"), F.col("status")), "action", "allowed")
    assert job == [("cancel", True), ("delete", False), ("retry", False), ("start", True)]
    assert project == [("cancel", False), ("delete", False), ("retry", False), ("start", False)]
