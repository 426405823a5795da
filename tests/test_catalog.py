"""Catalog operators on hand-computed rows."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import catalog as cat
from millrace.scale import TASK_ROWS_KEY

from .conftest import rows


def test_paginate_empty_has_one_page(spark):
    df = spark.createDataFrame([], "id int, created_at timestamp_ntz")
    assert cat.paginate(df, 1, 10).count() == 0
    full = spark.range(5).select("id", F.expr("timestamp_ntz'2024-01-01'").alias("created_at"))
    got = cat.paginate(full, 2, 2).collect()
    assert [(r.id, r.total, r.pages) for r in got] == [(2, 5, 3), (1, 5, 3)]


def test_page_after_equals_offset(spark):
    df = spark.range(9).select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 3 as int))").alias("created_at"))
    first = cat.paginate(df, 1, 4).collect()
    want = [r.id for r in cat.paginate(df, 2, 4).collect()]
    assert [r.id for r in cat.page_after(df, 4, first[-1].created_at, first[-1].id).collect()] == want


def test_unified_runs(spark):
    jobs = spark.sql("select 1 as id, 'queued' as status, timestamp_ntz'2024-01-01' as created_at, 7 as dataset_id")
    projects = spark.sql("select * from values (1, 'pending'), (2, 'running') as t(id, status)") \
        .withColumn("created_at", F.expr("timestamp_ntz'2024-01-01'"))
    first = spark.sql("select 2 as project_id, 5 as dataset_id")
    cfg = spark.sql("select 3 as epochs")
    got = cat.unified_runs(jobs, projects, first, cfg)
    assert rows(got, "kind", "id", "dataset_id", "epochs") == [("job", 1, 7, None), ("project", 1, 0, 3), ("project", 2, 5, 3)]
    assert [r.kind for r in cat.newest_runs(got, 1, 3).collect()] == ["job", "project", "project"]
    assert rows(cat.unified_runs(jobs, projects, first, cfg, "queued"), "kind", "id") == [("job", 1), ("project", 1)]


def test_lookup_job_wins(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    jobs = spark.createDataFrame([(1, "j")], "id int, s string")
    projects = spark.createDataFrame([(1, "p"), (2, "p")], "id int, s string")
    assert rows(cat.lookup_with_fallback(ids, jobs, projects, ["s"])) == [(1, "job", "j"), (2, "project", "p"), (3, None, None)]


def test_default_fill_zero_is_missing(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None), (3, 0.2)], "id int, dropout double")
    got = cat.default_fill(df, spark.sql("select 0.05D as dropout"), ["dropout"])
    assert rows(got) == [(1, 0.05), (2, 0.05), (3, 0.2)]


def test_range_checks(spark):
    df = spark.createDataFrame([(64, 1e-7, "x"), (65, 0.5, ""), (None, 1.0, "n" * 256)], "b int, lr double, n string")
    got = cat.range_checks(df, {"batch_size": F.col("b"), "learning_rate": F.col("lr")}, F.col("n")).select("failures").collect()
    assert [r[0] for r in got] == [["learning_rate"], ["batch_size", "name"], ["name"]]


def test_project_checks(spark):
    allocs = spark.createDataFrame([
        (1, "reasoning", 1, 50.0), (1, "reasoning", 2, 20.0), (1, "general_tools", 1, 5.0), (2, "odd", 9, 1.0), (3, "coding", 2, 10.0),
        (5, "general_tools", 1, 1.0), (5, "general_tools", 1, 2.0)],
        "project_id int, trait_type string, dataset_id int, percentage double")
    traits = spark.createDataFrame([(1, "reasoning"), (1, "general_tools"), (3, "coding"), (4, "reasoning"), (4, "general_tools"), (4, "else")],
                                   "project_id int, trait_type string")
    projects = spark.createDataFrame([(1, "a", "m", "t", "o"), (4, None, "m", "t", None)],
                                     "project_id int, name string, base_model string, training_type string, output_directory string")
    known = spark.createDataFrame([(1,), (2,)], "dataset_id int")
    got = cat.project_checks(projects, traits, allocs, known)
    assert rows(got) == [
        (1, "dataset_used_twice", "1", 2), (1, "trait_needs_exactly_one", "reasoning", 2), (2, "dataset_missing", "9", 1),
        (2, "unknown_trait", "odd", 1), (4, "field_missing", "name", 0), (4, "field_missing", "output_directory", 0),
        (4, "trait_needs_at_least_one", "general_tools", 0), (4, "trait_needs_exactly_one", "reasoning", 0), (4, "unknown_trait", "else", 0),
        (5, "allocation_repeated", "general_tools/1", 2), (5, "dataset_used_twice", "1", 2)]
    assert cat.project_checks(projects.limit(0), traits.limit(0), allocs.limit(0), known).count() == 0


def test_allocation_truncates(spark):
    allocs = spark.createDataFrame([(1, 1, 33.33), (1, 1, 100.0), (1, 2, 0.0), (1, 9, 50.0)], "project_id int, dataset_id int, percentage double")
    catalog = spark.createDataFrame([(1, 7), (2, 10)], "dataset_id int, row_count long")
    assert rows(cat.allocate_rows(allocs, catalog)) == [(1, 1, 9), (1, 2, 0)]
    assert rows(cat.project_total_rows(allocs, catalog)) == [(1, 9)]


def test_patch_rows(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    upd = spark.createDataFrame([(1, 1, "old", True, 5, True), (1, 2, None, True, 9, False)],
                                "id int, at int, s string, has_s boolean, n int, has_n boolean")
    assert rows(cat.patch_rows(base, upd, "id", ["s", "n"], "at")) == [(1, None, 1), (2, "b", 2)]
    assert rows(cat.patch_rows(base, upd, "id", ["s", "n"], "at", null_keeps=True)) == [(1, "a", 9), (2, "b", 2)]
    assert spark.range(1).select(cat.empty_list_to_null(F.array())).first()[0] is None


def _forest(spark):
    tables = {
        "project": spark.createDataFrame([(1, "done"), (2, "running"), (3, "done"), (4, "done")], "id int, status string"),
        "trait": spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, 4), (50, None)], "tid int, pid int"),
        # 400 belongs to traits of two projects through its own parent, 401 to none
        "item": spark.createDataFrame([(100, 10, None, "ok"), (300, 30, None, "ok"), (400, 40, None, "ok"), (401, None, 400, "ok"), (402, None, 401, "busy"),
                                       (301, None, 300, "ok"), (500, None, None, "ok")], "iid int, tid int, up int, state string")}
    links = [cat.ForeignKey("trait", "pid", "project"), cat.ForeignKey("item", "tid", "trait"), cat.ForeignKey("item", "up", "item")]
    return tables, {"project": "id", "trait": "tid", "item": "iid"}, links


def test_cascade_delete_reaches_all_levels(spark):
    tables, keys, links = _forest(spark)
    wanted = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,), (None,)], "id int")
    blocked = {"project": F.col("status") == "running", "item": F.col("state") == "busy"}
    left, refused = cat.cascade_delete(tables, keys, links, "project", wanted, blocked)
    # 2 runs, 4 has a busy row three levels below
    assert rows(refused) == [(2,), (4,)]
    assert rows(left["project"], "id") == [(2,), (4,)] and rows(left["trait"], "tid") == [(20,), (40,), (50,)]
    assert rows(left["item"], "iid") == [(400,), (401,), (402,), (500,)]
    left, refused = cat.cascade_delete(tables, keys, links, "project", wanted, {})
    assert refused.count() == 0 and rows(left["item"], "iid") == [(500,)] and rows(left["trait"], "tid") == [(50,)]


def test_cascade_ends_on_cycles_and_without_rows(spark):
    loop = {"n": spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, None)], "id int, up int")}
    link = [cat.ForeignKey("n", "up", "n")]
    left, _ = cat.cascade_delete(loop, {"n": "id"}, link, "n", spark.createDataFrame([(1,)], "id int"), {})
    assert rows(left["n"], "id") == [(4,), (5,)]
    left, refused = cat.cascade_delete(loop, {"n": "id"}, link, "n", spark.createDataFrame([], "id int"), {"n": F.col("id") > 0})
    assert left["n"].count() == 5 and refused.count() == 0


def test_find_orphans_and_pool(spark):
    jobs = spark.createDataFrame([(1, "queued"), (2, "queued"), (3, "running")], "id int, status string")
    held = spark.createDataFrame([(2,)], "id int")
    assert rows(cat.find_orphans(jobs, held, held), "id") == [(1,)]
    w = spark.createDataFrame([("idle",), ("busy",), ("busy",), ("stopped",)], "status string")
    assert rows(cat.pool_status(w)) == [(4, 3, 1, 2)]


def test_status_counts_scope(spark):
    df = spark.range(12).select("id", F.expr("timestamp_ntz'2024-01-01'").alias("created_at"), F.when(F.col("id") < 2, "completed").otherwise("pending").alias("status"))
    assert rows(cat.status_counts(df)) == [(2, 0, 10)] and rows(cat.status_counts(df, "page")) == [(0, 0, 10)]


def test_evolve_schema(spark):
    got = cat.evolve_schema(spark.sql("select 1 as id"), spark.sql("select 2 as id, 'x' as tag, 5 as n"), {"tag": "unset"})
    assert rows(got, "id", "tag", "n") == [(1, "unset", None), (2, "x", 5)]


def test_run_report_edges(spark):
    df = spark.sql("""select * from values
        (1, timestamp_ntz'2024-01-01 00:00:00', cast(null as timestamp_ntz), 50.0D), (2, cast(null as timestamp_ntz), null, 10.0D),
        (3, timestamp_ntz'2024-01-01 00:00:00', null, 0.0D), (4, timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:01:01', 100.0D)
        as t(id, started_at, completed_at, progress)""")
    got = {r.id: r for r in cat.run_report(df, F.expr("timestamp_ntz'2024-01-01 00:10:00'")).collect()}
    assert (got[1].duration, got[1].estimated_total_s, got[1].estimated_remaining_s, got[1].remaining_whole_s) == ("10m 0s", 1200.0, 600.0, 600)
    assert got[2].duration == "-" and got[2].elapsed_s is None
    assert got[3].progress_per_second is None and got[3].remaining_whole_s is None
    assert got[4].duration == "1m 1s"


def test_compatible_types(spark):
    cfg = spark.createDataFrame([(1, '{"model_type": "b"}'), (2, "{}"), (3, '{"model_type": "zz"}')], "id int, content string")
    m = spark.createDataFrame([("b", "C"), ("a", "C"), ("x", "D")], "type string, class string")
    got = {r.id: r for r in cat.compatible_types(cfg, m).collect()}
    assert got[1].types == ["a", "b"] and got[1].recommended == "b"
    assert got[2].error == "model_type not found" and got[3].types is None


def test_catalog_search_short_page(spark):
    df = spark.createDataFrame([("o/Alpha", 5, ["gguf-q4"]), ("o/alpine", 4, ["x"]), ("o/beta", 9, [])], "id string, downloads int, tags array<string>")
    assert rows(cat.catalog_search(df, "ALP", 2), "id") == [("o/alpine",)]
    assert rows(cat.filter_names(df, "id", "BET"), "id") == [("o/beta",)]


def test_point_lookup_is_pushed_down(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    got = cat.point_lookup(spark.read.parquet(str(tmp_path / "t")), "id", 7)
    assert "EqualTo(id,7)" in got._jdf.queryExecution().executedPlan().toString() and got.count() == 1


@pytest.mark.parametrize("bad", ["page2", ""])
def test_unknown_scope_is_all(spark, bad):
    df = spark.sql("select 1 as id, 'running' as status, timestamp_ntz'2024-01-01' as created_at")
    assert rows(cat.status_counts(df, bad)) == [(0, 1, 0)]


def test_cascade_delete_deals_rows_by_their_number(spark, monkeypatch):
    """Lists too long to broadcast: a task's part of the rows does not grow with the table."""
    monkeypatch.setattr(cat, "SMALL_ROWS", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(TASK_ROWS_KEY, "50")
    try:
        tables = {"p": spark.range(1500).selectExpr("id", "id % 9 = 0 AS held"), "c": spark.range(3000).selectExpr("id", "if(id % 100 = 99, null, id % 1500) AS p")}
        left, refused = cat.cascade_delete(tables, {"p": "id", "c": "id"}, [cat.ForeignKey("c", "p", "p")], "p",
                                           spark.range(0, 1500, 3).toDF("id"), {"p": F.col("held")})
        parts = left["c"].groupBy(F.spark_partition_id().alias("part")).count().collect()
        assert len(parts) > 40 and max(r["count"] for r in parts) < 150
        gone = {i for i in range(0, 1500, 3) if i % 9}
        assert {r.id for r in refused.collect()} == set(range(0, 1500, 9))
        assert {r.id for r in left["p"].collect()} == set(range(1500)) - gone
        assert {r.id for r in left["c"].collect()} == {i for i in range(3000) if i % 100 == 99 or i % 1500 not in gone}
    finally:
        spark.conf.unset(TASK_ROWS_KEY)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
