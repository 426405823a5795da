"""Catalog operators over the driver tables (REL-1..17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..tables import allocations, ctes, dataset_catalog, jobs, projects, run_events, table
from .registry import query

CONFIG_SQL = "config AS (SELECT 3 AS epochs, 0.05 AS dropout)"


def config(spark: SparkSession, sf: str) -> DataFrame:
    """The one-row settings table."""
    return spark.range(1).select(F.lit(3).alias("epochs"), F.lit(0.05).alias("dropout"))


@query("paginate", ctes("jobs") + """
SELECT id, status, created_at, dataset_id, amount, (SELECT count(*) FROM jobs) AS total,
       greatest(1, CAST(ceil((SELECT count(*) FROM jobs) / 20.0) AS BIGINT)) AS pages
FROM jobs ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40""")
def paginate(spark, sf):
    return cat.paginate(jobs(spark, sf), 3, 20)


@query("point_lookup", ctes("jobs") + "SELECT * FROM jobs WHERE id = 77")
def point_lookup(spark, sf):
    return cat.point_lookup(jobs(spark, sf), "id", 77)


UNIFIED_CTE = ctes("jobs", "projects") + """, p AS (
SELECT c.id, c.name, c.status, c.amount, TIMESTAMP '1995-06-01 00:00:00' + INTERVAL (c.id) DAY AS created_at,
       coalesce(f.ds, 0) AS dataset_id FROM projects c
LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS ds FROM orders GROUP BY o_custkey) f ON f.o_custkey = c.id),
runs AS (SELECT 'job' AS kind, id, status, created_at, dataset_id, amount, CAST(NULL AS VARCHAR) AS name,
  CAST(NULL AS INTEGER) AS epochs, CAST(NULL AS DOUBLE) AS dropout FROM jobs
UNION ALL SELECT 'project', id, status, created_at, dataset_id, amount, name, 3, 0.05 FROM p)
"""


def _unified(spark: SparkSession, sf: str, status: str | None = None) -> DataFrame:
    p = projects(spark, sf).withColumn("created_at", F.expr(
        "timestamp_ntz'1995-06-01 00:00:00' + make_dt_interval(cast(id as int))"))
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id")) \
        .agg(F.min("o_orderkey").alias("dataset_id"))
    return cat.unified_runs(jobs(spark, sf), p, first, config(spark, sf), status)


@query("unified_runs", UNIFIED_CTE + "SELECT * FROM runs")
def unified_runs(spark, sf):
    return _unified(spark, sf)


@query("unified_runs_page", UNIFIED_CTE + """
SELECT * FROM runs WHERE (kind = 'job' AND status = 'queued') OR (kind = 'project' AND status = 'pending')
ORDER BY created_at DESC, kind, id LIMIT 50 OFFSET 50""")
def unified_runs_page(spark, sf):
    return cat.newest_runs(_unified(spark, sf, "queued"), 2, 50)


@query("lookup_with_fallback", ctes("jobs", "projects") + """
SELECT i.id, CASE WHEN j.id IS NOT NULL THEN 'job' WHEN p.id IS NOT NULL THEN 'project' END AS kind,
       CASE WHEN j.id IS NOT NULL THEN j.status ELSE p.status END AS status,
       CASE WHEN j.id IS NOT NULL THEN j.amount ELSE p.amount END AS amount
FROM (SELECT DISTINCT l_partkey AS id FROM lineitem) i
LEFT JOIN (SELECT * FROM jobs WHERE status <> 'running') j ON j.id = i.id LEFT JOIN projects p ON p.id = i.id""")
def lookup_with_fallback(spark, sf):
    ids = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return cat.lookup_with_fallback(ids, jobs(spark, sf).filter("status <> 'running'"), projects(spark, sf), ["status", "amount"])


@query("status_counts", ctes("jobs") + """
SELECT 'all' AS scope, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'running') AS running,
       count(*) FILTER (status IN ('pending', 'queued')) AS pending FROM jobs
UNION ALL SELECT 'page', count(*) FILTER (status = 'completed'), count(*) FILTER (status = 'running'),
       count(*) FILTER (status IN ('pending', 'queued')) FROM (SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 10)""")
def status_counts(spark, sf):
    j = jobs(spark, sf)
    return cat.status_counts(j).withColumn("scope", F.lit("all")).unionByName(
        cat.status_counts(j, "page").withColumn("scope", F.lit("page")))


@query("default_fill", "WITH " + CONFIG_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       CASE WHEN l_discount IS NULL OR l_discount = 0 THEN (SELECT dropout FROM config) ELSE l_discount END AS dropout,
       CASE WHEN l_linenumber % 4 = 0 THEN (SELECT epochs FROM config) ELSE l_linenumber % 4 END AS epochs
FROM lineitem""")
def default_fill(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.col("l_discount").alias("dropout"), (F.col("l_linenumber") % 4).alias("epochs"))
    return cat.default_fill(li, config(spark, sf), ["dropout", "epochs"])


@query("range_checks", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  list_filter([CASE WHEN NOT l_quantity * 2 BETWEEN 1 AND 64 THEN 'batch_size' END,
    CASE WHEN NOT (l_discount - 0.02) BETWEEN 1e-6 AND 1 THEN 'learning_rate' END,
    CASE WHEN NOT (l_linenumber - 2) BETWEEN 1 AND 100 THEN 'epochs' END,
    CASE WHEN NOT l_tax BETWEEN 0 AND 1 THEN 'dropout' END,
    CASE WHEN NOT (l_extendedprice / 1000) BETWEEN 0 AND 100 THEN 'percentage' END,
    CASE WHEN NOT length(l_returnflag) BETWEEN 1 AND 255 THEN 'name' END], lambda x: x IS NOT NULL) AS failures
FROM lineitem""")
def range_checks(spark, sf):
    li = table(spark, sf, "lineitem")
    out = cat.range_checks(li, {
        "batch_size": F.col("l_quantity") * 2, "learning_rate": F.col("l_discount") - F.lit(0.02),
        "epochs": F.col("l_linenumber") - 2, "dropout": F.col("l_tax"),
        "percentage": F.col("l_extendedprice") / F.lit(1000)}, F.col("l_returnflag"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "failures")


@query("project_checks", """
WITH a AS (SELECT l_orderkey AS project_id, l_suppkey AS dataset_id,
  CASE l_returnflag WHEN 'R' THEN 'reasoning' WHEN 'A' THEN 'coding' ELSE CASE WHEN l_linestatus = 'O' THEN 'general_tools' ELSE 'vision' END END AS trait_type
  FROM lineitem),
listed AS (SELECT o_orderkey AS project_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'reasoning' WHEN '2' THEN 'general_tools' ELSE 'coding' END AS trait_type
  FROM orders),
p AS (SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 11 > 0 THEN o_orderpriority END AS name, 'm' AS base_model,
  CASE WHEN o_totalprice > 20000 THEN o_orderstatus END AS training_type, 'out' AS output_directory FROM orders),
known AS (SELECT s_suppkey AS dataset_id FROM supplier WHERE s_acctbal > 0),
t AS (SELECT project_id, trait_type, count(*) AS found FROM a GROUP BY ALL
  UNION ALL SELECT project_id, trait_type, 0 FROM listed WHERE (project_id, trait_type) NOT IN (SELECT (project_id, trait_type) FROM a)),
d AS (SELECT project_id, dataset_id, count(*) AS found FROM a GROUP BY ALL)
SELECT project_id, 'unknown_trait' AS rule, trait_type AS item, found FROM t WHERE trait_type = 'vision'
UNION ALL SELECT project_id, 'trait_needs_exactly_one', trait_type, found FROM t WHERE trait_type IN ('reasoning', 'coding') AND found <> 1
UNION ALL SELECT project_id, 'trait_needs_at_least_one', trait_type, found FROM t WHERE trait_type = 'general_tools' AND found = 0
UNION ALL SELECT project_id, 'allocation_repeated', trait_type || '/' || dataset_id, count(*) FROM a GROUP BY project_id, trait_type, dataset_id HAVING count(*) > 1
UNION ALL SELECT project_id, 'dataset_used_twice', CAST(dataset_id AS VARCHAR), found FROM d WHERE found > 1
UNION ALL SELECT project_id, 'dataset_missing', CAST(dataset_id AS VARCHAR), found FROM d WHERE dataset_id NOT IN (SELECT dataset_id FROM known)
UNION ALL SELECT project_id, 'field_missing', 'name', 0 FROM p WHERE name IS NULL
UNION ALL SELECT project_id, 'field_missing', 'training_type', 0 FROM p WHERE training_type IS NULL""")
def project_checks(spark, sf):
    f = F.col("l_returnflag")
    a = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.col("l_suppkey").alias("dataset_id"),
        F.when(f == "R", "reasoning").when(f == "A", "coding")
        .when(F.col("l_linestatus") == "O", "general_tools").otherwise("vision").alias("trait_type"))
    o = table(spark, sf, "orders").withColumn("project_id", F.col("o_orderkey"))
    first = F.substring("o_orderpriority", 1, 1)
    listed = o.select("project_id", F.when(first == "1", "reasoning").when(first == "2", "general_tools").otherwise("coding").alias("trait_type"))
    p = o.select("project_id", F.when(F.col("project_id") % 11 > 0, F.col("o_orderpriority")).alias("name"), F.lit("m").alias("base_model"),
                 F.when(F.col("o_totalprice") > 20000, F.col("o_orderstatus")).alias("training_type"), F.lit("out").alias("output_directory"))
    known = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("dataset_id"))
    return cat.project_checks(p, listed, a, known)


@query("allocate_rows", ctes("dataset_catalog", "allocations") + """
SELECT project_id, dataset_id, CAST(sum(CAST(trunc(row_count * percentage / 100.0) AS BIGINT)) AS BIGINT) AS rows
FROM allocations JOIN dataset_catalog USING (dataset_id) GROUP BY project_id, dataset_id""")
def allocate_rows(spark, sf):
    c = dataset_catalog(spark, sf)
    return cat.allocate_rows(allocations(c), c)


@query("project_total_rows", ctes("dataset_catalog", "allocations") + """
SELECT project_id, CAST(coalesce(sum(floor(c.row_count * percentage / 100.0)), 0) AS BIGINT) AS total_rows
FROM allocations a LEFT JOIN (SELECT * FROM dataset_catalog WHERE n_chars > row_count * 1500) c ON c.dataset_id = a.dataset_id
GROUP BY project_id""")
def project_total_rows(spark, sf):
    c = dataset_catalog(spark, sf)
    return cat.project_total_rows(allocations(c), c.filter("n_chars > row_count * 1500"))


@query("patch_rows", """
WITH u AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS seg, arg_max(o_totalprice, o_orderkey) AS bal,
  arg_max(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN st = 'F' THEN CASE WHEN seg LIKE '1%' THEN NULL ELSE seg END ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN st = 'P' THEN bal ELSE c_acctbal END AS c_acctbal
FROM customer LEFT JOIN u ON c_custkey = o_custkey""")
def patch_rows(spark, sf):
    upd = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("at"),
        F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("c_mktsegment"),
        (F.col("o_orderstatus") == "F").alias("has_c_mktsegment"),
        F.col("o_totalprice").alias("c_acctbal"), (F.col("o_orderstatus") == "P").alias("has_c_acctbal"))
    base = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return cat.patch_rows(base, upd, "c_custkey", ["c_mktsegment", "c_acctbal"], "at")


@query("patch_rows_null_keeps", """
WITH u AS (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -1 END, o_orderkey) AS bal
  FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN bal >= 0 THEN bal ELSE c_acctbal END AS c_acctbal
FROM customer LEFT JOIN u ON c_custkey = o_custkey""")
def patch_rows_null_keeps(spark, sf):
    upd = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("c_acctbal"))
    return cat.patch_rows(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), upd, "c_custkey",
                          ["c_acctbal"], "at", null_keeps=True)


def _sides(left: dict, keys: dict, refused) -> DataFrame:
    """Rows left per table and id, and the refused ids."""
    out = refused.select(F.lit("refused").alias("side"), F.col("id").cast("long").alias("id"), F.lit(1).cast("long").alias("n"))
    for name, rows in left.items():
        out = out.unionByName(rows.groupBy(F.lit(name).alias("side"), F.col(keys[name]).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    return out


_REACH = """
reach AS (SELECT id AS root, '{root}' AS side, id FROM wanted
  UNION SELECT r.root, e.side, e.id FROM reach r JOIN edges e ON e.parent_side = r.side AND e.parent = r.id),
refused AS (SELECT DISTINCT root FROM reach WHERE {blocked}),
gone AS (SELECT DISTINCT side, id FROM reach WHERE root NOT IN (SELECT root FROM refused))
SELECT 'refused' AS side, CAST(root AS BIGINT) AS id, 1 AS n FROM refused
UNION ALL SELECT side, CAST(id AS BIGINT), count(*) FROM rows_ WHERE (side, id) NOT IN (SELECT (side, id) FROM gone) GROUP BY side, id"""


@query("cascade_delete", ctes("projects").replace("WITH", "WITH RECURSIVE", 1) + """, wanted AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 480000),
edges AS (SELECT 'project' AS parent_side, o_custkey AS parent, 'trait' AS side, o_orderkey AS id FROM orders
  UNION ALL SELECT 'trait', l_orderkey, 'allocation', l_orderkey FROM lineitem),
rows_ AS (SELECT 'project' AS side, id FROM projects UNION ALL SELECT 'trait', o_orderkey FROM orders UNION ALL SELECT 'allocation', l_orderkey FROM lineitem),"""
       + _REACH.format(root="project", blocked="side = 'project' AND id IN (SELECT id FROM projects WHERE status = 'running')"))
def cascade_delete(spark, sf):
    """Projects with their traits and the traits' allocations."""
    o = table(spark, sf, "orders")
    wanted = o.filter("o_totalprice > 480000").select(F.col("o_custkey").alias("id"))
    tables = {"project": projects(spark, sf), "trait": o.select("o_orderkey", "o_custkey"), "allocation": table(spark, sf, "lineitem").select("l_orderkey")}
    keys = {"project": "id", "trait": "o_orderkey", "allocation": "l_orderkey"}
    links = [cat.ForeignKey("trait", "o_custkey", "project"), cat.ForeignKey("allocation", "l_orderkey", "trait")]
    left, refused = cat.cascade_delete(tables, keys, links, "project", wanted, {"project": F.col("status") == "running"})
    return _sides(left, keys, refused)


@query("cascade_delete_datasets", ctes("jobs").replace("WITH", "WITH RECURSIVE", 1) + """, wanted AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 2000),
edges AS (SELECT 'dataset' AS parent_side, dataset_id AS parent, 'job' AS side, id FROM jobs
  UNION ALL SELECT 'dataset', l_suppkey, 'allocation', l_suppkey FROM lineitem
  UNION ALL SELECT 'job', user_id, 'log', event_id FROM events),
rows_ AS (SELECT 'dataset' AS side, c_custkey AS id FROM customer UNION ALL SELECT 'job', id FROM jobs
  UNION ALL SELECT 'allocation', l_suppkey FROM lineitem UNION ALL SELECT 'log', event_id FROM events),"""
       + _REACH.format(root="dataset", blocked="side = 'job' AND id IN (SELECT id FROM jobs WHERE status = 'queued')"))
def cascade_delete_datasets(spark, sf):
    """Datasets with their jobs, the jobs' logs, and their allocations; a queued job holds its dataset."""
    tables = {"dataset": table(spark, sf, "customer").select("c_custkey"), "job": jobs(spark, sf).select("id", "dataset_id", "status"),
              "allocation": table(spark, sf, "lineitem").select("l_suppkey"), "log": table(spark, sf, "events").select("event_id", "user_id")}
    keys = {"dataset": "c_custkey", "job": "id", "allocation": "l_suppkey", "log": "event_id"}
    links = [cat.ForeignKey("job", "dataset_id", "dataset"), cat.ForeignKey("allocation", "l_suppkey", "dataset"), cat.ForeignKey("log", "user_id", "job")]
    wanted = table(spark, sf, "customer").filter("c_acctbal < 2000").select(F.col("c_custkey").alias("id"))
    left, refused = cat.cascade_delete(tables, keys, links, "dataset", wanted, {"job": F.col("status") == "queued"})
    return _sides(left, keys, refused)


@query("find_orphans", ctes("jobs") + """
SELECT id, dataset_id FROM jobs WHERE status = 'queued'
AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey FROM lineitem WHERE l_tax > 0.07)""")
def find_orphans(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "id")
    return cat.find_orphans(jobs(spark, sf), li.filter("l_returnflag = 'R'"), li.filter("l_tax > 0.07")).select("id", "dataset_id")


@query("pool_status", ctes("run_events") + """, w AS (
SELECT CASE arg_max(status, event_id) WHEN 'failed' THEN 'stopped' WHEN 'running' THEN 'busy' ELSE 'idle' END AS status
FROM run_events GROUP BY run_id)
SELECT count(*) AS total, count(*) FILTER (status <> 'stopped') AS active, count(*) FILTER (status = 'idle') AS idle,
       count(*) FILTER (status = 'busy') AS busy FROM w""")
def pool_status(spark, sf):
    latest = run_events(table(spark, sf, "events")).groupBy("run_id").agg(F.max_by("status", "event_id").alias("s"))
    w = latest.select(F.when(F.col("s") == "failed", "stopped").when(F.col("s") == "running", "busy")
                      .otherwise("idle").alias("status"))
    return cat.pool_status(w)


@query("evolve_schema", """
SELECT o_orderkey, o_totalprice, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'unset' ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN NULL ELSE o_orderstatus END AS o_orderstatus
FROM orders""")
def evolve_schema(spark, sf):
    o = table(spark, sf, "orders")
    is_old = F.col("o_orderdate") < F.expr("timestamp_ntz'1997-01-01'")
    return cat.evolve_schema(
        o.filter(is_old).select("o_orderkey", "o_totalprice"),
        o.filter(~is_old).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"),
        {"o_orderpriority": "unset"})


@query("run_report", """
WITH r AS (SELECT event_id, value, CASE WHEN event_type <> 'signup' THEN ts END AS started_at,
   CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 5000 SECOND END AS completed_at,
   CASE WHEN event_type = 'error' THEN 0.0 ELSE least(value, 100.0) END AS progress FROM events),
s AS (SELECT *, epoch_us(TIMESTAMP '2024-02-01 00:00:00') / 1000000.0 AS now_s, epoch_us(started_at) / 1000000.0 AS start_s,
   epoch_us(coalesce(completed_at, TIMESTAMP '2024-02-01 00:00:00')) / 1000000.0 AS end_s FROM r),
t AS (SELECT *, CAST(floor(end_s - start_s) AS BIGINT) AS duration_s, now_s - start_s AS e,
   started_at IS NOT NULL AND progress > 0 AND now_s > start_s AS live FROM s)
SELECT event_id, duration_s,
  CASE WHEN started_at IS NULL THEN '-' WHEN duration_s < 60 THEN duration_s || 's'
       WHEN duration_s < 3600 THEN (duration_s // 60) || 'm ' || (duration_s % 60) || 's'
       ELSE (duration_s // 3600) || 'h ' || ((duration_s % 3600) // 60) || 'm' END AS duration,
  round(CASE WHEN live THEN progress / e END, 9) AS progress_per_second,
  round(CASE WHEN live THEN e / (progress / 100.0) END, 3) AS estimated_total_s,
  round(CASE WHEN live THEN e / (progress / 100.0) - e END, 3) AS estimated_remaining_s,
  CASE WHEN started_at IS NOT NULL AND progress > 0 THEN CAST(floor(floor(e) / progress * (100.0 - progress)) AS BIGINT) END AS remaining_whole_s,
  round(CASE WHEN live THEN value / e END, 9) AS rows_per_second
FROM t""")
def run_report(spark, sf):
    e = F.col("event_type")
    r = table(spark, sf, "events").select(
        "event_id", "value", F.when(e != "signup", F.col("ts")).alias("started_at"),
        F.when(e == "purchase", F.expr("ts + interval 5000 seconds")).alias("completed_at"),
        F.when(e == "error", 0.0).otherwise(F.least("value", F.lit(100.0))).alias("progress"))
    out = cat.run_report(r, F.expr("timestamp_ntz'2024-02-01 00:00:00'"), "value")
    return out.select("event_id", "duration_s", "duration", F.round("progress_per_second", 9).alias("progress_per_second"),
                      F.round("estimated_total_s", 3).alias("estimated_total_s"),
                      F.round("estimated_remaining_s", 3).alias("estimated_remaining_s"), "remaining_whole_s",
                      F.round("rows_per_second", 9).alias("rows_per_second"))


@query("run_report_sizes", """
WITH s AS (SELECT doc_id, n_chars * n_chars AS bytes FROM documents)
SELECT doc_id, bytes, CASE WHEN bytes = 0 THEN '0 Bytes'
  ELSE regexp_replace(printf('%.2f', bytes / pow(1024, CASE WHEN bytes < 1024 THEN 0 WHEN bytes < 1048576 THEN 1 WHEN bytes < 1073741824 THEN 2 ELSE 3 END)), '\\.?0+$', '')
    || ' ' || CASE WHEN bytes < 1024 THEN 'Bytes' WHEN bytes < 1048576 THEN 'KB' WHEN bytes < 1073741824 THEN 'MB' ELSE 'GB' END END AS size
FROM s""")
def run_report_sizes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") * F.col("n_chars")).alias("bytes"))
    return cat.with_size_text(d, "bytes", "size")


@query("compatible_types", """
WITH m AS (SELECT DISTINCT p_type AS type, p_brand AS class FROM part),
c AS (SELECT type, min(class) AS class FROM m GROUP BY type),
l AS (SELECT class, list(type ORDER BY type) AS types FROM m GROUP BY class)
SELECT p_partkey, CASE WHEN p_size < 48 THEN p_type END AS detected, CASE WHEN p_size < 48 THEN types END AS types,
       CASE WHEN p_size < 48 THEN p_type END AS recommended,
       CASE WHEN p_size >= 48 THEN 'model_type not found' END AS error
FROM part JOIN c ON c.type = p_type JOIN l ON l.class = c.class""")
def compatible_types(spark, sf):
    p = table(spark, sf, "part")
    cfg = p.select("p_partkey", F.when(F.col("p_size") < 48, F.to_json(F.struct(F.col("p_type").alias("model_type"))))
                   .otherwise(F.lit('{"other": 1}')).alias("content"))
    mapping = p.select(F.col("p_type").alias("type"), F.col("p_brand").alias("class"))
    return cat.compatible_types(cfg, mapping).select("p_partkey", "detected", "types", "recommended", "error")


