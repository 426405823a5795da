"""Catalog operators: pages, lookups, unions, checks, allocation and run reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import format_bytes, format_duration
from ..scale import SMALL_ROWS, join_on_keys
from ..session import materialise

# Trait, least and most datasets (null: no limit).
TRAIT_RULES = (("reasoning", 1, 1), ("coding", 1, 1), ("general_tools", 1, None))
# Fields that a project must have.
PROJECT_FIELDS = ("name", "base_model", "training_type", "output_directory")
# Accepted ranges of run parameters.
RANGES = {
    "batch_size": (1, 64),
    "learning_rate": (1e-6, 1),
    "epochs": (1, 100),
    "lora_r": (1, 256),
    "lora_alpha": (1, 512),
    "dropout": (0, 1),
    "progress": (0, 100),
    "percentage": (0, 100),
}
NAME_LENGTH = (1, 255)


def paginate(df: DataFrame, page: int, size: int, created: str = "created_at", key: str = "id") -> DataFrame:
    """One page, newest first, with the total and the page count on each row.
    Sort, offset and limit become one distributed top-k."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = df.orderBy(F.col(created).desc(), F.col(key).desc()).offset((page - 1) * size).limit(size)
    return rows.withColumn("total", total).withColumn("pages", F.greatest(
        F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("long"))


def page_after(df: DataFrame, size: int, created_at, last_id, created: str = "created_at", key: str = "id") -> DataFrame:
    """The next page after a known row: a filter replaces the offset, so deep
    pages cost no more than the first."""
    c, k = F.col(created), F.col(key)
    return df.filter((c < F.lit(created_at)) | ((c == F.lit(created_at)) & (k < F.lit(last_id)))) \
        .orderBy(c.desc(), k.desc()).limit(size)


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def unified_runs(jobs: DataFrame, projects: DataFrame, first_dataset: DataFrame, config: DataFrame,
                 status: str | None = None) -> DataFrame:
    """Jobs and projects in one list.  A project takes the dataset of its first
    allocation (0 if none) and its parameters from the one-row config.  The
    project side of a status filter reads ``queued`` as ``pending``."""
    if status is not None:
        jobs = jobs.filter(F.col("status") == status)
        projects = projects.filter(F.col("status") == ("pending" if status == "queued" else status))
    cfg = config.select(F.struct(*config.columns)).scalar()
    p = projects.join(first_dataset.select(F.col("project_id").alias("id"), "dataset_id"), "id", "left") \
        .withColumn("dataset_id", F.coalesce("dataset_id", F.lit(0))).withColumn("_c", cfg)
    p = p.select("*", *[F.col("_c")[c].alias(c) for c in config.columns]).drop("_c")
    return jobs.withColumn("kind", F.lit("job")).unionByName(
        p.withColumn("kind", F.lit("project")), allowMissingColumns=True)


def newest_runs(runs: DataFrame, page: int, size: int) -> DataFrame:
    """A page of the unified list: newest first, jobs before projects on ties."""
    return runs.orderBy(F.col("created_at").desc(), "kind", "id").offset((page - 1) * size).limit(size)


def lookup_with_fallback(ids: DataFrame, jobs: DataFrame, projects: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each id with its job, or else its project (ids overlap, the job wins)."""
    j = jobs.select("id", *[F.col(c).alias(f"j_{c}") for c in cols], F.lit(True).alias("j_found"))
    p = projects.select("id", *[F.col(c).alias(f"p_{c}") for c in cols], F.lit(True).alias("p_found"))
    both = ids.select("id").distinct().join(j, "id", "left").join(p, "id", "left")
    kind = F.when(F.col("j_found"), "job").when(F.col("p_found"), "project")
    return both.select("id", kind.alias("kind"), *[
        F.when(F.col("j_found"), F.col(f"j_{c}")).otherwise(F.col(f"p_{c}")).alias(c) for c in cols])


def status_counts(runs: DataFrame, scope: str = "all", page_size: int = 10) -> DataFrame:
    """Dashboard counters over all runs, or over the newest page as the page shows them."""
    if scope == "page":
        runs = runs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(page_size)
    s = F.col("status")
    return runs.agg(F.count_if(s == "completed").alias("completed"), F.count_if(s == "running").alias("running"),
                    F.count_if(s.isin("pending", "queued")).alias("pending"))


def default_fill(df: DataFrame, config: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null and zero both fall back to the config value."""
    with_cfg = df.withColumn("_c", config.select(F.struct(*cols)).scalar())
    for c in cols:
        with_cfg = with_cfg.withColumn(c, F.when(F.col(c).isNull() | (F.col(c) == 0), F.col("_c")[c]).otherwise(F.col(c)))
    return with_cfg.drop("_c")


def range_checks(df: DataFrame, fields: Mapping[str, Column], name: Column | None = None) -> DataFrame:
    """``failures``: names of the fields outside their range (null counts as absent)."""
    tests = [F.when(~c.between(*RANGES[f]), F.lit(f)) for f, c in fields.items()]
    if name is not None:
        tests.append(F.when(~F.length(name).between(*NAME_LENGTH), F.lit("name")))
    return df.withColumn("failures", F.array_compact(F.array(*tests)))


def project_checks(projects: DataFrame, traits: DataFrame, allocs: DataFrame, datasets: DataFrame,
                   fields: Sequence[str] = PROJECT_FIELDS) -> DataFrame:
    """Violations as (project_id, rule, item, found).

    Rules: a required field is null; a trait is unknown or has too few or too many datasets, none included; a dataset
    is used twice in a project, or comes twice in one trait, or is not known.  ``traits`` lists the traits of each project; one
    that only ``allocs`` names counts as listed.  Percentages need not sum to 100.  Every rule pre-aggregates on its own key."""
    spark = projects.sparkSession
    one = F.count(F.lit(1)).alias("found")
    keys = ["project_id", "trait_type"]
    counts = traits.select(*keys, F.lit(0).alias("n")).unionByName(allocs.select(*keys, F.lit(1).alias("n"))) \
        .groupBy(*keys).agg(F.sum("n").alias("found"))
    rules = spark.createDataFrame(TRAIT_RULES, "trait_type string, least int, most int")  # a fixed, short list
    judged = counts.join(F.broadcast(rules), "trait_type", "left")
    found = F.col("found")
    rule = F.when(F.col("least").isNull(), "unknown_trait") \
        .when((F.col("least") == F.col("most")) & (found != F.col("least")), "trait_needs_exactly_one") \
        .when(found < F.col("least"), "trait_needs_at_least_one").when(found > F.col("most"), "trait_has_too_many")
    arity = judged.withColumn("rule", rule).filter("rule IS NOT NULL").select("project_id", "rule", F.col("trait_type").alias("item"), "found")
    dataset = F.col("dataset_id").cast("string")
    repeated = allocs.groupBy(*keys, "dataset_id").agg(one).filter("found > 1").select(
        "project_id", F.lit("allocation_repeated").alias("rule"), F.concat_ws("/", "trait_type", dataset).alias("item"), "found")
    used = allocs.groupBy("project_id", "dataset_id").agg(one)
    twice = used.filter("found > 1").select("project_id", F.lit("dataset_used_twice").alias("rule"), dataset.alias("item"), "found")
    missing = join_on_keys(used, datasets.select("dataset_id").distinct(), ["dataset_id"], "left_anti").select(
        "project_id", F.lit("dataset_missing").alias("rule"), dataset.alias("item"), "found")
    absent = projects.select("project_id", F.explode(F.array_compact(F.array(
        *[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))).alias("item")) \
        .select("project_id", F.lit("field_missing").alias("rule"), "item", F.lit(0).cast("long").alias("found"))
    return reduce(DataFrame.unionByName, [arity, repeated, twice, missing, absent])


def allocation_rows(row_count: Column, percentage: Column) -> Column:
    """Rows of one allocation, truncated."""
    return (row_count * percentage / F.lit(100.0)).cast("long")


def allocate_rows(allocs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows per dataset of each project, summed over its traits."""
    return allocs.join(catalog.select("dataset_id", "row_count"), "dataset_id") \
        .groupBy("project_id", "dataset_id") \
        .agg(F.sum(allocation_rows(F.col("row_count"), F.col("percentage"))).alias("rows"))


def project_total_rows(allocs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows per project over the datasets that are known."""
    rows = F.floor(F.col("row_count") * F.col("percentage") / F.lit(100.0))
    return allocs.join(catalog.select("dataset_id", "row_count"), "dataset_id", "left") \
        .groupBy("project_id").agg(F.coalesce(F.sum(rows), F.lit(0)).alias("total_rows"))


def patch_rows(df: DataFrame, updates: DataFrame, key: str, cols: Sequence[str], at: str, null_keeps: bool = False) -> DataFrame:
    """Apply the latest update per key.

    An update row carries ``has_<col>`` flags: a present field overwrites, also
    with null.  With ``null_keeps`` a null leaves the old value."""
    latest = updates.groupBy(key).agg(F.max_by(
        F.struct(*[c for c in updates.columns if c not in (key, at)]), at).alias("_u"))
    j = df.join(latest, key, "left")
    for c in cols:
        if null_keeps:
            new = F.coalesce(F.col("_u")[c], F.col(c))
        else:
            new = F.when(F.col("_u")[f"has_{c}"], F.col("_u")[c]).otherwise(F.col(c))
        j = j.withColumn(c, new)
    return j.drop("_u")


def empty_list_to_null(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


@dataclass(frozen=True)
class ForeignKey:
    """Rows of ``child`` go with the row of ``parent`` whose key is in their ``column``."""

    child: str
    column: str
    parent: str


def _meet(rows: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Join with a written list of ids, broadcast if it is short (it is counted); else rows are dealt by their number."""
    return rows.join(F.broadcast(ids), on, how) if ids.count() <= SMALL_ROWS else join_on_keys(rows, ids, [on], how)


def cascade_closure(tables: Mapping[str, DataFrame], keys: Mapping[str, str], links: Sequence[ForeignKey], root: str,
                    wanted: DataFrame) -> dict[str, DataFrame]:
    """All rows that go with the wanted rows of ``root``: per table (root, id), a row for each root that reaches it.

    Level by level along the foreign keys until a level adds nothing, so chains of any depth and tables that refer to
    themselves or to each other end too.  Each level is a written table; only ids move."""
    start = tables[root].select(F.col(keys[root]).alias("id")).filter("id IS NOT NULL").distinct() \
        .join(wanted.select(F.col(wanted.columns[0]).alias("id")).distinct(), "id", "left_semi")
    start = materialise(start.select(F.col("id").alias("root"), "id"))
    reached: dict[str, list[DataFrame]] = {root: [start]}
    frontier = {root: start}
    while frontier:
        found: dict[str, list[DataFrame]] = {}
        for link in links:
            if link.parent in frontier:
                own = tables[link.child].select(F.col(link.column).alias("parent"), F.col(keys[link.child]).alias("id"))
                parents = frontier[link.parent].select("root", F.col("id").alias("parent"))
                found.setdefault(link.child, []).append(_meet(own, parents, "parent", "inner").select("root", "id"))
        frontier = {}
        for name, parts in found.items():
            new = reduce(DataFrame.union, parts).distinct()
            for seen in reached.get(name, []):
                new = new.join(seen, ["root", "id"], "left_anti")
            new = materialise(new)
            if not new.isEmpty():
                frontier[name] = new
                reached.setdefault(name, []).append(new)
    return {name: reduce(DataFrame.union, parts) for name, parts in reached.items()}


def cascade_delete(tables: Mapping[str, DataFrame], keys: Mapping[str, str], links: Sequence[ForeignKey], root: str, wanted: DataFrame,
                   blocked: Mapping[str, Column]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete rows of ``root`` with all that depends on them.

    A wanted row is refused, and nothing goes with it, if it or anything that would go is ``blocked`` (a condition per table).
    Returns the rows left of each table and the ids refused (``id``).  A row that two roots reach goes if one of them does.  Rows
    with a null foreign key stay."""
    reached = cascade_closure(tables, keys, links, root, wanted)
    held = [join_on_keys(reached[name], tables[name].filter(condition).select(F.col(keys[name]).alias("id")), ["id"], "left_semi").select("root")
            for name, condition in blocked.items() if name in reached]
    refused = materialise(reduce(DataFrame.union, held).distinct()) if held else tables[root].sparkSession.createDataFrame(
        [], reached[root].select("root").schema)
    left = dict(tables)
    for name, rows in reached.items():
        gone = materialise(_meet(rows, refused, "root", "left_anti").select(F.col("id").alias(keys[name])).distinct())
        left[name] = _meet(tables[name], gone, keys[name], "left_anti")
    return left, refused.select(F.col("root").alias("id"))


def find_orphans(jobs: DataFrame, *held: DataFrame) -> DataFrame:
    """Queued jobs in none of the id sets (each a frame with ``id``)."""
    ids = held[0].select("id")
    for h in held[1:]:
        ids = ids.union(h.select("id"))
    return jobs.filter(F.col("status") == "queued").join(ids.distinct(), "id", "left_anti")


def pool_status(workers: DataFrame) -> DataFrame:
    s = F.col("status")
    return workers.agg(F.count(F.lit(1)).alias("total"), F.count_if(s != "stopped").alias("active"),
                       F.count_if(s == "idle").alias("idle"), F.count_if(s == "busy").alias("busy"))


def evolve_schema(old: DataFrame, new: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Old and new rows under the wider schema; old rows get the defaults."""
    filled = old
    for c, v in defaults.items():
        if c not in old.columns:
            filled = filled.withColumn(c, F.lit(v))
    return filled.unionByName(new, allowMissingColumns=True)


def run_report(runs: DataFrame, now: Column, rows_done: str | None = None) -> DataFrame:
    """Duration, speed and remaining time of (started_at, completed_at, progress) rows."""
    def secs(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)

    started, progress = F.col("started_at"), F.col("progress")
    end = F.coalesce(F.col("completed_at"), now)
    elapsed = secs(now) - secs(started)
    live = started.isNotNull() & (progress > 0) & (elapsed > 0)
    duration = F.floor(secs(end) - secs(started)).cast("long")
    total = elapsed / (progress / F.lit(100.0))
    whole = F.floor(elapsed)
    out = runs.select(
        "*", duration.alias("duration_s"),
        F.when(started.isNull(), "-").otherwise(format_duration(duration)).alias("duration"),
        F.when(live, elapsed).alias("elapsed_s"),
        F.when(live, progress / elapsed).alias("progress_per_second"),
        F.when(live, total).alias("estimated_total_s"),
        F.when(live, total - elapsed).alias("estimated_remaining_s"),
        F.when(started.isNotNull() & (progress > 0),
               F.floor(whole / progress * (F.lit(100.0) - progress)).cast("long")).alias("remaining_whole_s"))
    if rows_done is not None:
        out = out.withColumn("rows_per_second", F.when(live, F.col(rows_done) / elapsed))
    return out


def with_size_text(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.withColumn(name, format_bytes(F.col(col)))


def compatible_types(configs: DataFrame, mapping: DataFrame, path: str = "$.model_type") -> DataFrame:
    """All types of the class of each config's detected type, sorted, and the
    recommended one.  The mapping (type, class) is grouped once per class."""
    detected = configs.withColumn("detected", F.get_json_object("content", path))
    pairs = mapping.select("type", "class").distinct()
    lists = pairs.groupBy("class").agg(F.sort_array(F.collect_set("type")).alias("types"))
    per_type = pairs.groupBy("type").agg(F.min("class").alias("class")).join(lists, "class") \
        .select(F.col("type").alias("detected"), "types")
    j = join_on_keys(detected, per_type, ["detected"])
    return j.withColumn("recommended", F.when(F.array_contains("types", F.col("detected")), F.col("detected"))
                        .otherwise(F.try_element_at("types", F.lit(1)))) \
        .withColumn("error", F.when(F.col("detected").isNull(), "model_type not found"))


def catalog_search(df: DataFrame, q: str, limit: int, offset: int = 0, banned_tag: str = "gguf") -> DataFrame:
    """Search by id, most downloads first; rows with a banned tag are dropped
    after the limit, so pages can be short."""
    hits = df.filter(F.lower("id").contains(q.lower())).orderBy(F.col("downloads").desc(), "id") \
        .offset(offset).limit(limit)
    return hits.filter(~F.exists("tags", lambda t: F.lower(t).contains(banned_tag)))


def filter_names(df: DataFrame, col: str, typed: str) -> DataFrame:
    return df.filter(F.lower(col).contains(typed.lower()))
