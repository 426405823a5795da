"""CSV, JSON and directory scans, admission, discovery and the row sink.

Directory operators take a listing frame (path, length, ...), so they work on
``file_listing`` of a real tree and on any table of files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import extension, file_name, file_stem, parse_dataset_filename, sanitize_name
from ..scale import first_per_key, order_statistics, with_group_stats

# Admission rules.
ALLOWED_EXTENSIONS = (".csv", ".json")
MAX_FILE_BYTES = 100 * 1024 * 1024
# Directories that hold no datasets, and required file names.
SKIPPED_AUTHORS = ("models", "archives")
TOKENIZER_FILES = ("tokenizer.json", "tokenizer_config.json", "tokenizer.model", "vocab.json")
INDEX_FILES = ("rag_config.json", "vector_index.faiss", "documents.json")
INDEX_OPTIONAL = "embeddings_metadata.json"
# Words that mark an error line.
ERROR_WORDS = ("ERROR", "Error", "Traceback", "Exception", "Failed", "failed")
# Known error texts by area.
ERROR_PATTERNS = (
    ("database", "duplicate column name"),
    ("database", "NOT NULL constraint failed"),
    ("database", "no such table"),
    ("api", "404 Not Found"),
    ("api", "500 Internal Server Error"),
    ("api", "400 Bad Request"),
    ("model", "'dict' object has no attribute 'model_type'"),
    ("model", "Model not found"),
    ("model", "Failed to load model"),
    ("frontend", "Cannot read properties of null"),
    ("frontend", "TypeError"),
    ("frontend", "404"),
)


ARRAY_BYTES = 64 << 20  # of a written JSON array file; more than the admission limit could not be read again


def csv_scan(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every field is a string, blank lines are dropped, short
    rows end in nulls.  Quoted line breaks make a file unsplittable, which the
    admission limit of 100 MiB per file bounds."""
    if spark.read.text(path).isEmpty():
        raise ValueError("CSV file is empty")
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def csv_line_counts(spark: SparkSession, path: str) -> DataFrame:
    """Records per file below the header, blank lines included (the catalog's count).  Line breaks in quoted fields
    begin no record; an open quote runs to the end.  A file is one value, as a quote may begin
    anywhere; the admission limit bounds it.  A file of no bytes has no row here."""
    quoted = r'(^|[,\r\n])"(?:[^"]++|"")*+(?:"|\z)'
    plain = F.regexp_replace("value", quoted, "$1")
    breaks = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
    rest = F.when((F.length("value") > 0) & ~F.col("value").endswith("\n"), 1).otherwise(0)
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.greatest(breaks + rest - 1, F.lit(0)).cast("long").alias("line_count"))


def json_array_names(spark: SparkSession, path: str) -> list[str]:
    """Check that each file is an array of objects; keys of the first object in file order."""
    whole = spark.read.text(path, wholetext=True)
    checked = whole.select(
        F.json_array_length("value").alias("n"),
        F.get_json_object("value", "$[0]").alias("first"),
        F.col("_metadata.file_path").alias("path"))
    bad = F.col("n").isNull() | ((F.col("n") > 0) & ~F.coalesce(F.col("first").startswith("{"), F.lit(False)))
    if not checked.filter(bad).isEmpty():
        raise ValueError("JSON must contain an array of objects")
    row = checked.filter("n > 0").agg(F.min_by(F.json_object_keys("first"), "path")).first()
    return row[0] or []


def json_array_scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of JSON array files, columns in the order of the first object (keys
    that appear only later follow).  With a schema the files are read once, and a file that is no array of objects is an error
    of the job that reads it; a value of another type is null."""
    if schema is not None:
        entries = F.from_json("value", T.ArrayType(schema))
        wrong = F.json_array_length("value").isNull() | F.exists(F.from_json("value", T.ArrayType(T.StringType())), lambda x: ~F.coalesce(x.startswith("{"), F.lit(False)))
        checked = F.when(wrong, F.raise_error(F.lit("JSON must contain an array of objects")).cast(T.ArrayType(schema))).otherwise(entries)
        return spark.read.text(path, wholetext=True).select(F.inline(checked))
    names = json_array_names(spark, path)
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(*[F.col(f"`{c}`") for c in [*[n for n in names if n in rows.columns], *[c for c in rows.columns if c not in names]]])


def json_lines_scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The splittable layout for large data: one object per line."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def _arrays(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Task function: rows joined to arrays of at most ``most`` bytes (one larger row is an array of its own)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        size, wrote = 0, False
        for b in batches:
            for v in b["value"]:
                n = len(v.encode()) + 2
                if held and size + n > most:
                    yield pd.DataFrame({"value": ["[" + ",\n".join(held) + "]"]})
                    held, size, wrote = [], 0, True
                held.append(v)
                size += n
        if held or not wrote:
            yield pd.DataFrame({"value": ["[" + ",\n".join(held) + "]"]})
    return run


def write_json_array(df: DataFrame, path: str, most: int = ARRAY_BYTES) -> None:
    """JSON array files of at most ``most`` bytes each, text not escaped to ASCII.  Rows stream through a task; it holds
    one file's at a time."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")) \
        .mapInPandas(_arrays(most), "value string").write.option("maxRecordsPerFile", 1).text(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Bytes as UTF-8 with replacement (also inside arrays), scalars JSON cannot hold as strings."""
    def safe(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.BinaryType):
            return F.make_valid_utf8(c.cast("string"))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: safe(x, t.elementType))
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[safe(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda k, v: safe(v, t.valueType))
        if isinstance(t, (T.NumericType, T.StringType, T.BooleanType, T.NullType)) and not isinstance(t, T.DecimalType):
            return c
        return c.cast("string")
    return df.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def import_rows(df: DataFrame, order: str, max_rows: int | None = None) -> DataFrame:
    """The first ``max_rows`` rows by a unique numeric column, made JSON-safe.
    The cut is a filter on the exact n-th value, not a global sort."""
    if max_rows is not None and df.count() > max_rows:
        cut = order_statistics(df, order, [max_rows - 1])[max_rows - 1] if max_rows > 0 else None
        df = df.filter(F.col(order) <= cut) if cut is not None else df.limit(0)
    return json_safe(df)


def file_listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Files below a directory as (path, length, modified); contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root).select("path", "length", F.col("modificationTime").alias("modified"))


def admit_files(listing: DataFrame, allowed: Sequence[str] = ALLOWED_EXTENSIONS,
                max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    ext = extension(F.col("path"))
    reason = F.when(~ext.isin(*allowed), F.concat(F.lit("file type not allowed: "), ext)) \
        .when(F.col("length") > max_bytes, "file too large")
    return listing.withColumn("extension", ext).withColumn("reject_reason", reason) \
        .withColumn("accepted", reason.isNull())


def profile_dataset(df: DataFrame, by: Sequence[str], file_type: str, size: Column,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """Catalog row per dataset: type, bytes, rows, columns and their names as JSON."""
    names = list(columns or df.columns)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.sum(size).alias("file_size")).select(
        *by, F.lit(file_type).alias("file_type"), "file_size", "row_count",
        F.lit(len(names)).alias("column_count"), F.to_json(F.array(*[F.lit(n) for n in names])).alias("columns"))


def profile_files(rows: DataFrame, file_type: str) -> DataFrame:
    """``profile_dataset`` for a scan of many files, one row per file."""
    names = rows.columns
    tagged = rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("_size"))
    per = tagged.groupBy("path").agg(F.count(F.lit(1)).alias("row_count"), F.first("_size").alias("file_size"))
    return per.select("path", F.lit(file_type).alias("file_type"), "file_size", "row_count",
                      F.lit(len(names)).alias("column_count"),
                      F.to_json(F.array(*[F.lit(n) for n in names])).alias("columns"))


def scan_datasets(listing: DataFrame, known: DataFrame, parse_ok: Column | None = None) -> DataFrame:
    """Incremental discovery below ``{root}/{author}/{dataset}/{file}``.

    Each admitted file gets a status: ``added``, or ``skipped`` with a reason
    (already known, or it does not parse).  Files of other types and skipped
    authors are not counted at all.  ``listing.path`` is relative to the root."""
    parts = F.split("path", "/")
    files = listing.withColumn("author", parts[0]) \
        .filter((F.size(parts) == 3) & ~F.col("author").isin(*SKIPPED_AUTHORS)
                & extension(F.col("path")).isin(*ALLOWED_EXTENSIONS)) \
        .withColumn("_ok", parse_ok if parse_ok is not None else F.lit(True))
    directory = parts[1]
    stem = file_stem(file_name(F.col("path")))
    files = files.withColumn("name", F.when(directory.isin("unknown", ""), stem).otherwise(directory))
    # one join decides both: a match is a known file (semi), no match a new one (anti)
    ids = known.select("path").distinct().withColumn("_known", F.lit(True))
    reason = F.when(F.col("_known"), "known").when(~F.col("_ok"), "unparsable").otherwise("")
    return files.join(ids, "path", "left").withColumn("reason", reason).select(
        "path", "author", "name", F.when(F.col("reason") == "", "added").otherwise("skipped").alias("status"), "reason")


def scan_counts(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "skipped").alias("skipped"))


def scan_models(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Model directories ``{org}/{model}`` with their size; valid ones not yet known are new."""
    parts = F.split("path", "/")
    name = file_name(F.col("path"))
    dirs = listing.filter((F.size(parts) >= 3) & ~F.col("path").startswith("job_")) \
        .groupBy(parts[0].alias("org"), parts[1].alias("model")).agg(
            F.bool_or((name == "config.json") & (F.size(parts) == 3)).alias("has_config"),
            F.bool_or(name.isin(*TOKENIZER_FILES) & (F.size(parts) == 3)).alias("has_tokenizer"),
            F.sum("length").alias("size_bytes"), F.count(F.lit(1)).alias("file_count"))
    valid = F.col("has_config") & F.col("has_tokenizer")
    seen = known.select("org", "model").distinct().withColumn("is_known", F.lit(True))
    return dirs.join(seen, ["org", "model"], "left").select(
        "org", "model", "size_bytes", "file_count", valid.alias("valid"),
        (valid & F.col("is_known").isNull()).alias("is_new"))


def artifact_integrity(files: DataFrame) -> DataFrame:
    """Required files per directory from (dir, name, content).

    Presence and JSON validity are folded per directory (map-side combined), so
    a directory of any size becomes one row; the file lists are fixed."""
    bad = F.try_parse_json("content").isNull()
    watched = ["config.json", *TOKENIZER_FILES, *INDEX_FILES, INDEX_OPTIONAL]
    parsed = ["config.json", "rag_config.json", "documents.json", INDEX_OPTIONAL]
    per = files.groupBy("dir").agg(
        *[F.bool_or(F.col("name") == n).alias(f"has:{n}") for n in watched],
        *[F.bool_or((F.col("name") == n) & bad).alias(f"bad:{n}") for n in parsed])

    def has(n: str) -> Column:
        return F.col(f"`has:{n}`")

    def named(cond: Column, text: str) -> Column:
        return F.when(cond, F.lit(text))

    is_index = has("rag_config.json")
    has_tok = has(TOKENIZER_FILES[0])
    for n in TOKENIZER_FILES[1:]:
        has_tok = has_tok | has(n)
    checked = F.when(is_index, F.array(*[F.lit(n) for n in INDEX_FILES], named(has(INDEX_OPTIONAL), INDEX_OPTIONAL))) \
        .otherwise(F.array(F.lit("config.json"), *[named(has(n), n) for n in TOKENIZER_FILES]))
    missing = F.when(is_index, F.array(*[named(~has(n), n) for n in INDEX_FILES])) \
        .otherwise(F.array(named(~has("config.json"), "config.json"), named(~has_tok, "tokenizer files")))
    broken = F.when(is_index, F.array(*[named(F.col(f"`bad:{n}`"), f"Invalid JSON in {n}") for n in parsed[1:]])) \
        .otherwise(F.array(named(F.col("`bad:config.json`"), "Invalid JSON in config.json")))
    out = per.select(
        "dir", is_index.alias("is_index"), F.array_compact(checked).alias("files_checked"),
        F.array_compact(missing).alias("files_missing"), F.array_compact(broken).alias("_broken"))
    return out.select(
        "dir", "is_index", "files_checked", "files_missing",
        F.concat(F.transform("files_missing", lambda n: F.concat(F.lit("Missing required file: "), n)),
                 F.col("_broken")).alias("errors"),
        ((F.size("files_missing") == 0) & (F.size("_broken") == 0)).alias("valid"))


def file_summary(listing: DataFrame) -> DataFrame:
    """Each file with its directory's file count and total size (long form: a
    directory may hold any number of files)."""
    d = listing.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
                       file_name(F.col("path")).alias("name"), "length")
    return with_group_stats(d, ["dir"], {"file_count": F.count(F.lit(1)), "total_size": F.sum("length")})


def relocate_catalog_paths(listing: DataFrame, catalog: DataFrame, root: str) -> DataFrame:
    """New ``{root}/{author}/{name}/{file}`` path per file; the catalog's name wins
    over the one in the file name, its path is to be updated."""
    parsed = parse_dataset_filename(file_name(F.col("path")))
    names = catalog.select("path", F.col("name").alias("_name"), F.col("author").alias("_author"),
                           F.col("id").alias("catalog_id"))
    j = listing.withColumn("_p", parsed).join(names, "path", "left")
    author = sanitize_name(F.coalesce(F.col("_author"), F.col("_p.author")))
    name = sanitize_name(F.coalesce(F.col("_name"), F.col("_p.name")))
    return j.select("path", "catalog_id", author.alias("author"), name.alias("name"),
                    F.concat_ws("/", F.lit(root), author, name, file_name(F.col("path"))).alias("new_path"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files as (log, line_no, line).  ``line_no`` orders lines within a file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log"),
        (F.col("_metadata.file_block_start") * F.lit(1 << 20)
         + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("line_no"),
        F.col("value").alias("line"))


def scan_logs(lines: DataFrame, last: int = 200, limit: int = 50) -> DataFrame:
    """Per log: among the last ``last`` lines the first ``limit`` that hold an error word."""
    tail = first_per_key(lines, ["log"], [F.col("line_no").desc()], last, "_back").drop("_back")
    hits = tail.filter(F.col("line").rlike("|".join(ERROR_WORDS)))
    return first_per_key(hits, ["log"], ["line_no"], limit, "hit")


def search_logs(lines: DataFrame, text: str, last: int = 20) -> DataFrame:
    """Per log the last ``last`` lines that contain the text in any case."""
    hits = lines.filter(F.lower("line").contains(text.lower()))
    return first_per_key(hits, ["log"], [F.col("line_no").desc()], last, "back")


def classify_log_lines(lines: DataFrame, patterns: Sequence[tuple[str, str]] = ERROR_PATTERNS) -> DataFrame:
    """Lines per known error text and area.  The fixed table becomes one array
    expression per line, so nothing is joined."""
    found = F.array_compact(F.array(*[
        F.when(F.col("line").contains(p), F.struct(F.lit(a).alias("area"), F.lit(p).alias("pattern")))
        for a, p in patterns]))
    return lines.select(F.explode(found).alias("m")).groupBy("m.area", "m.pattern").agg(
        F.count(F.lit(1)).alias("lines"))
