"""Sources and sinks over the driver tables (SRC-1..12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..session import scratch_path
from ..sources import files as src
from ..tables import table
from .registry import query

FILES_SQL = """files AS (
SELECT doc_id, CASE WHEN source = 'src0' THEN 'models' ELSE source END AS author,
       CASE WHEN lang = 'en' THEN 'unknown' ELSE lang END AS dataset,
       'd' || doc_id || CASE lang WHEN 'en' THEN '.csv' WHEN 'de' THEN '.JSON' WHEN 'fr' THEN '.parquet' ELSE '.json' END AS file,
       n_chars * 20000 AS length, NOT contains(text, '###') AS parse_ok
FROM documents)"""


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents read as files of a tree ``{author}/{dataset}/{file}``."""
    ext = F.when(F.col("lang") == "en", ".csv").when(F.col("lang") == "de", ".JSON") \
        .when(F.col("lang") == "fr", ".parquet").otherwise(".json")
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.concat_ws("/", F.when(F.col("source") == "src0", "models").otherwise(F.col("source")),
                    F.when(F.col("lang") == "en", "unknown").otherwise(F.col("lang")),
                    F.concat(F.lit("d"), F.col("doc_id").cast("string"), ext)).alias("path"),
        (F.col("n_chars") * 20000).alias("length"), (~F.col("text").contains("###")).alias("parse_ok"))


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """One log per user; each event is a line."""
    e = F.col("event_type")
    text = F.when(e == "error", "ERROR 404 Not Found ").when(e == "purchase", "Failed to load model ") \
        .when(e == "signup", "Model not found ").otherwise(F.concat(F.lit("INFO "), e, F.lit(" ")))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), F.concat(text, F.col("props")).alias("line"))


LOG_SQL = """lines AS (
SELECT user_id AS log, event_id AS line_no,
       CASE event_type WHEN 'error' THEN 'ERROR 404 Not Found ' WHEN 'purchase' THEN 'Failed to load model '
            WHEN 'signup' THEN 'Model not found ' ELSE 'INFO ' || event_type || ' ' END || props AS line
FROM events)"""


@query("csv_scan", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_name || chr(10) || '"' || p_brand || '"' ELSE p_name END AS p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
       CAST(p_retailprice AS VARCHAR) AS p_retailprice, (SELECT count(*) FROM part) AS line_count
FROM part""")
def csv_scan(spark, sf):
    path = scratch_path(spark, "part-csv")
    broken = F.concat(F.col("p_name"), F.lit('\n"'), F.col("p_brand"), F.lit('"'))  # quotes and a line break in a field
    part = table(spark, sf, "part").withColumn("p_name", F.when(F.col("p_partkey") % 10 == 0, broken).otherwise(F.col("p_name")))
    part.write.option("header", True).option("escape", '"').csv(path)
    lines = src.csv_line_counts(spark, path).agg(F.sum("line_count").alias("n"))
    return src.csv_scan(spark, path).withColumn("line_count", lines.scalar())


@query("json_array_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_array_scan(spark, sf):
    path = scratch_path(spark, "documents-json")
    d = table(spark, sf, "documents")
    src.write_json_array(d, path, 1 << 20)
    return src.json_array_scan(spark, path, d.schema)


@query("json_lines_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_lines_scan(spark, sf):
    path = scratch_path(spark, "documents-jsonl")
    d = table(spark, sf, "documents")
    d.write.json(path)
    return src.json_lines_scan(spark, path, d.schema)


@query("admit_files", "WITH " + FILES_SQL + """
SELECT path, length, extension,
       extension IN ('.csv', '.json') AND length <= 104857600 AS accepted,
       CASE WHEN extension NOT IN ('.csv', '.json') THEN 'file type not allowed: ' || extension
            WHEN length > 104857600 THEN 'file too large' END AS reject_reason
FROM (SELECT author || '/' || dataset || '/' || file AS path, length,
             lower(regexp_extract(file, '(\\.[^.]*)$', 1)) AS extension FROM files)""")
def admit_files(spark, sf):
    return src.admit_files(doc_files(spark, sf).select("path", "length"))


@query("profile_dataset", """
SELECT source, lang, 'json' AS file_type, CAST(sum(strlen(text)) AS BIGINT) AS file_size, count(*) AS row_count,
       5 AS column_count, '["doc_id","text","lang","source","n_chars"]' AS columns
FROM documents GROUP BY source, lang""")
def profile_dataset(spark, sf):
    return src.profile_dataset(table(spark, sf, "documents"), ["source", "lang"], "json", F.octet_length("text"))


SCAN_SQL = "WITH " + FILES_SQL + """, found AS (
SELECT author || '/' || dataset || '/' || file AS path, author,
       CASE WHEN dataset IN ('unknown', '') THEN regexp_replace(file, '\\.[^.]*$', '') ELSE dataset END AS name,
       CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'known' WHEN NOT parse_ok THEN 'unparsable' ELSE '' END AS reason
FROM files WHERE author NOT IN ('models', 'archives') AND lower(regexp_extract(file, '(\\.[^.]*)$', 1)) IN ('.csv', '.json'))
"""


def _discover(spark: SparkSession, sf: str) -> DataFrame:
    files = doc_files(spark, sf)
    known = files.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("path")
    return src.scan_datasets(files, known, F.col("parse_ok"))


@query("scan_datasets", SCAN_SQL + """
SELECT path, author, name, CASE WHEN reason = '' THEN 'added' ELSE 'skipped' END AS status, reason FROM found""")
def scan_datasets(spark, sf):
    return _discover(spark, sf)


@query("scan_datasets_counts", SCAN_SQL + """
SELECT author, count(*) AS scanned, count(*) FILTER (reason = '') AS added, count(*) FILTER (reason <> '') AS skipped
FROM found GROUP BY author""")
def scan_datasets_counts(spark, sf):
    return src.scan_counts(_discover(spark, sf), ["author"])


@query("scan_models", """
WITH f AS (SELECT CASE WHEN p_brand LIKE 'Brand#1%' THEN 'job_' || p_brand ELSE p_brand END AS org, p_type AS model, p_size,
  CASE p_size % 7 WHEN 0 THEN 'config.json' WHEN 1 THEN 'tokenizer.json' ELSE 'weights-' || p_partkey || '.safetensors' END AS file,
  CAST(p_retailprice * 100 AS BIGINT) AS length FROM part),
d AS (SELECT org, model, CAST(sum(length) AS BIGINT) AS size_bytes, count(*) AS file_count,
  bool_or(file = 'config.json') AND bool_or(file = 'tokenizer.json') AS valid FROM f WHERE org NOT LIKE 'job_%' GROUP BY org, model)
SELECT org, model, size_bytes, file_count, valid,
  valid AND NOT EXISTS (SELECT 1 FROM f WHERE f.org = d.org AND f.model = d.model AND f.p_size > 45) AS is_new FROM d""")
def scan_models(spark, sf):
    s = F.col("p_size") % 7
    f = table(spark, sf, "part").select(
        F.when(F.col("p_brand").startswith("Brand#1"), F.concat(F.lit("job_"), F.col("p_brand")))
        .otherwise(F.col("p_brand")).alias("org"), F.col("p_type").alias("model"), "p_size",
        F.when(s == 0, "config.json").when(s == 1, "tokenizer.json").otherwise(
            F.concat(F.lit("weights-"), F.col("p_partkey").cast("string"), F.lit(".safetensors"))).alias("file"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("length"))
    listing = f.select(F.concat_ws("/", "org", "model", "file").alias("path"), "length")
    return src.scan_models(listing, f.filter("p_size > 45").select("org", "model"))


ARTIFACT_SQL = """
WITH raw AS (SELECT user_id, CASE event_type WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'rag_config.json' ELSE 'config.json' END
    WHEN 'click' THEN 'vector_index.faiss' WHEN 'purchase' THEN 'documents.json' WHEN 'signup' THEN 'tokenizer.json'
    ELSE 'embeddings_metadata.json' END AS name,
    CASE WHEN value < 5.0 THEN substr(props, 1, 5) ELSE props END AS content, event_id FROM events),
f AS (SELECT user_id, name, arg_max(content, event_id) AS content FROM raw GROUP BY user_id, name),
p AS (SELECT 'run' || user_id AS dir,
  bool_or(name = 'rag_config.json') AS h_rag, bool_or(name = 'config.json') AS h_cfg, bool_or(name = 'tokenizer.json') AS h_tok,
  bool_or(name = 'vector_index.faiss') AS h_vec, bool_or(name = 'documents.json') AS h_doc, bool_or(name = 'embeddings_metadata.json') AS h_meta,
  bool_or(name = 'rag_config.json' AND NOT json_valid(content)) AS b_rag, bool_or(name = 'config.json' AND NOT json_valid(content)) AS b_cfg,
  bool_or(name = 'documents.json' AND NOT json_valid(content)) AS b_doc,
  bool_or(name = 'embeddings_metadata.json' AND NOT json_valid(content)) AS b_meta
  FROM f GROUP BY user_id),
q AS (SELECT dir, h_rag AS is_index,
  list_filter(CASE WHEN h_rag THEN ['rag_config.json', 'vector_index.faiss', 'documents.json', CASE WHEN h_meta THEN 'embeddings_metadata.json' END]
    ELSE ['config.json', CASE WHEN h_tok THEN 'tokenizer.json' END] END, lambda x: x IS NOT NULL) AS files_checked,
  list_filter(CASE WHEN h_rag THEN [CASE WHEN NOT h_vec THEN 'vector_index.faiss' END, CASE WHEN NOT h_doc THEN 'documents.json' END]
    ELSE [CASE WHEN NOT h_cfg THEN 'config.json' END, CASE WHEN NOT h_tok THEN 'tokenizer files' END] END, lambda x: x IS NOT NULL) AS files_missing,
  list_filter(CASE WHEN h_rag THEN [CASE WHEN b_rag THEN 'Invalid JSON in rag_config.json' END, CASE WHEN b_doc THEN 'Invalid JSON in documents.json' END,
      CASE WHEN b_meta THEN 'Invalid JSON in embeddings_metadata.json' END]
    ELSE [CASE WHEN b_cfg THEN 'Invalid JSON in config.json' END] END, lambda x: x IS NOT NULL) AS broken FROM p)
SELECT dir, is_index, files_checked, files_missing,
  list_concat(list_transform(files_missing, lambda n: 'Missing required file: ' || n), broken) AS errors,
  len(files_missing) = 0 AND len(broken) = 0 AS valid FROM q"""


@query("artifact_integrity", ARTIFACT_SQL)
def artifact_integrity(spark, sf):
    e = F.col("event_type")
    name = F.when(e == "view", F.when(F.col("user_id") % 2 == 0, "rag_config.json").otherwise("config.json")) \
        .when(e == "click", "vector_index.faiss").when(e == "purchase", "documents.json") \
        .when(e == "signup", "tokenizer.json").otherwise("embeddings_metadata.json")
    f = table(spark, sf, "events").select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("dir"), name.alias("name"), "event_id",
        F.when(F.col("value") < 5.0, F.substring("props", 1, 5)).otherwise(F.col("props")).alias("content")) \
        .groupBy("dir", "name").agg(F.max_by("content", "event_id").alias("content"))
    return src.artifact_integrity(f)


@query("file_summary", "WITH " + FILES_SQL + """
SELECT author || '/' || dataset AS dir, file AS name, length,
       count(*) OVER (PARTITION BY author, dataset) AS file_count,
       CAST(sum(length) OVER (PARTITION BY author, dataset) AS BIGINT) AS total_size
FROM files""")
def file_summary(spark, sf):
    return src.file_summary(doc_files(spark, sf))


@query("import_rows", """
SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 1000000""")
def import_rows(spark, sf):
    return src.import_rows(table(spark, sf, "documents"), "doc_id", 1_000_000)


@query("import_rows_cut", """
SELECT doc_id, text, lang, source, n_chars FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= (SELECT count(*) // 2 FROM documents)""")
def import_rows_cut(spark, sf):
    """The loader's row limit, set to half of the rows."""
    d = table(spark, sf, "documents")
    return src.import_rows(d, "doc_id", d.count() // 2)


@query("catalog_search", """
SELECT id, downloads, author, name FROM (
  SELECT p_brand || '/' || p_name AS id, p_size * 100 + p_partkey % 100 AS downloads, p_brand AS author, p_name AS name, p_type AS tag
  FROM part WHERE contains(lower(p_brand || '/' || p_name), 'ring') ORDER BY downloads DESC, id LIMIT 50 OFFSET 10)
WHERE NOT contains(lower(tag), 'promo')""")
def catalog_search(spark, sf):
    p = table(spark, sf, "part").select(
        F.concat_ws("/", "p_brand", "p_name").alias("id"),
        (F.col("p_size") * 100 + F.col("p_partkey") % 100).alias("downloads"), F.split("p_type", " ").alias("tags"))
    from ..functions.names import split_repo_id
    hits = cat.catalog_search(p, "RING", 50, 10, "promo")
    return hits.withColumn("_r", split_repo_id(F.col("id"), "")).select("id", "downloads", "_r.author", "_r.name")


@query("relocate_catalog_paths", """
WITH f AS (SELECT doc_id, 'hf_' || source || '_' || lang || '_set_train.v' || doc_id || '.json' AS plain,
   CASE WHEN lang = 'en' THEN 'hf_' || source || '_' || lang || '_' || doc_id || '_train_x.json'
        ELSE 'file ' || doc_id || '?.json' END AS file, source, lang FROM documents)
SELECT 'in/' || file AS path, l.doc_id AS catalog_id,
  CASE WHEN l.doc_id IS NOT NULL THEN 'owner' || l.quality WHEN lang = 'en' THEN source ELSE 'user' END AS author,
  CASE WHEN l.doc_id IS NOT NULL THEN 'set_' || l.doc_id WHEN lang = 'en' THEN lang || '_' || f.doc_id
       ELSE 'file ' || f.doc_id || '_' END AS name,
  'store/' || CASE WHEN l.doc_id IS NOT NULL THEN 'owner' || l.quality WHEN lang = 'en' THEN source ELSE 'user' END || '/' ||
  CASE WHEN l.doc_id IS NOT NULL THEN 'set_' || l.doc_id WHEN lang = 'en' THEN lang || '_' || f.doc_id
       ELSE 'file ' || f.doc_id || '_' END || '/' || file AS new_path
FROM f LEFT JOIN labels l ON l.doc_id = f.doc_id""")
def relocate_catalog_paths(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("in/"), F.when(F.col("lang") == "en", F.concat(
            F.lit("hf_"), F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string")), F.lit("_train_x.json")))
            .otherwise(F.concat(F.lit("file "), F.col("doc_id").cast("string"), F.lit("?.json")))).alias("path"))
    known = d.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), "path", F.concat(F.lit("owner"), F.col("quality").cast("string")).alias("author"),
        F.concat(F.lit("set:"), F.col("doc_id").cast("string")).alias("name"))
    return src.relocate_catalog_paths(d.select("path"), known, "store")


@query("scan_logs", "WITH " + LOG_SQL + """,
tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log ORDER BY line_no DESC) AS b FROM lines) WHERE b <= 200)
SELECT log, line_no, line, hit FROM (
  SELECT log, line_no, line, row_number() OVER (PARTITION BY log ORDER BY line_no) AS hit FROM tail
  WHERE regexp_matches(line, 'ERROR|Error|Traceback|Exception|Failed|failed')) WHERE hit <= 50""")
def scan_logs(spark, sf):
    return src.scan_logs(run_log(spark, sf)).withColumn("hit", F.col("hit").cast("long"))


@query("scan_logs_search", "WITH " + LOG_SQL + """
SELECT log, line_no, line, back FROM (
  SELECT log, line_no, line, row_number() OVER (PARTITION BY log ORDER BY line_no DESC) AS back FROM lines
  WHERE contains(lower(line), 'model')) WHERE back <= 20""")
def scan_logs_search(spark, sf):
    return src.search_logs(run_log(spark, sf), "MODEL").withColumn("back", F.col("back").cast("long"))


@query("scan_logs_by_area", "WITH " + LOG_SQL + """
SELECT area, pattern, count(*) AS lines FROM lines JOIN (VALUES ('api', '404 Not Found'), ('frontend', '404'),
  ('model', 'Failed to load model'), ('model', 'Model not found')) t(area, pattern) ON contains(line, pattern)
GROUP BY area, pattern""")
def scan_logs_by_area(spark, sf):
    return src.classify_log_lines(run_log(spark, sf))
