"""File sources on real trees, with the edge files of the loaders."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import files as src

from .conftest import rows


def put(base, rel, text):
    p = base / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_csv_rows_are_strings(spark, tmp_path):
    p = put(tmp_path, "a.csv", 'input,output\n1,x\n\n2\n3,"two\nlines"\n')
    df = src.csv_scan(spark, p)
    assert {t for _, t in df.dtypes} == {"string"}
    assert rows(df) == [("1", "x"), ("2", None), ("3", "two\nlines")]


def test_csv_empty_and_header_only(spark, tmp_path):
    with pytest.raises(ValueError, match="CSV file is empty"):
        src.csv_scan(spark, put(tmp_path, "e.csv", ""))
    df = src.csv_scan(spark, put(tmp_path, "h.csv", "a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0


def test_csv_line_count_counts_blank_lines(spark, tmp_path):
    p = put(tmp_path, "a.csv", "a\n1\n\n2\n")
    assert src.csv_line_counts(spark, p).first()["line_count"] == 3
    assert src.csv_scan(spark, p).count() == 2


@pytest.mark.parametrize("text", ["a,b\n1,x\n", "a,b\n1,\"two\nlines\"\n2,y", "a\n\n\n", "a", 'a,b\n"q ""in"" q\n",2\n3,4\n', 'a"b,c\n1"\n,2\n',
                                  '"h\n1",b\n1,2\n', 'a\n"open\nto the\nend', 'a,b\r\n"x\r\ny",1\r\n2,3\r\n', 'a\n"x"tail\n"y"\n'])
def test_csv_records_are_counted_as_a_reader_does(spark, tmp_path, text):
    (tmp_path / "a.csv").write_bytes(text.encode())
    want = max(0, sum(1 for _ in csv.reader(io.StringIO(text, newline=""))) - 1)
    assert [r.line_count for r in src.csv_line_counts(spark, str(tmp_path / "a.csv")).collect()] == [want]


def test_json_arrays_have_bounded_files(spark, tmp_path):
    df = spark.range(500).select("id", F.repeat(F.lit("é"), 40).alias("t")).coalesce(2)
    out = str(tmp_path / "out")
    src.write_json_array(df, out, 4000)
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) > 10 and max(f.stat().st_size for f in files) <= 4100
    assert rows(src.json_array_scan(spark, out, df.schema)) == rows(df) == rows(src.json_array_scan(spark, out).select("id", "t"))


@pytest.mark.parametrize("text", ['{"a": 1}', "[1]", "not json", '[{"a": 1}, 2]'])
def test_json_shape_errors_with_a_schema(spark, tmp_path, text):
    df = src.json_array_scan(spark, put(tmp_path, "a.json", text), T.StructType().add("a", T.IntegerType()))
    with pytest.raises(Exception, match="array of objects"):
        df.collect()


def test_json_column_order_is_the_first_objects(spark, tmp_path):
    p = put(tmp_path, "a.json", '[{"z": 1, "a": 2}, {"b": 3, "z": 4}]')
    df = src.json_array_scan(spark, p)
    assert df.columns == ["z", "a", "b"] and df.count() == 2


@pytest.mark.parametrize("text", ['{"not": "an array"}', "[1]", "not json", '"x"'])
def test_json_shape_errors(spark, tmp_path, text):
    with pytest.raises(ValueError, match="array of objects"):
        src.json_array_scan(spark, put(tmp_path, "a.json", text))


def test_json_empty_array(spark, tmp_path):
    df = src.json_array_scan(spark, put(tmp_path, "a.json", "[]"))
    assert df.columns == [] and df.count() == 0


def test_write_json_array_keeps_text_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä\n\"q\""), (2, None)], "id int, t string").coalesce(1)
    out = str(tmp_path / "out")
    src.write_json_array(df, out)
    part = next((tmp_path / "out").glob("part-*"))
    text = part.read_text(encoding="utf-8")
    assert "ä" in text and json.loads(text) == [{"id": 1, "t": "ä\n\"q\""}, {"id": 2, "t": None}]


def test_json_safe(spark):
    df = spark.sql("select X'41FF' as b, array(X'42') as l, date'2024-01-02' as d, 1.5D as x")
    r = src.json_safe(df).first()
    assert r["b"].startswith("A") and r["l"] == ["B"] and r["d"] == "2024-01-02" and r["x"] == 1.5


def test_import_rows_cut(spark):
    df = spark.range(100).select((F.col("id") * 3 + 5).alias("id"))
    assert rows(src.import_rows(df, "id", 10)) == sorted([(5 + 3 * i,) for i in range(10)], key=repr)
    assert src.import_rows(df, "id", 1000).count() == 100
    assert src.import_rows(df, "id", 0).count() == 0


def test_admit_files(spark, tmp_path):
    put(tmp_path, "a/x.csv", "a")
    put(tmp_path, "a/y.JSON", "[]" * 10)
    put(tmp_path, "a/z.txt", "no")
    got = src.admit_files(src.file_listing(spark, str(tmp_path)), max_bytes=10)
    by = {r["path"].rsplit("/", 1)[1]: (r["accepted"], r["reject_reason"]) for r in got.collect()}
    assert by == {"x.csv": (True, None), "y.JSON": (False, "file too large"), "z.txt": (False, "file type not allowed: .txt")}


def test_listing_reads_no_content(spark, tmp_path):
    put(tmp_path, "a.csv", "a")
    assert src.file_listing(spark, str(tmp_path)).columns == ["path", "length", "modified"]


def test_scan_datasets_tree(spark, tmp_path):
    for rel in ("org/set/a.json", "org/unknown/b.csv", "org/set/known.json", "org/set/bad.json", "models/m/c.json", "org/set/n.txt"):
        put(tmp_path, rel, "[]")
    base = src.file_listing(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^.*?" + tmp_path.name + "/", ""))
    known = spark.createDataFrame([("org/set/known.json",)], "path string")
    found = src.scan_datasets(base, known, ~F.col("path").contains("bad"))
    assert rows(found, "name", "status", "reason") == [
        ("b", "added", ""), ("set", "added", ""), ("set", "skipped", "known"), ("set", "skipped", "unparsable")]
    assert rows(src.scan_counts(found)) == [(4, 2, 2)]


def test_scan_models(spark):
    listing = spark.createDataFrame([
        ("o/m/config.json", 1), ("o/m/vocab.json", 2), ("o/half/config.json", 1), ("o/deep/sub/config.json", 1),
        ("o/deep/vocab.json", 1), ("job_1/m/config.json", 1), ("o/old/config.json", 1), ("o/old/tokenizer.model", 1)], "path string, length long")
    known = spark.createDataFrame([("o", "old")], "org string, model string")
    got = src.scan_models(listing, known)
    assert rows(got, "model", "valid", "is_new", "size_bytes") == [
        ("deep", False, False, 2), ("half", False, False, 1), ("m", True, True, 3), ("old", True, False, 2)]


def test_artifact_integrity(spark):
    f = spark.createDataFrame([
        ("good", "config.json", "{}"), ("good", "vocab.json", "x"), ("bad", "config.json", "{"), ("bad", "vocab.json", "{}"),
        ("none", "weights.bin", ""), ("index", "rag_config.json", "{}"), ("index", "documents.json", "[")],
        "dir string, name string, content string")
    got = {r["dir"]: r for r in src.artifact_integrity(f).collect()}
    assert got["good"]["valid"] and got["good"]["files_checked"] == ["config.json", "vocab.json"]
    assert got["bad"]["errors"] == ["Invalid JSON in config.json"]
    assert got["none"]["files_missing"] == ["config.json", "tokenizer files"]
    assert got["index"]["is_index"] and got["index"]["errors"] == [
        "Missing required file: vector_index.faiss", "Invalid JSON in documents.json"]


def test_profile_files(spark, tmp_path):
    put(tmp_path, "a.csv", "x,y\n1,2\n3,4\n")
    got = src.profile_files(src.csv_scan(spark, str(tmp_path)), "csv").first()
    assert (got["row_count"], got["column_count"], got["columns"], got["file_size"]) == (2, 2, '["x","y"]', 12)


def test_log_scans(spark, tmp_path):
    p = put(tmp_path, "app.log", "\n".join(["ERROR old"] + ["fine"] * 5 + ["job failed", "Traceback x", "no such table"]))
    lines = src.log_lines(spark, p)
    assert [r["line"] for r in src.scan_logs(lines, last=5).orderBy("hit").collect()] == ["job failed", "Traceback x"]
    assert [r["line"] for r in src.search_logs(lines, "FAILED").collect()] == ["job failed"]
    assert rows(src.classify_log_lines(lines)) == [("database", "no such table", 1)]


def test_json_array_with_an_empty_first_object_and_dotted_names(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{}, {"a.b": 1}, {"a.b": 2, "c": "x"}]')
    got = src.json_array_scan(spark, str(tmp_path / "a.json"))
    assert got.columns == ["a.b", "c"] and sorted(map(tuple, got.collect()), key=repr) == [(1, None), (2, "x"), (None, None)]
