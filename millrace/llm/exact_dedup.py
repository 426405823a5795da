"""Exact duplicates by recipes of content-defined chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .joins import without
from .text import lower_az

#: A chunk ends after white space before one of the letters b to h, once it has 512 characters, and at 4,096.
CHUNK = r"(?s:.{512,4095}?\s(?=[b-h]))|(?s:.{1,4096})"


def fingerprint(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 mark: Callable[[Column], Column] = fingerprint) -> DataFrame:
    """The group of each row whose texts are equal after A-Z are lower-cased.

    A text is cut where its content says so.  Each distinct chunk moves once, to verify that its
    fingerprint stands for this chunk alone; fingerprints of several chunks (``clash``) are told apart
    by a number.  Verified identifiers in order are the text's recipe, and only recipes are compared:
    8 bytes for some hundred of text.

    One row per input row: the key, ``keep_id`` (largest key of the group), ``group_size``, ``kept``
    (key = keep_id) and ``text_sha256`` of the normalised text.  A null text is the empty one.  Null
    keys are never the largest; a group with no other has keep_id null and all of it is kept.  Rows
    that repeat the kept key are kept too (``exact_dedup`` leaves one).  Other columns are not read.
    """
    norm = docs.select(F.col(key).alias("_key"), lower_az(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    cut = F.regexp_extract_all("_t", F.lit(CHUNK), F.lit(0))
    clash = materialise(
        norm.select(F.explode(cut).alias("c")).select(mark(F.col("c")).alias("fp"), "c").distinct()
        .groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp"))
    sha = F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256")
    if clash.isEmpty():
        recipes = norm.select("_key", sha, F.transform(cut, mark).alias("recipe"))
    else:
        recipes = _numbered(norm, cut, sha, clash, mark)
    recipes = materialise(recipes)
    # written, so that AQE may split a hot recipe in the join
    groups = materialise(recipes.groupBy("recipe").agg(F.max("_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return recipes.join(groups, "recipe").select(
        F.col("_key").alias(key), "keep_id", "group_size", F.col("_key").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")


def _numbered(norm: DataFrame, cut: Column, sha: Column, clash: DataFrame, mark: Callable[[Column], Column]) -> DataFrame:
    """Recipes where some fingerprints stand for several chunks: the identifier is the fingerprint
    and the chunk's number among those that share it."""
    rows = materialise(norm.select(F.monotonically_increasing_id().alias("_row"), "_key", sha, "_t"))
    chunks = rows.select("_row", F.posexplode(cut).alias("pos", "c")).withColumn("fp", mark(F.col("c")))
    shared = chunks.join(clash, "fp", "left_semi").select("fp", "c").distinct() \
        .withColumn("n", F.row_number().over(Window.partitionBy("fp").orderBy("c")))
    recipe = chunks.join(shared, ["fp", "c"], "left").groupBy("_row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "fp", F.coalesce("n", F.lit(0)).alias("n")))),
                    lambda x: F.struct(x["fp"].alias("fp"), x["n"].alias("n"))).alias("recipe"))
    empty = F.array().cast("array<struct<fp:bigint,n:int>>")
    return rows.select("_row", "_key", "text_sha256").join(recipe, "_row", "left") \
        .select("_key", "text_sha256", F.coalesce("recipe", empty).alias("recipe"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text.  Rows that repeat a key with equal texts count once;
    rows of one key with different texts are different documents."""
    groups = materialise(exact_groups(docs, key, text))
    sha = next(f"_sha{i}" for i in range(len(docs.columns) + 1) if f"_sha{i}" not in docs.columns)
    own = docs.withColumn(sha, F.sha2(lower_az(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256))
    gone = groups.filter("not kept").select(F.col(key).alias("_k"), F.col("text_sha256").alias("_s")).distinct()
    out = without(own, gone, lambda d, g: d[key].eqNullSafe(g["_k"]) & (d[sha] == g["_s"]))
    repeated = groups.filter("kept and group_size > 1").groupBy(key, "text_sha256").count().filter("count > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates([key, sha])
    return out.drop(sha)
