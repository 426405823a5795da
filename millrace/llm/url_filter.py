"""URL verdicts by rules and, where none fits, by the labelled purity of path templates."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

DEPTH = 4  # levels of the tree; what lies deeper is one segment "**"
SHARE = 0.02  # a segment stays literal with this share of its parent's pages ...
SUPPORT = 3  # ... and so many pages
SIMILAR = 1.96  # branches within so many standard errors of their pooled rate are merged
EVIDENCE = 3  # labelled pages that a branch needs to be compared or rejected
STRENGTH = 5.0  # pseudo-pages at the rate of all hosts
REJECT = 0.8  # smoothed share of blocked pages


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0),
                       string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of (verdict, "host/path") whose host is the page's or a parent domain of it and whose
    path begins the page's, and its verdict; null where none fits.  The first wins among equally long ones."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(reversed(rules), key=lambda x: len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _literals(rows: DataFrame, level: int) -> DataFrame:
    """Replace the segments of ``level`` that are rare below their parent by ``*``."""
    here = F.col("tpl")[level - 1]
    seen = rows.filter(F.size("tpl") >= level).groupBy(
        "host", F.slice("tpl", 1, level - 1).alias("_up"), here.alias("_seg")).agg(F.sum("n").alias("_n"))
    # a parent has one row for each distinct segment: sums first, then the few that can be literal
    total = seen.groupBy("host", "_up").agg(F.sum("_n").alias("_all"))
    keep = seen.filter(F.col("_n") >= SUPPORT).join(total, ["host", "_up"]) \
        .filter(F.col("_n") >= F.col("_all") * F.lit(SHARE)).select("host", "_up", "_seg", F.lit(True).alias("_keep"))
    out = rows.withColumn("_up", F.slice("tpl", 1, level - 1)).withColumn("_seg", F.get("tpl", F.lit(level - 1))) \
        .join(keep, ["host", "_up", "_seg"], "left")
    put = F.transform("tpl", lambda x, i: F.when((i == level - 1) & F.col("_keep").isNull() & (x != "**"), F.lit("*")).otherwise(x))
    return out.withColumn("tpl", put).drop("_up", "_seg", "_keep")


def _merged(tree: DataFrame, level: int) -> DataFrame:
    """Give the children of a node that are statistically alike the common name ``~`` (column ``merged``).
    Windows hold templates, not pages: at most 1 / SHARE children for each node."""
    child = Window.partitionBy("host", F.slice("merged", 1, level))
    parent = Window.partitionBy("host", F.slice("merged", 1, level - 1))
    node = tree.withColumn("_n", F.sum("labelled").over(child)).withColumn("_b", F.sum("blocked").over(child)) \
        .withColumn("_seen", (F.size("merged") >= level) & (F.col("_n") >= EVIDENCE))
    node = node.withColumn("_rate", (F.sum(F.when(F.col("_seen"), F.col("blocked"))).over(parent) + F.lit(1.0))
                           / (F.sum(F.when(F.col("_seen"), F.col("labelled"))).over(parent) + F.lit(2.0)))
    z = F.abs(F.col("_b") - F.col("_n") * F.col("_rate")) / F.sqrt(F.col("_n") * F.col("_rate") * (F.lit(1.0) - F.col("_rate")))
    alike = F.coalesce(F.col("_seen") & (z <= SIMILAR), F.lit(False))
    put = F.transform("merged", lambda x, i: F.when((i == level - 1) & F.col("_alike"), F.lit("~")).otherwise(x))
    return node.withColumn("_alike", alike).withColumn("merged", put).drop("_n", "_b", "_seen", "_rate", "_alike")


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict of every page by rule or, where no rule fits, by its path template.

    The pages with a rule are the labelled ones.  Per host a tree of path segments is grown: level by level,
    segments that are rare below their parent become ``*`` (``SHARE``, ``SUPPORT``), segments below ``DEPTH``
    become one ``**``.  From the leaves up, sibling branches with ``EVIDENCE`` labels whose blocked shares do not
    differ from their pooled share (``SIMILAR``) become one branch ``~`` and share their labels.  A template
    is rejected when it has ``EVIDENCE`` labels and its blocked share, smoothed by ``STRENGTH`` pages at the rate of all
    hosts, reaches ``REJECT``; branches without labels are allowed.

    One row per page: the key, host, path, rule, verdict, template, purity (smoothed share of pages not
    blocked).  A null url, or one without ``://``, has an empty host and path.  Pages are counted by path
    before anything is shuffled by host, so a host with most pages moves as counts; rows that repeat a
    key stay.  Other columns are not read.
    """
    rule, label = matching_rule(F.col("host"), F.col("path"), rules)
    seen = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")) \
        .withColumn("rule", rule).withColumn("_label", label)
    segs = F.split(F.regexp_replace("path", "^/", ""), "/")
    short = F.when(F.size(segs) > DEPTH, F.concat(F.slice(segs, 1, DEPTH), F.array(F.lit("**")))).otherwise(segs)
    paths = seen.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count("_label").alias("labelled"),
        F.sum(F.when(F.col("_label") == "block", 1).otherwise(0)).alias("blocked")).withColumn("tpl", short)
    for level in range(1, DEPTH + 1):
        paths = _literals(materialise(paths), level)
    paths = materialise(paths)
    tree = paths.groupBy("host", "tpl").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")) \
        .withColumn("merged", F.col("tpl"))
    for level in range(DEPTH + 1, 0, -1):
        tree = _merged(tree, level)
    tree = materialise(tree)
    every = tree.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("n")).first()
    rate = (every["b"] + 1.0) / (every["n"] + 2.0)
    branch = tree.groupBy("host", "merged").agg(
        ((F.sum("blocked") + F.lit(STRENGTH * rate)) / (F.sum("labelled") + F.lit(STRENGTH))).alias("_p"),
        F.sum("labelled").alias("_n"))
    judged = paths.select("host", "path", "tpl").join(tree.select("host", "tpl", "merged"), ["host", "tpl"]) \
        .join(branch, ["host", "merged"]) \
        .select("host", "path", F.concat_ws("/", "merged").alias("template"), "_p", "_n")
    return seen.join(judged, ["host", "path"], "left").select(
        F.col("_key").alias(key), "host", "path", "rule",
        F.coalesce("_label", F.when((F.col("_p") >= REJECT) & (F.col("_n") >= EVIDENCE), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", (F.lit(1.0) - F.col("_p")).alias("purity"))
