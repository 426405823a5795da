"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BY_ID = 2  # first rounds, in which a node joins its least neighbour; then the order is a hash, new in each round


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` for each node of the links (two long columns, any direction, repeats allowed).

    Each round every node joins the least of its neighbours and itself, and links move to what their ends
    joined.  A star ends in one round; hashed orders make chains shrink by a share in each.  Rounds are written
    tables, minima are combined before the shuffle, and joins on a hot node are equi-joins that AQE splits.
    Links to itself are ignored, as are links with a null end; a node with no other link has no row.
    """
    links = materialise(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    joined: list[DataFrame] = []
    while not links.isEmpty():
        n = len(joined)

        def order(c: Column, n: int = n) -> Column:
            return F.struct(c if n < BY_ID else F.xxhash64(c, F.lit(n)), c)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min_by("b", order(F.col("b"))).alias("b"))
        step = materialise(least.select(F.col("a").alias("node"), F.when(
            order(F.col("b")) < order(F.col("a")), F.col("b")).otherwise(F.col("a")).alias("to")))
        joined.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        links = materialise(links.join(left, "a").join(right, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
                            .filter("a <> b").distinct())
    if not joined:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = joined[0].select("node", F.col("to").alias("root"))
    for step in joined[1:]:
        hop = step.select(F.col("node").alias("root"), "to")
        out = out.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialise(out)
