"""Connected components of an edge table by alternating star contractions; nothing leaves the executors but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cytolake.runtime import cut_lineage


def _nearest(pairs: DataFrame) -> DataFrame:
    """Each row (u, v) with the least v of its u, or u itself if that is less; one row per u on the small side."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) bigint edges -> (node, root): the least node of every node's component; only nodes with an edge.

    Every round points neighbours at the least node around them, first the larger ones, then the smaller ones; it ends when
    a round changes nothing. Loops and repeated edges do no harm; no edges give no rows; nulls are left out.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        seen = _nearest(large)
        small = (seen.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(seen.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = cut_lineage(small)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = new
