"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage


def _signature(edges: DataFrame) -> tuple:
    # decimals: a sum of 64-bit hashes must not overflow
    return tuple(edges.agg(F.count("*"),
                           F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node.

    Each round points the larger neighbours of every node to its smallest one,
    then the smaller neighbours; the links end as one star per component.
    Rounds grow with the logarithm of the longest chain.  A hub is no hot task:
    its minimum is pre-aggregated and staged, so the join back to its links has
    a plain shuffle on both sides, whose skew adaptive execution splits.
    Rounds are cut by tables in the shared folder.
    """
    edges = stage(links.filter("a <> b")
                       .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .distinct(), "stars")
    seen = _signature(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")), "stars-low")
        large = (both.join(low, "a").filter("b > a")
                     .select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), "stars-low")
        small = (large.join(low, "a")
                      .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                              F.col("m").alias("b"))
                      .distinct())
        edges = stage(small, "stars")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
