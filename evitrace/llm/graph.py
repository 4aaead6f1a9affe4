"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's smallest node
    and is not listed itself.

    Alternating stars: each node hands its larger neighbours to the smallest one it knows, then
    its smaller neighbours. The number of rounds grows with the logarithm of the longest path;
    each round is four grouped minima and joins on rows of two numbers, written between rounds, and
    the loop ends when a round changes nothing. Nothing but a count and a checksum reaches the
    driver.
    """
    up = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = cut_lineage(edges.filter(F.col("a") != F.col("b")).select(*up).distinct())
    seen = _signature(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _signature(following)
        current, seen, before = following, now, seen
        if now == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
