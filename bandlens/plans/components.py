"""Connected components of a graph given as edges, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlens.plans.stages import discard, staged


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of the nodes of ``edges`` (``a``, ``b``: longs).

    Alternates large-star and small-star steps: every node links its larger neighbours, then its
    smaller ones and itself, to the smallest one it sees. The number of rounds is logarithmic in
    practice; each round's edges are written, so lineage stays short. A hot node's neighbours are
    only ever aggregated (min) and joined by key, never gathered in one row.
    """
    e = staged(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sums = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Now every edge goes from a larger node to a smaller one.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, e = e, staged(small_star.filter(F.col("a") != F.col("b")).distinct(), "edges")
        discard(last)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == sums:
            break
        sums = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
