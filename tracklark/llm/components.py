"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklark.llm.common import cut, discard


def smallest(pairs: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours. Aggregated before the shuffle, so a hub is no hot task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u points to the smallest of u's neighbourhood."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    return both.join(smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below point to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = smallest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.toDF("u", "v")).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component: for every id on an edge (u, v) that is not the smallest of its component, the smallest."""
    now = cut(edges.select("u", "v").filter("u != v").distinct())
    mark = None
    while True:
        # Edges lead from an id to a smaller one; once every id has one target that has none itself, the stars are done.
        before, now = now, cut(small_star(large_star(now)))
        discard(before)
        sums = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sums == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = sums
