"""Graphs as edge tables: connected components, chains of successors, groups around seeds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklark.sources.scratch import saved


def _low(pairs: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours; combined before the shuffle, so a hub is no hot task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, component: every id on an edge with the smallest id of its component.

    Alternating stars: neighbours above an id point to the smallest of its neighbourhood, then those below do; when no edge changes,
    all point to their component's smallest. Each turn is a written table, so nothing is recomputed and nothing is collected.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    ids = both.select(F.col("u").alias("id")).union(both.select("v")).distinct()
    now = saved(both.filter("u != v").distinct())
    before = None
    while True:
        all_ = now.union(now.select("v", "u"))
        large = all_.join(_low(all_), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = _low(down)
        now = saved(down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v")).filter("u != v").distinct())
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            return ids.join(now.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        before = mark


def chains(items: DataFrame, links: DataFrame, id_: str, source: str, target: str) -> DataFrame:
    """items with path: the smallest id of the chain of links (source to target, each id once on either side) that an item is on; an
    item without links is a path of its own."""
    on = components(links, source, target).toDF(id_, "path")
    return items.join(on, id_, "left").withColumn("path", F.coalesce("path", F.col(id_)))


def seed_groups(stats: DataFrame, keys: list[str], id_: str, near: tuple[float, float] = (0.8, 15.0), far: tuple[float, float] = (1.5, 250.0)) -> DataFrame:
    """stats (id, mean_d, s0, s1) with seed: in the order of ids, the first item without a group takes all later free ones on its side
    (sign of mean_d) that lie at most near[0] apart and overlap by near[1], or at most far[0] apart with a gap of at most far[1].
    Members are compared with the seed only, so this is no transitive closure. Works on summaries: one row for each item of a key."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(id_, kind="stable").reset_index(drop=True)
        free, seed = set(range(len(g))), [None] * len(g)
        ids, d, a, b = (g[c].tolist() for c in (id_, "mean_d", "s0", "s1"))
        for i in range(len(g)):
            if i not in free:
                continue
            for j in sorted(free):
                if j < i or (d[i] >= 0) != (d[j] >= 0):
                    continue
                apart, shared = abs(d[i] - d[j]), min(b[i], b[j]) - max(a[i], a[j])
                if i == j or apart <= near[0] and shared >= near[1] or apart <= far[0] and -shared <= far[1]:
                    seed[j] = ids[i]
                    free.discard(j)
        return g.assign(seed=seed)

    return stats.groupBy(*keys).applyInPandas(run, f"{stats._jdf.schema().toDDL()}, seed {dict(stats.dtypes)[id_]}")
