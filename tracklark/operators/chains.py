"""Chains and clusters: modes, medoids, running quotas, best chains by dynamic programming, rigid fits, bridges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.operators.folds import grouped
from tracklark.operators.sequence import ranked


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mode, n: the most frequent value (ties: the smallest)."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("_n"))
    return counts.join(best.select(*keys, "_n"), keys).filter("n = _n").groupBy(*keys).agg(F.min(value).alias("mode"), F.first("n").alias("n"))


def medoids(rows: DataFrame, keys: list[str], x: str, y: str, order: list[str | Column]) -> DataFrame:
    """One row per key: the nearest to (median x, median y); ties by order."""
    middle = rows.groupBy(*keys).agg(F.percentile(x, 0.5).alias("_mx"), F.percentile(y, 0.5).alias("_my"))
    near = rows.join(middle, keys).withColumn("_far", F.hypot(F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")))
    return near.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_far", *order))).filter("_r = 1").drop("_r", "_far", "_mx", "_my")


def evicted(rows: DataFrame, keys: list[str], used: str, tie: str, size: str, limit: int) -> DataFrame:
    """rows with evict: the least recently used ones go until the rest of a key fits the limit."""
    w = W.partitionBy(*keys).orderBy(F.desc(used), F.desc(tie))
    return rows.withColumn("evict", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)) > limit)


def quota_split(rows: DataFrame, cluster: str, seed: str, share: float) -> DataFrame:
    """rows with split: clusters in the order of their seeded hash are calibration until their rows reach the share of all. Only the
    clusters' counts are ordered, and a cluster is never torn."""
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}::"), F.col(cluster).cast("string")), 256))
    total = sizes.agg(F.sum("_n").alias("_all"))
    before = ranked(sizes, ["_h"], "_before", "_n").join(F.broadcast(total))  # one row
    split = before.select(cluster, F.when(F.col("_before") < share * F.col("_all"), "calibration").otherwise("validation").alias("split"))
    return rows.join(split, cluster)


def audit_deltas(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, before, after, delta, change of the keys in both runs."""
    both = before.select(*keys, F.col(value).alias("before")).join(after.select(*keys, F.col(value).alias("after")), keys)
    delta = F.col("after") - F.col("before")
    return both.withColumns({"delta": delta, "change": F.when(delta > 0, "improvement").when(delta < 0, "regression").otherwise("same")})


def best_chain(rows: DataFrame, keys: list[str], s: str, tie: str, value: str, weight: str, most_gap: float, most_step: float) -> DataFrame:
    """The rows of each key's chain of largest total weight; a link goes forward in s by at most most_gap with a step of value of at
    most most_step. Rows are met in the order of s, and only those within most_gap are looked back at."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, v, w = (g[c].to_numpy(float) for c in (s, value, weight))
        total, back, low = w.copy(), np.full(len(g), -1), 0
        for i in range(len(g)):
            while x[i] - x[low] > most_gap:
                low += 1
            j = np.flatnonzero((x[low:i] < x[i]) & (np.abs(v[low:i] - v[i]) <= most_step)) + low
            if len(j):
                k = j[total[j].argmax()]
                if total[k] > 0:
                    total[i], back[i] = total[k] + w[i], k
        at, chain = int(total.argmax()), np.zeros(len(g), bool)
        while at >= 0:
            chain[at], at = True, back[at]
        return g.assign(in_chain=chain)

    return grouped(rows, keys, [s, tie], run, "in_chain boolean").filter("in_chain").drop("in_chain")


def rigid_fits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, angle (radians), tx, ty, rmse of the best rotation and shift of (x, y) onto (u, v): sums per key, then closed form."""
    n = F.count(F.lit(1))
    m = rows.groupBy(*keys).agg(n.alias("n"), *(F.avg(c).alias(f"m{c}") for c in "xyuv"), F.covar_pop("x", "u").alias("xu"), F.covar_pop("y", "v").alias("yv"), F.covar_pop("x", "v").alias("xv"), F.covar_pop("y", "u").alias("yu"), *(F.var_pop(c).alias(f"s{c}") for c in "xyuv"))
    a = F.atan2(F.col("xv") - F.col("yu"), F.col("xu") + F.col("yv"))
    m = m.withColumn("angle", a)
    c, s = F.cos("angle"), F.sin("angle")
    gain = F.hypot(F.col("xv") - F.col("yu"), F.col("xu") + F.col("yv"))
    spread = F.col("sx") + F.col("sy") + F.col("su") + F.col("sv")
    return m.select(*keys, "n", "angle", (F.col("mu") - c * F.col("mx") + s * F.col("my")).alias("tx"), (F.col("mv") - s * F.col("mx") - c * F.col("my")).alias("ty"), F.sqrt(F.greatest(F.lit(0.0), spread - 2 * gain)).alias("rmse"))


def hermite_bridge(rows: DataFrame, samples: int, tension: float = 1.0) -> DataFrame:
    """rows (ae, an, heading_a, be, bn, heading_b) with i, east, north along the cubic from a to b; headings in degrees from north."""
    length = F.hypot(F.col("be") - F.col("ae"), F.col("bn") - F.col("an")) * tension
    f = F.col("i") / samples
    h00, h10, h01, h11 = 2 * f**3 - 3 * f**2 + 1, f**3 - 2 * f**2 + f, -2 * f**3 + 3 * f**2, f**3 - f**2
    part = lambda a, b, trig: h00 * F.col(a) + h10 * length * trig(F.radians("heading_a")) + h01 * F.col(b) + h11 * length * trig(F.radians("heading_b"))
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples)))).withColumns({"east": part("ae", "be", F.sin), "north": part("an", "bn", F.cos)})


def frozen_prefix(before: DataFrame, after: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """keys, n_changed: rows of `before` that `after` no longer has in the same place. Appending must leave it empty."""
    same = [*keys, order, *columns]
    gone = before.select(*same).exceptAll(after.select(*same))
    return gone.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_changed"))
