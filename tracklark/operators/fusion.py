"""Fusion of observations (s, d, weight, frame) of a boundary: robust bins, choice between clusters, fragments, outer boundaries, pairs.

All observations are aggregated by (key, bin); only bins, which are few, are met in order by the folds at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklark.functions.scalars import first_reason, half_up
from tracklark.operators.carried import by_key
from tracklark.operators.folds import grouped
from tracklark.operators.statistics import gap_clusters, with_median
from tracklark.sources.scratch import saved

# Width of a bin, least rows and frames, MADs of an inlier and the least MAD, the spread up to which one frame is enough.
INTERVAL, LEAST_ROWS, LEAST_FRAMES, MADS, LEAST_MAD, TIGHT = 2.0, 2, 2, 3.0, 0.3, 0.5
# Largest step along and across within a fragment; clusters are split and chosen within these.
MOST_STEP, MOST_JUMP, CLUSTER_GAP, MOST_CHOICE = 10.0, 2.5, 2.5, 4.0


def fused_bins(obs: DataFrame, keys: list[str], s: str, d: str, weight: str, frame: str, interval: float = INTERVAL, relax: bool = True, key: Column | None = None, spread_floor: float = LEAST_MAD, chosen: bool = False) -> DataFrame:
    """keys, bin, n_rows, n_inliers, n_frames, spread, s, d, reason: weighted medians of the inliers; null with the first reason that
    rejects the bin; rows with a null key or s take no part. With relax, one frame is enough where outliers were removed and the rest lies within TIGHT. chosen: the rows
    are one cluster of several, so one row will do and outliers count as removed."""
    at = [*keys, "bin"]
    rows = obs.withColumn("bin", (half_up(F.col(s) / interval) if key is None else key).cast("long"))
    # Windows and aggregations on one dealing by bin; a bin's rows are sorted, and spill, but are never held in an aggregate's state.
    names = list(dict.fromkeys([*at, s, d, weight, frame]))
    for k in at:
        rows = rows.filter(F.col(k).isNotNull())
    rows = with_median(rows.select(*names), at, d, "_median").withColumn("_off", F.abs(F.col(d) - F.col("_median")))
    rows = with_median(rows, at, "_off", "_spread")
    rows = rows.withColumn("_in", F.coalesce(F.col("_off") <= MADS * F.greatest("_spread", F.lit(spread_floor)), F.lit(False)))
    of = [*at, "_in"]
    rows = with_median(rows, of, d, "_median").withColumn("_off", F.abs(F.col(d) - F.col("_median")))
    rows = with_median(rows, of, "_off", "_tight").drop("_median", "_off")
    for c in (d, s):
        run = F.sum(weight).over(W.partitionBy(*of).orderBy(c).rangeBetween(W.unboundedPreceding, W.currentRow))
        rows = rows.withColumns({"_run": run, "_all": F.sum(weight).over(W.partitionBy(*of))})
        rows = rows.withColumn(f"_at_{c}", F.when(F.col("_in") & (2 * F.col("_run") >= F.col("_all")), F.col(c))).drop("_run", "_all")
    first = lambda c: F.min(f"_at_{c}").alias(f"_at_{c}")
    inlier = F.when(F.col("_in"), 1).otherwise(0).cast("long")
    of_frame = rows.groupBy(*at, F.col(frame).alias("_frame")).agg(F.count(F.lit(1)).alias("_n"), F.sum(inlier).alias("_i"), F.max("_spread").alias("_spread"), F.max(F.when(F.col("_in"), F.col("_tight"))).alias("_tight"), first(d), first(s))
    known = F.col("_frame").isNotNull()
    out = of_frame.groupBy(*at).agg(F.sum("_n").alias("n_rows"), F.sum("_i").alias("n_inliers"), F.count_if(known).alias("_all_frames"), F.count_if(known & (F.col("_i") > 0)).alias("n_frames"), F.max("_spread").alias("spread"), F.max("_tight").alias("_tight"), F.min(f"_at_{d}").alias(d), F.min(f"_at_{s}").alias(s))
    return judged(out, s, d, relax, chosen).select(*at, "n_rows", "n_inliers", "n_frames", "spread", s, d, "reason")


def judged(out: DataFrame, s: str, d: str, relax: bool, chosen: bool) -> DataFrame:
    """Bins (n_rows, n_inliers, n_frames, _all_frames, _tight, s, d) with reason; s and d are null where there is one."""
    removed = F.lit(True) if chosen else F.col("n_inliers") < F.col("n_rows")
    least_rows = 1 if chosen else LEAST_ROWS
    need = F.when(removed & (F.col("_tight") <= TIGHT), 1).otherwise(LEAST_FRAMES) if relax else F.lit(LEAST_FRAMES)
    reason = first_reason(
        ("insufficientObservations", F.col("n_rows") < least_rows),
        ("lateralOutliers", F.col("n_inliers") < least_rows),
        ("insufficientFrameSupport", F.col("n_frames") < need),
    )
    if relax and not chosen:
        reason = F.when(F.col("_all_frames") < LEAST_FRAMES, "insufficientFrameSupport").otherwise(reason)
        reason = F.when(F.col("n_rows") < LEAST_ROWS, "insufficientObservations").otherwise(reason)
    ok = F.col("reason").isNull()
    return out.withColumn("reason", reason).withColumns({s: F.when(ok, F.col(s)), d: F.when(ok, F.col(d))})


def counted_bins(obs: DataFrame, keys: list[str], s: str, d: str, weight: str, frame: str, interval: float = INTERVAL, relax: bool = True, key: Column | None = None, spread_floor: float = LEAST_MAD, chosen: bool = False) -> DataFrame:
    """fused_bins, with median (of d), centre (median s) and apart (values of d lie more than CLUSTER_GAP apart), for bins of many rows.
    Values are counted and weights added up before the shuffle, first by d, then by s and frame with the bounds that d gave; windows meet
    only these counts. The bounds, one row a bin, are written once. It reads obs twice; bins of few rows are better off in fused_bins."""
    at = [*keys, "bin"]
    rows = obs.withColumn("bin", (half_up(F.col(s) / interval) if key is None else key).cast("long"))
    for k in at:
        rows = rows.filter(F.col(k).isNotNull())
    rows = rows.select(*dict.fromkeys([*at, s, d, weight, frame]))
    off = F.abs(F.col(d) - F.col("_median"))
    inlier = F.coalesce(off <= MADS * F.greatest("_spread", F.lit(spread_floor)), F.lit(False))

    def half(by: str, of: list[str], holds: Column) -> tuple[Column, Column]:
        w = W.partitionBy(*of)
        run = F.sum("_w").over(w.orderBy(by).rangeBetween(W.unboundedPreceding, W.currentRow))
        return holds & (2 * run >= F.sum("_w").over(w)), F.col(by)

    values = rows.groupBy(*at, d).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
    step = F.col(d) - F.lag(d).over(W.partitionBy(*at).orderBy(F.asc_nulls_last(d)))
    endless = F.abs(F.col(d).cast("double")).isin(float("inf"), float("nan")) & (F.col("_n") > 1)  # a step from inf to inf, or nan to nan, is nan
    values = with_median(values.withColumn("_apart", F.coalesce((step > CLUSTER_GAP) | endless, F.lit(False))), at, d, "_median", "_n").withColumn("_off", off)
    values = with_median(values, at, "_off", "_spread", "_n").withColumn("_in", inlier)
    of = [*at, "_in"]
    values = with_median(values, of, d, "_middle", "_n").withColumn("_off", F.abs(F.col(d) - F.col("_middle")))
    values = with_median(values, of, "_off", "_tight", "_n")
    holds, value = half(d, of, F.col("_in"))
    values = values.withColumn("_at", F.when(holds, value))
    bounds = values.groupBy(*at).agg(
        F.sum("_n").alias("n_rows"), F.sum(F.when(F.col("_in"), F.col("_n")).otherwise(0)).alias("n_inliers"), F.max("_spread").alias("_spread"), F.max("_median").alias("_median"),
        F.max(F.when(F.col("_in"), F.col("_tight"))).alias("_tight"), F.min("_at").alias("_d"), F.max("_apart").alias("apart"))
    bounds = saved(bounds)

    met = rows.join(bounds.select(*at, "_median", "_spread"), at).withColumn("_in", inlier)
    met = met.groupBy(*at, s, F.col(frame).alias("_frame")).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_in").alias("_i"), F.sum(F.when(F.col("_in"), F.col(weight))).alias("_w"))
    holds, value = half(s, at, F.col("_i") > 0)
    met = with_median(met.withColumn("_at_s", F.when(holds, value)), at, s, "centre", "_n")
    of_frame = met.groupBy(*at, "_frame").agg(F.sum("_i").alias("_i"), F.min("_at_s").alias("_s"), F.max("centre").alias("centre"))
    known = F.col("_frame").isNotNull()
    frames = of_frame.groupBy(*at).agg(F.count_if(known).alias("_all_frames"), F.count_if(known & (F.col("_i") > 0)).alias("n_frames"), F.min("_s").alias("_s"), F.max("centre").alias("centre"))
    out = bounds.join(frames, at).withColumnsRenamed({"_s": s, "_d": d, "_spread": "spread", "_median": "median"})
    return judged(out, s, d, relax, chosen).select(*at, "n_rows", "n_inliers", "n_frames", "spread", s, d, "reason", "median", "centre", "apart")


def dominant_only(obs: DataFrame, keys: list[str], track: str) -> DataFrame:
    """Rows of each key's most frequent track (ties: the smallest) and those without a track."""
    counts = obs.filter(F.col(track).isNotNull()).groupBy(*keys, track).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("_n", (-F.col(track)).alias("_t"))).alias("_b")).select(*keys, (-F.col("_b._t")).alias("_best"))
    return obs.join(best, keys, "left").filter(F.col(track).isNull() | F.col("_best").isNull() | (F.col(track) == F.col("_best"))).drop("_best")


def cluster_bins(obs: DataFrame, keys: list[str], s: str, d: str, weight: str, frame: str, tie: str, interval: float = INTERVAL, counted: bool = False) -> DataFrame:
    """keys, bin, whole (struct of the bin fused as one), clusters (array of structs middle, s, d, reason by middle; of bins that fall
    apart into several), centre (median s). counted: by counted_bins, and only rows of bins that fall apart are sorted into clusters; it pays where bins hold
    many rows and few fall apart."""
    at = [*keys, "bin"]
    rows = obs.withColumn("bin", half_up(F.col(s) / interval).cast("long"))
    if counted:
        whole = saved(counted_bins(rows, keys, s, d, weight, frame, interval))
        parts = gap_clusters(rows.join(whole.filter("apart").select(*at), at, "left_semi"), at, d, tie, CLUSTER_GAP)
        each = counted_bins(parts, [*keys, "cluster"], s, d, weight, frame, interval, key=F.col("bin"), chosen=True).withColumnRenamed("median", "middle")
    else:
        whole = fused_bins(rows, keys, s, d, weight, frame, interval)
        split = gap_clusters(rows, at, d, tie, CLUSTER_GAP)
        several = split.groupBy(*at).agg(F.max("cluster").alias("_c"), F.percentile(s, 0.5).alias("centre"))
        parts = split.join(several.filter("_c > 0").select(*at), at)
        fused = fused_bins(parts, [*keys, "cluster"], s, d, weight, frame, interval, key=F.col("bin"), chosen=True)
        middles = parts.groupBy(*at, "cluster").agg(F.percentile(d, 0.5).alias("middle"))
        each, whole = fused.join(middles, [*at, "cluster"]), whole.join(several.select(*at, "centre"), at)
    clusters = each.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("middle", F.col(s).alias("s"), F.col(d).alias("d"), "reason"))).alias("clusters"))
    out = whole.join(clusters, at, "left")
    return out.select(*at, "centre", F.struct(F.col(s).alias("s"), F.col(d).alias("d"), "reason", "n_rows", "n_frames").alias("whole"), "clusters")


def chosen_bins(bins: DataFrame, keys: list[str], light: bool = False) -> DataFrame:
    """keys, bin, s, d, chosen of the bins that hold: in a bin of several clusters (cluster_bins) the one nearest to what its
    neighbours let expect, within MOST_CHOICE; else the bin as a whole. The neighbour before is the last one fused here, the one
    after the next that is fused as a whole, so bins are met in order. light as in by_key."""

    def run(whole: list, clusters: list, centres: list) -> list[list]:
        good = [w["reason"] is None for w in whole]
        after: list[dict | None] = [None] * len(whole)
        for i in range(len(whole) - 2, -1, -1):
            after[i] = whole[i + 1] if good[i + 1] else after[i + 1]
        s, d, chosen, last, early = [], [], [], None, None
        for i, (w, parts, centre) in enumerate(zip(whole, clusters, centres, strict=True)):
            before, nxt, pick = last or early, after[i], None
            if w["n_rows"] >= LEAST_ROWS and parts is not None and len(parts) > 1 and (before or nxt):
                if before and nxt and nxt["s"] != before["s"]:
                    expected = before["d"] + (centre - before["s"]) / (nxt["s"] - before["s"]) * (nxt["d"] - before["d"])
                else:
                    expected = (before or nxt)["d"]
                best = min(parts, key=lambda p: abs(p["middle"] - expected))
                if abs(best["middle"] - expected) <= MOST_CHOICE:
                    pick = best
            use = pick if pick is not None else w
            fine = use["reason"] is None
            s.append(use["s"] if fine else None)
            d.append(use["d"] if fine else None)
            chosen.append(pick is not None)
            if fine:
                last = {"s": use["s"], "d": use["d"]}
            if good[i]:
                early = w
        return [s, d, chosen]

    more = T._parse_datatype_string("s double, d double, chosen boolean")
    out = by_key(bins, keys, ["bin"], ["whole", "clusters", "centre"], run, more, light)
    return out.filter("d is not null and not isnan(d)").select(*keys, "bin", "s", "d", "chosen")


def fragment_numbers(s: np.ndarray, d: np.ndarray, most_step: float, most_jump: float) -> np.ndarray:
    """The fragment of each point, -1 for spikes: a point more than most_step on or three jumps aside of the last kept one begins a new
    fragment; one more than a jump aside is a spike."""
    s, d = s.tolist(), d.tolist()  # faster to read one by one
    out, now, last = np.full(len(s), -1), 0, None
    for i in range(len(s)):
        if last is not None:
            along, aside = s[i] - s[last], abs(d[i] - d[last])
            if along > most_step or aside > 3 * most_jump:
                now += 1
            elif aside > most_jump:
                continue
        out[i], last = now, i
    return out


def fragments(bins: DataFrame, keys: list[str], s: str = "s", d: str = "d", most_step: float = MOST_STEP, most_jump: float = MOST_JUMP, light: bool = False) -> DataFrame:
    """bins with fragment; spikes and fragments of one point are left out. light as in by_key."""
    def run(*columns: list) -> list[list]:
        return [fragment_numbers(*(np.array([np.nan if x is None else x for x in c], float) for c in columns), most_step, most_jump).tolist()]

    out = by_key(bins, keys, [s], [s, d], run, T._parse_datatype_string("fragment long"), light)
    return out.filter("fragment >= 0").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys, "fragment"))).filter("_n >= 2").drop("_n")


def boundary_stats(obs: DataFrame, keys: list[str], track: str, s: str, d: str, least_span: float = 50.0) -> DataFrame:
    """keys, track, mean_d, s0, s1, span, outer, positive of tracks at least least_span long: outer is the one with the lowest
    negative mean, positive the highest of each cluster (2 m apart) of those that are not negative."""
    t = obs.filter(F.col(track).isNotNull()).groupBy(*keys, track).agg(F.avg(d).alias("mean_d"), F.min(s).alias("s0"), F.max(s).alias("s1")).withColumn("span", F.col("s1") - F.col("s0")).filter(F.col("span") >= least_span)
    t = t.withColumn("_side", F.col("mean_d") >= 0)
    t = gap_clusters(t, [*keys, "_side"], "mean_d", track, 2.0)
    low = F.row_number().over(W.partitionBy(*keys, "_side").orderBy("mean_d", track))
    high = F.row_number().over(W.partitionBy(*keys, "_side", "cluster").orderBy(F.desc("mean_d"), track))
    return t.withColumns({"outer": ~F.col("_side") & (low == 1), "positive": F.col("_side") & (high == 1)}).drop("_side", "cluster")


def outer_pairs(tracks: DataFrame, keys: list[str], track: str, least_overlap: float = 20.0, least_apart: float = 2.0) -> DataFrame:
    """keys, left, right, separation, overlap, s0, s1: pairs of tracks (mean_d, s0, s1) that overlap and lie apart, longest overlap
    first, unless they share a track with a pair taken before and more than half of least_overlap of its stretch."""
    a = tracks.select(*keys, F.col(track).alias("a"), *(F.col(c).alias(f"_a{c}") for c in ("mean_d", "s0", "s1")))
    b = tracks.select(*keys, F.col(track).alias("b"), *(F.col(c).alias(f"_b{c}") for c in ("mean_d", "s0", "s1")))
    p = a.join(b, keys).filter("a < b").withColumns({"s0": F.greatest("_as0", "_bs0"), "s1": F.least("_as1", "_bs1"), "separation": F.abs(F.col("_amean_d") - F.col("_bmean_d"))})
    p = p.withColumn("overlap", F.col("s1") - F.col("s0")).filter((F.col("overlap") >= least_overlap) & (F.col("separation") >= least_apart))
    left = F.col("_amean_d") >= F.col("_bmean_d")
    p = p.select(*keys, F.when(left, F.col("a")).otherwise(F.col("b")).alias("left"), F.when(left, F.col("b")).otherwise(F.col("a")).alias("right"), "separation", "overlap", "s0", "s1", (-F.col("overlap")).alias("_by"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple] = []
        keep = []
        for r in g[["left", "right", "s0", "s1"]].itertuples(index=False):
            clash = any((r.left == x.left or r.right == x.right) and min(r.s1, x.s1) - max(r.s0, x.s0) > least_overlap / 2 for x in taken)
            keep.append(not clash)
            if not clash:
                taken.append(r)
        return g.assign(_keep=keep)

    return grouped(p, keys, ["_by", "left", "right"], run, "_keep boolean").filter("_keep").drop("_keep", "_by")


def centroids(obs: DataFrame, keys: list[str], s: str, columns: list[str], weight: str | None = None, interval: float = INTERVAL) -> DataFrame:
    """keys, bin, n and the mean of the columns in each bin, weighted if a weight is given (bins without weight are left out)."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    out = obs.groupBy(*keys, half_up(F.col(s) / interval).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w"), *(F.sum(F.col(c) * w).alias(f"_{c}") for c in columns))
    return out.filter("_w > 0").select(*keys, "bin", "n", *((F.col(f"_{c}") / F.col("_w")).alias(c) for c in columns))


def centre_line(points: DataFrame, keys: list[str], lane: str, i: str, e: str, n: str) -> DataFrame:
    """keys, i, e, n: the two middle lanes of each key paired by position and averaged; keys with fewer than two lanes have none."""
    lanes = points.select(*keys, lane).distinct()
    w = W.partitionBy(*keys)
    ranked = lanes.withColumns({"_r": F.row_number().over(w.orderBy(lane)) - 1, "_n": F.count(F.lit(1)).over(w)})
    middle = F.floor(F.col("_n") / 2)
    pick = ranked.filter((F.col("_n") >= 2) & ((F.col("_r") == middle) | (F.col("_r") == middle - 1))).select(*keys, lane)
    both = points.join(pick, [*keys, lane]).withColumn("_i", F.row_number().over(W.partitionBy(*keys, lane).orderBy(i)) - 1)
    out = both.groupBy(*keys, "_i").agg(F.count(F.lit(1)).alias("_c"), F.avg(e).alias(e), F.avg(n).alias(n)).filter("_c = 2")
    return out.select(*keys, F.col("_i").cast("long").alias("i"), e, n)


def with_fallback(first: DataFrame, second: DataFrame, length: DataFrame, keys: list[str], s0: str = "s0", s1: str = "s1", least: float = 50.0, share: float = 0.1) -> DataFrame:
    """The polygons of first with source `edges`, but those of second with source `laneTracks` for keys where first covers less than `least`
    metres or less than `share` of the key's length (length: keys, total)."""
    covered = first.groupBy(*keys).agg(F.sum(F.col(s1) - F.col(s0)).alias("_c"))
    use = length.join(covered, keys, "left").select(*keys, ((F.coalesce("_c", F.lit(0.0)) < least) | (F.coalesce("_c", F.lit(0.0)) < share * F.col("total"))).alias("_second"))
    any_ = second.select(*keys).distinct().withColumn("_any", F.lit(True))
    use = use.join(any_, keys, "left").select(*keys, (F.col("_second") & F.coalesce("_any", F.lit(False))).alias("_second"))
    a = first.withColumn("source", F.lit("edges")).join(use.filter("not _second").select(*keys), keys, "left_semi")
    return a.unionByName(second.withColumn("source", F.lit("laneTracks")).join(use.filter("_second").select(*keys), keys, "left_semi"))
