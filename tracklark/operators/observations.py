"""From lines in a vehicle's frame (parallel arrays x ahead, y left) to gated observations along a route.

A line is one row: keys, x, y and what belongs to it. Columns here work on the arrays; explode() makes points of them once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions.scalars import first_reason, point_segment, to_global
from tracklark.operators.carried import carried
from tracklark.operators.temporal import nearest

# The forward window and least confidence of lines; where and how near the centre sides are told; assessment limits.
BEHIND, AHEAD, LEAST_PROB = -5.0, 120.0, 0.5
EVALUATE_AT, CENTRE, CROSSING, MOST_STD = 10.0, 0.05, (5.0, 15.0), 1.5
# Segments around the nearest path point and seconds around its middle; two near hits this far apart along the path are ambiguous.
AROUND, MOST_DT, ALIKE, APART = 4, 4.0, 1.0, 10.0
MOST_OFF, BACK, FORWARD = 25.0, 5.0, 120.0


def finite(x: Column) -> Column:
    v = x.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def pairs(x: str, y: str) -> Column:
    """The finite pairs of two arrays of equal length."""
    both = F.zip_with(x, y, lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")))
    return F.filter(both, lambda p: finite(p["x"]) & finite(p["y"]))


def malformed(x: str, y: str) -> Column:
    """No array, no entries, unequal lengths, or no finite pair."""
    shape = F.col(x).isNull() | F.col(y).isNull() | (F.size(x) < 1) | (F.size(x) != F.size(y))
    return F.when(shape, True).otherwise(F.size(pairs(x, y)) == 0)


def crosses_centre(x: str, y: str, window: tuple[float, float] = CROSSING, eps: float = CENTRE) -> Column:
    """Does the line lie on both sides within the window ahead?"""
    near = F.filter(pairs(x, y), lambda p: p["x"].between(*window))
    return F.coalesce(F.exists(near, lambda p: p["y"] > eps) & F.exists(near, lambda p: p["y"] < -eps), F.lit(False))


def anchor(x: str, y: str, at: float) -> Column:
    """struct(y, how): the line at x = at: between the first two neighbours around it (interpolated), else at the nearest point
    (nearest; the first of equals), a lone point (single); null without finite points."""
    p = pairs(x, y)
    steps = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hit = F.get(F.filter(steps, lambda s: (F.least(s["a"]["x"], s["b"]["x"]) <= at) & (F.greatest(s["a"]["x"], s["b"]["x"]) >= at) & (s["a"]["x"] != s["b"]["x"])), F.lit(0))
    between = hit["a"]["y"] + (at - hit["a"]["x"]) / (hit["b"]["x"] - hit["a"]["x"]) * (hit["b"]["y"] - hit["a"]["y"])
    close = F.array_min(F.transform(p, lambda q, i: F.struct(F.abs(q["x"] - at).alias("off"), i.alias("i"), q["y"].alias("y"))))
    made = lambda v, how: F.struct(v.alias("y"), F.lit(how).alias("how"))
    return F.when(F.size(p) == 1, made(F.get(p, F.lit(0))["y"], "single")).when(hit.isNotNull(), made(between, "interpolated")).when(F.size(p) > 1, made(close["y"], "nearest"))


def assessed(lines: DataFrame, x: str = "x", y: str = "y", prob: str = "prob", std: str = "std") -> DataFrame:
    """lines with lateral (at EVALUATE_AT), side, malformed, crossing, eligible and the first reason against a line: geometry,
    confidence, uncertainty."""
    rows = lines.withColumns({"malformed": malformed(x, y)}).withColumn("lateral", F.when(~F.col("malformed"), anchor(x, y, EVALUATE_AT)["y"]))
    side = F.when(F.col("lateral") > CENTRE, "left").when(F.col("lateral") < -CENTRE, "right").otherwise("center")
    rows = rows.withColumns({"side": side, "crossing": F.when(F.col("malformed"), False).otherwise(crosses_centre(x, y))})
    rows = rows.withColumn("eligible", ~F.col("malformed") & ~F.col("crossing") & F.col("lateral").isNotNull() & (F.col("side") != "center"))
    reason = first_reason(
        ("malformed", F.col("malformed")),
        ("crossing", F.col("crossing")),
        ("noSide", F.col("side") == "center"),
        ("confidenceBelowThreshold", F.coalesce(F.col(prob), F.lit(0.0)) < LEAST_PROB),
        ("uncertaintyExcessive", F.col(std) > MOST_STD),
    )
    return rows.withColumn("reason", reason)


def ego_candidates(lines: DataFrame, keys: list[str], line: str, prob: str = "prob", std: str = "std") -> DataFrame:
    """keys, side, line, lateral, reason: of the eligible lines (assessed) on each side the one nearest to the centre (ties: the smaller
    line), and why it would not do. Sides without one have no row."""
    w = W.partitionBy(*keys, "side").orderBy(F.abs("lateral"), line)
    best = lines.filter("eligible").withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    reason = first_reason(("confidenceBelowThreshold", F.coalesce(F.col(prob), F.lit(0.0)) < LEAST_PROB), ("uncertaintyExcessive", F.col(std) > MOST_STD))
    return best.select(*keys, "side", line, "lateral", reason.alias("reason"))


def line_points(lines: DataFrame, keys: list[str], x: str = "x", y: str = "y", prob: str = "prob", least_prob: float = LEAST_PROB, ahead: float = AHEAD) -> DataFrame:
    """keys, i, model_x, model_y, outcome of every point of lines with arrays of equal length: kept, nonFinite, outsideWindow; lowConfidence
    for a whole line (no confidence counts as 0), tooFewPoints where fewer than two would be kept."""
    rows = lines.filter((F.size(x) > 0) & (F.size(x) == F.size(y)))
    rows = rows.select(*keys, (F.coalesce(F.col(prob), F.lit(0.0)) < least_prob).alias("_low"), F.posexplode(F.arrays_zip(F.col(x).alias("a"), F.col(y).alias("b"))).alias("i", "_p"))
    a, b = F.col("_p.a"), F.col("_p.b")
    rows = rows.select(*keys, "_low", F.col("i").cast("long").alias("i"), a.cast("double").alias("model_x"), b.cast("double").alias("model_y"))
    own = first_reason(("lowConfidence", F.col("_low")), ("nonFinite", ~(finite(F.col("model_x")) & finite(F.col("model_y")))), ("outsideWindow", ~F.col("model_x").between(BEHIND, ahead)))
    rows = rows.withColumn("outcome", F.coalesce(own, F.lit("kept")))
    kept = F.count_if(F.col("outcome") == "kept").over(W.partitionBy(*keys))
    return rows.withColumn("_kept", kept).withColumn("outcome", F.when((F.col("outcome") == "kept") & (F.col("_kept") < 2), "tooFewPoints").otherwise(F.col("outcome"))).drop("_low", "_kept")


def placed(points: DataFrame, east: str, north: str, heading: str) -> DataFrame:
    """points (model_x, model_y and a pose) with east, north, and the same for the line mirrored about the vehicle's axis."""
    e, n = to_global(F.col("model_x"), F.col("model_y"), F.col(east), F.col(north), F.col(heading))
    me, mn = to_global(F.col("model_x"), -F.col("model_y"), F.col(east), F.col(north), F.col(heading))
    return points.withColumns({"point_east": e, "point_north": n, "mirrored_east": me, "mirrored_north": mn})


def project_temporal(points: DataFrame, path: DataFrame, key: str, id_: str, time: str, e: str, n: str) -> DataFrame:
    """key, id, valid, s, d, off, segment, ambiguous: the nearest of the path's segments around the path point nearest in time (ties:
    earlier), AROUND before and as many from it on, whose middle is within MOST_DT seconds. path: key, segment, ae, an, be, bn, s0, s1,
    ta, tb (seconds). ambiguous: on the way to the nearest, a hit less than ALIKE better lay more than APART away along the path; once
    set it stays, as the segments are met in order. A point without a segment is not valid."""
    last = path.groupBy(key).agg(F.max(F.struct("segment", F.col("tb").alias("t"))).alias("x")).select(key, F.col("x.t").alias(time), (F.col("x.segment") + 1).alias("_at"))
    vertices = path.select(key, F.col("ta").alias(time), F.col("segment").alias("_at")).unionByName(last)
    near = nearest(points.select(key, time, id_, e, n), vertices, key, time, "_at")
    each = near.withColumn("segment", F.explode(F.sequence(F.col("_at") - AROUND, F.col("_at") + AROUND - 1)))
    share, off, side = point_segment(F.col(e), F.col(n), F.col("ae"), F.col("an"), F.col("be"), F.col("bn"))
    hits = each.join(path, [key, "segment"]).withColumn("_dt", F.abs(F.col(time) - (F.col("ta") + F.col("tb")) / 2)).filter(F.col("_dt") <= MOST_DT)
    hits = hits.select(key, id_, F.struct("segment", off.alias("off"), (F.col("s0") + share * (F.col("s1") - F.col("s0"))).alias("s"), side.alias("d")).alias("h"))
    found = hits.groupBy(key, id_).agg(F.sort_array(F.collect_list("h")).alias("hs"))  # at most 2 * AROUND for each point

    def step(acc: Column, h: Column) -> Column:
        better = h["off"] < acc["best"]["off"]
        torn = better & (acc["best"]["off"] - h["off"] < ALIKE) & (F.abs(h["s"] - acc["best"]["s"]) > APART)
        return F.struct(F.when(better, h).otherwise(acc["best"]).alias("best"), (acc["ambiguous"] | torn).alias("ambiguous"))

    start = F.struct(F.get("hs", F.lit(0)).alias("best"), F.lit(False).alias("ambiguous"))
    found = found.select(key, id_, F.aggregate(F.slice("hs", 2, 2 * AROUND), start, step).alias("r"))
    out = points.select(key, id_).join(found, [key, id_], "left")
    return out.select(key, id_, F.col("r").isNotNull().alias("valid"), "r.best.s", "r.best.d", "r.best.off", "r.best.segment", F.coalesce("r.ambiguous", F.lit(False)).alias("ambiguous"))


def gated(rows: DataFrame, vehicle_s: str) -> DataFrame:
    """Rows of project_temporal beside the vehicle's own s, with side and the first reason against them."""
    reason = first_reason(
        ("outsideTemporalWindow", ~F.col("valid")),
        ("projectionAmbiguous", F.col("ambiguous")),
        ("tooFarFromTrajectory", F.col("off") > MOST_OFF),
        ("outsideForwardWindow", (F.col("s") < F.col(vehicle_s) - BACK) | (F.col("s") > F.col(vehicle_s) + FORWARD)),
    )
    return rows.withColumns({"side": F.when(F.col("d") >= 0, "left").when(F.col("d") < 0, "right"), "reason": reason})


def projection_differences(a: DataFrame, b: DataFrame, keys: list[str], most: float = 5.0) -> DataFrame:
    """keys, s_a, s_b, by of rows that both tables place, more than `most` apart along the path."""
    both = a.select(*keys, F.col("s").alias("s_a")).join(b.select(*keys, F.col("s").alias("s_b")), keys).dropna(subset=["s_a", "s_b"])
    return both.withColumn("by", F.abs(F.col("s_a") - F.col("s_b"))).filter(F.col("by") > most)


def position_reason(lat: str, lon: str, flags: str, accuracy: str, time: str, most_accuracy: float = 50.0) -> Column:
    """The first reason that a fix's own values give against it, or null."""
    la, lo = F.col(lat), F.col(lon)
    return first_reason(
        ("invalidNumber", ~(finite(la) & finite(lo))),
        ("latOutOfRange", ~la.between(-90, 90)),
        ("lonOutOfRange", ~lo.between(-180, 180)),
        ("nearZero", (F.abs(la) < 1e-4) & (F.abs(lo) < 1e-4)),
        ("noFix", F.coalesce(F.col(flags), F.lit(0)) == 0),
        ("accuracyTooHigh", finite(F.col(accuracy)) & (F.col(accuracy) > F.greatest(F.lit(most_accuracy), F.lit(0.0)))),
        ("missingTimestamp", F.coalesce(F.col(time), F.lit(0)) == 0),
    )


def with_jumps(rows: DataFrame, keys: list[str], order: list[str], e: str, n: str, reason: str = "reason", most: float = 200.0) -> DataFrame:
    """rows whose reason is set to positionJump where they are more than `most` from the last accepted row of the key; rows with a reason
    of their own are accepted by none. What counts is the last accepted row, so this is a fold; it runs over rows without a reason."""

    def step(g: pd.DataFrame, last: list | None):
        x, y, jumps = g[e].to_numpy(float).tolist(), g[n].to_numpy(float).tolist(), np.zeros(len(g), bool)
        for i in range(len(g)):
            if last is not None and ((x[i] - last[0]) ** 2 + (y[i] - last[1]) ** 2) ** 0.5 > most:
                jumps[i] = True
            else:
                last = [x[i], y[i]]
        return {"_jumps": jumps}, last

    fine = carried(rows.filter(F.col(reason).isNull()), keys, order, step, "_jumps boolean")
    fine = fine.withColumn(reason, F.when(F.col("_jumps"), "positionJump")).drop("_jumps")
    return rows.filter(F.col(reason).isNotNull()).unionByName(fine)
