"""Supported runs of a track with the gaps between them, widths between two boundaries, bridges over short gaps, checks of polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions.scalars import all_reasons, segments_cross
from tracklark.operators.sequence import split_by
from tracklark.operators.statistics import order_statistics

# Fixed values (metres, seconds): what splits a run; limits of a road's width, of steps along its ring and of its area for its length.
MOST_GAP, MOST_DT, OVERLAP = 15.0, 3.5, 0.5
NARROW, WIDE, MOST_JUMP, MOST_AREA = 2.0, 30.0, 15.0, 50.0


def runs_and_gaps(obs: DataFrame, keys: list[str], time: str, tie: str, low: str, high: str, most_gap: float = MOST_GAP, most_dt: float = MOST_DT) -> tuple[DataFrame, DataFrame]:
    """Observations (low to high along the track, time in seconds) with run, and the gaps: keys, run (the one before), s0, s1, length, dt and
    reason. A run ends where the next observation begins more than most_gap beyond the last one's end (disconnectedSupport) or comes
    more than most_dt later (temporalGap)."""
    w = W.partitionBy(*keys).orderBy(time, tie)
    rows = obs.withColumns({"_low": F.lag(low).over(w), "_high": F.lag(high).over(w), "_dt": F.abs(F.col(time) - F.lag(time).over(w))})
    clear = F.col(low) > F.col("_high") + OVERLAP
    apart = clear & (F.col(low) - F.col("_high") > most_gap)
    reason = F.when(apart, "disconnectedSupport").when(F.col("_dt") > most_dt, "temporalGap")
    rows = split_by(rows.withColumn("_reason", reason), keys, [time, tie], F.col("_reason").isNotNull(), "run")
    s0, s1 = F.when(clear, F.col("_high")).otherwise(F.col("_low")), F.when(clear, F.col(low)).otherwise(F.col(high))
    gaps = rows.filter("_reason is not null").select(*keys, (F.col("run") - 1).alias("run"), s0.alias("s0"), s1.alias("s1"), F.greatest(F.lit(0.0), s1 - s0).alias("length"), F.col("_dt").alias("dt"), F.col("_reason").alias("reason"))
    return rows.drop("_low", "_high", "_dt", "_reason"), gaps


def width_stats(samples: DataFrame, keys: list[str], width: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """keys, n, n_invalid, n_not_positive, min, max, median (the upper one), mean, std (population), robust_spread (1.4826 times the upper
    median of deviations) and for each band [low, high) the share of all samples in it. Keys without a finite width have none."""
    v = F.col(width).cast("double")
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = samples.withColumn("_v", F.when(fine, v))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_v").isNull()).alias("n_invalid"), F.count_if(F.col("_v") <= 0).alias("n_not_positive"), F.stddev_pop("_v").alias("std"), *(F.count_if((F.col("_v") >= a) & (F.col("_v") < b)).alias(f"_{k}") for k, (a, b) in bands.items()))
    found = order_statistics(rows, keys, "_v", {"median": F.floor(F.col("n") / 2)})
    off = rows.filter("_v is not null").join(found.select(*keys, "median"), keys).withColumn("_off", F.abs(F.col("_v") - F.col("median")))
    spread = order_statistics(off, keys, "_off", {"_spread": F.floor(F.col("n") / 2)}).select(*keys, (1.4826 * F.col("_spread")).alias("robust_spread"))
    out = found.join(spread, keys).join(counts, keys)
    return out.select(*keys, "n", "n_invalid", "n_not_positive", "min", "max", "median", "mean", "std", "robust_spread", *((F.col(f"_{k}") / F.col("_all")).alias(k) for k in bands))


def safe_bridges(gaps: DataFrame, keys: list[str], gap: str, interval: float = 2.0, dropout: float = 30.0) -> DataFrame:
    """keys, bridge: the longest gap that a surface may bridge: the value at index floor(0.9 n) of the gaps between 0.4 intervals and
    dropout, plus half an interval, within 3 intervals and 12 metres; keys without such gaps have none (use 4 intervals)."""
    some = gaps.filter((F.col(gap) > 0.4 * interval) & (F.col(gap) < dropout))
    p90 = order_statistics(some, keys, gap, {"_p": F.least(F.floor(F.col("n") * 0.9), F.col("n") - 1)})
    return p90.select(*keys, F.least(F.greatest(F.col("_p") + interval / 2, F.lit(interval * 3)), F.lit(12.0)).alias("bridge"))


def bridged(spans: DataFrame, keys: list[str], most: Column, step: float = 2.0, most_change: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Spans (keys, s0, s1 and left0, right0, left1, right1 at their ends) with surface, the number of the surface that they become part of,
    and the samples between: keys, surface, s, left, right at every step after a span's end. Two spans are bridged if the gap is above 0
    and at most `most`, the widths at its sides differ by at most most_change, and both lie within the limits; widths change linearly, so
    those between do too."""
    w = W.partitionBy(*keys).orderBy("s0", "s1")
    rows = spans.withColumns({f"_{c}": F.lag(c).over(w) for c in ("s1", "left1", "right1")})
    before, after, gap = F.col("_left1") - F.col("_right1"), F.col("left0") - F.col("right0"), F.col("s0") - F.col("_s1")
    ok = (gap > 0) & (gap <= most) & (F.abs(after - before) <= most_change) & before.between(NARROW, WIDE) & after.between(NARROW, WIDE)
    rows = rows.withColumns({"_ok": F.coalesce(ok, F.lit(False)), "_gap": gap})
    rows = split_by(rows, keys, ["s0", "s1"], ~F.col("_ok") & F.col("_s1").isNotNull(), "surface")
    inner = rows.filter(F.col("_ok") & (F.col("_gap") > step)).withColumn("_i", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_gap") / step).cast("int"))))
    f = F.col("_i") * step / F.col("_gap")
    line = lambda a, b: F.col(a) + f * (F.col(b) - F.col(a))
    samples = inner.filter(F.col("_i") * step < F.col("_gap") - 1e-6).select(*keys, "surface", (F.col("_s1") + F.col("_i") * step).alias("s"), line("_left1", "left0").alias("left"), line("_right1", "right0").alias("right"))
    return rows.drop("_s1", "_left1", "_right1", "_ok", "_gap"), samples


def polygon_checks(samples: DataFrame, keys: list[str], cell: float = 20.0) -> DataFrame:
    """keys, n, length, area, median_width, min_width, max_width, max_jump, n_crossings, reasons (empty: valid) of polygons given as
    samples in order (i, le, ln: left; re, rn: right). The ring is the left side and the right one backwards; its first and last pieces
    may meet."""
    s = samples.withColumn("_w", F.hypot(F.col("le") - F.col("re"), F.col("ln") - F.col("rn")))
    base = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("_w", 0.5).alias("median_width"), F.min("_w").alias("min_width"), F.max("_w").alias("max_width"))
    ring = s.select(*keys, F.lit(0).alias("_side"), F.col("i").alias("_o"), F.col("le").alias("e"), F.col("ln").alias("n_")).union(s.select(*keys, F.lit(1), -F.col("i"), "re", "rn"))
    w = W.partitionBy(*keys).orderBy("_side", "_o")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = ring.withColumns({"_k": F.row_number().over(w) - 1, "_m": F.count(F.lit(1)).over(W.partitionBy(*keys)), "_e2": F.lead("e").over(w), "_n2": F.lead("n_").over(w), "_e0": F.first("e").over(whole), "_n0": F.first("n_").over(whole), "_s2": F.lead("_side").over(w)})
    step = F.hypot(F.col("_e2") - F.col("e"), F.col("_n2") - F.col("n_"))
    cross = F.col("e") * F.coalesce("_n2", "_n0") - F.coalesce("_e2", "_e0") * F.col("n_")
    shape = p.groupBy(*keys).agg(F.max(step).alias("max_jump"), F.sum(F.when((F.col("_side") == 0) & (F.col("_s2") == 0), step)).alias("length"), (F.abs(F.sum(cross)) / 2).alias("area"))
    pieces = p.filter("_e2 is not null").select(*keys, "_k", "_m", "e", "n_", "_e2", "_n2")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    c = pieces.withColumn("_x", span("e", "_e2")).withColumn("_y", span("n_", "_n2"))
    d = c.select(*keys, "_x", "_y", *(F.col(x).alias(f"o{x}") for x in ("_k", "e", "n_", "_e2", "_n2")))
    hit = segments_cross((F.col("e"), F.col("n_")), (F.col("_e2"), F.col("_n2")), (F.col("oe"), F.col("on_")), (F.col("o_e2"), F.col("o_n2")))
    far = (F.col("_k") + 1 < F.col("o_k")) & ~((F.col("_k") == 0) & (F.col("o_k") == F.col("_m") - 2))
    crossed = c.join(d, [*keys, "_x", "_y"]).filter(far & hit).select(*keys, "_k", "o_k").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_crossings"))
    out = base.join(shape, keys).join(crossed, keys, "left").fillna(0, ["n_crossings"])
    few = F.col("n") < 2
    reasons = all_reasons(
        ("widthBelowMin", F.col("min_width") < NARROW),
        ("widthAboveMax", F.col("max_width") > WIDE),
        ("vertexJumpTooLarge", F.col("max_jump") > MOST_JUMP),
        ("selfIntersecting", F.col("n_crossings") > 0),
        ("areaImplausible", (F.col("length") > 0) & (F.col("area") / F.col("length") > MOST_AREA)),
        ("boundaryMismatch", F.col("max_width") > 2 * WIDE),
    )
    return out.withColumn("reasons", F.when(few, F.array(F.lit("tooFewPoints"))).otherwise(reasons))
