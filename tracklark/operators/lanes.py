"""Lanes from runs and curves: stations, runs in between, usage and counts of runs, summaries of passes, bridges, links between passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions.scalars import first_reason
from tracklark.operators.intervals import touching
from tracklark.operators.sequence import ordered

EPS = 1e-9


def stations(curves: DataFrame, keys: list[str], curve: str, s: str, d: str, spacing: float, least: int, most_spread: float = 3.5, most_gap: float = 2.0) -> DataFrame:
    """keys, station, n, d, spread, gap, reason: the median of the curves' d at the middle of each stretch of `spacing`, each curve linear
    between its points, which are unique by (keys, curve, s). Null with the first reason: too few curves, or two groups of them apart."""
    w = ordered([*keys, curve], [s])
    pairs = curves.select(*keys, curve, F.col(s).alias("_s"), F.col(d).alias("_d"), F.lead(s).over(w).alias("_s2"), F.lead(d).over(w).alias("_d2"), F.lead(s, 2).over(w).isNull().alias("_ends")).filter("_s2 is not null")
    at = lambda x: (F.col(x) - spacing / 2) / spacing
    first, last = F.ceil(at("_s")), F.floor(at("_s2"))
    hit = pairs.filter(first <= last).withColumn("_i", F.explode(F.sequence(first, last))).withColumn("station", (F.col("_i") + 0.5) * spacing)
    hit = hit.filter(F.col("_ends") | (F.col("station") < F.col("_s2")))
    hit = hit.select(*keys, "station", (F.col("_d") + (F.col("_d2") - F.col("_d")) * (F.col("station") - F.col("_s")) / (F.col("_s2") - F.col("_s"))).alias("d"))
    step = F.col("d") - F.lag("d").over(ordered([*keys, "station"], ["d"]))
    found = hit.withColumn("_step", step).groupBy(*keys, "station").agg(F.count(F.lit(1)).alias("n"), F.percentile("d", 0.5).alias("d"), (F.max("d") - F.min("d")).alias("spread"), F.coalesce(F.max("_step"), F.lit(0.0)).alias("gap"))
    reason = first_reason(("support", F.col("n") < least), ("bimodal", (F.col("spread") > most_spread) & (F.col("gap") > most_gap)))
    return found.withColumn("reason", reason).withColumn("d", F.when(F.col("reason").isNull(), F.col("d")))


def pair_places(samples: DataFrame, pairs: DataFrame, keys: list[str], run: str, s: str, d: str, slack: float) -> DataFrame:
    """keys, left, right, s, width, hidden of pairs (keys, left, right) of runs at the places where both have a sample: left's d less right's,
    and if a third run lies between, more than slack from either. The lower run's next one beyond slack is the only one that needs a
    look, so the runs of a place are not compared pairwise: from the highest down, the window's frame only grows (one that shrinks is
    added up anew for each row). samples: unique by (keys, run, s)."""
    known = samples.select(*keys, s, F.col(run).alias("_run"), F.col(d).cast("double").alias("_d"))
    place = ", ".join(f"`{c}`" for c in [*keys, s])
    known = known.withColumn("_next", F.expr(f"min(_d) over (partition by {place} order by _d desc range between unbounded preceding and {slack + EPS!r}D preceding)"))
    side = lambda name: known.select(*keys, s, F.col("_run").alias(name), F.struct(F.col("_d").alias("d"), F.col("_next").alias("next")).alias(f"_{name}"))
    both = pairs.select(*keys, "left", "right").join(side("left"), [*keys, "left"]).join(side("right"), [*keys, s, "right"])
    low = F.least("_left", "_right")
    hidden = low["next"] < F.greatest(F.col("_left.d"), F.col("_right.d")) - slack - EPS
    return both.select(*keys, "left", "right", s, (F.col("_left.d") - F.col("_right.d")).alias("width"), F.coalesce(hidden, F.lit(False)).alias("hidden"))


def between(samples: DataFrame, pairs: DataFrame, keys: list[str], run: str, s: str, d: str, slack: float) -> DataFrame:
    """keys, left, right, n, n_between of pairs (keys, left, right) of runs: the places where both have a sample, and those of them where a
    third run lies between (pair_places)."""
    both = pair_places(samples, pairs, keys, run, s, d, slack)
    return both.groupBy(*keys, "left", "right").agg(F.count(F.lit(1)).alias("n"), F.count_if("hidden").alias("n_between"))


def run_usage(runs: DataFrame, intervals: DataFrame, keys: list[str], run: str, d: str) -> DataFrame:
    """runs with usage: boundary (of an interval's left or right), outer (first or last of its keys by d) or isolated."""
    used = intervals.select(F.explode(F.array("left", "right")).alias(run)).distinct().withColumn("_used", F.lit(True))
    down, up = (W.partitionBy(*keys).orderBy(*order) for order in ((F.desc(d), F.col(run)), (F.col(d), F.desc(run))))
    placed = runs.withColumn("_outer", (F.row_number().over(down) == 1) | (F.row_number().over(up) == 1))
    usage = F.when(F.col("_used"), "boundary").when(F.col("_outer"), "outer").otherwise("isolated")
    return placed.join(used, run, "left").withColumn("usage", usage).drop("_outer", "_used")


def count_status(runs: DataFrame, intervals: DataFrame, gaps: DataFrame, keys: list[str], least_span: float) -> DataFrame:
    """keys, n_runs, n_intervals, span, status, lanes. runs: keys, s0, s1; intervals: keys, s0, s1, width (its least); gaps: keys, s0, s1.
    Groups of one run without intervals are left out. Of several objections the gravest counts: a width that is not positive, a gap
    inside an interval, a short span, boundaries without an interval; with any, lanes is null."""
    spans = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("s0").alias(f"_{name}0"), F.max("s1").alias(f"_{name}1"), *([F.min("width").alias("_width")] if name == "intervals" else []))
    out = spans(runs, "runs").join(spans(intervals, "intervals"), keys, "left").withColumn("n_intervals", F.coalesce("n_intervals", F.lit(0).cast("long")))
    met = touching(intervals.select(*keys, "s0", "s1"), gaps.select(*keys, F.col("s0").alias("_g0"), F.col("s1").alias("_g1")), keys, "s0", "s1", "_g0", "_g1")
    holed = met.filter((F.col("_g0") < F.col("s1")) & (F.col("s0") < F.col("_g1"))).select(*keys).distinct().withColumn("_holed", F.lit(True))
    out = out.join(holed, keys, "left").filter((F.col("n_runs") > 1) | (F.col("n_intervals") > 0))
    out = out.withColumn("span", F.coalesce("_intervals1", "_runs1") - F.coalesce("_intervals0", "_runs0"))
    status = first_reason(("orderFailure", F.col("_width") <= 0), ("unsupportedGap", F.col("_holed")), ("insufficientSpan", F.col("span") < least_span), ("incompleteBoundaries", F.col("n_intervals") < F.col("n_runs") - 1))
    out = out.withColumn("status", F.coalesce(status, F.lit("assessed")))
    return out.select(*keys, "n_runs", "n_intervals", "span", "status", F.when(F.col("status") == "assessed", F.col("n_intervals")).alias("lanes"))


def pass_summaries(rows: DataFrame, keys: list[str], order: list[str], time: str, e: str, n: str, speed: str, loop: float = 25.0, long_: float = 30.0) -> DataFrame:
    """keys, n, length, first_t, last_t, apart (of first and last row), mean_speed (of those above 0), suspicious: a long way that ends where
    it began, at a speed half as much off from the reported one."""
    step = F.hypot(F.col(e) - F.lag(e).over(ordered(keys, order)), F.col(n) - F.lag(n).over(ordered(keys, order)))
    place, ends = F.struct(*order), F.struct(F.col(time).alias("t"), F.col(e).alias("e"), F.col(n).alias("n"))
    out = rows.withColumn("_step", step).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"), F.min_by(ends, place).alias("_a"), F.max_by(ends, place).alias("_b"), F.coalesce(F.avg(F.when(F.col(speed) > 0, F.col(speed))), F.lit(0.0)).alias("mean_speed"))
    out = out.withColumns({"first_t": F.col("_a.t"), "last_t": F.col("_b.t"), "apart": F.hypot(F.col("_b.e") - F.col("_a.e"), F.col("_b.n") - F.col("_a.n"))})
    implied = F.col("length") / F.greatest(F.col("last_t") - F.col("first_t"), F.lit(0.1))
    odd = (F.col("length") > long_) & (F.col("apart") < loop) & (F.col("mean_speed") > 0) & (F.abs(implied - F.col("mean_speed")) > 0.5 * F.col("mean_speed"))
    return out.withColumn("suspicious", odd).drop("_a", "_b")


def end_headings(points: DataFrame, keys: list[str], s: str, d: str, most_gap: float = 10.0) -> DataFrame:
    """The gaps of fused points that lie more than most_gap apart: keys, s0, d0, h0, s1, d1, h1. The headings (degrees off the road) are those
    of the last two points before the gap (null if the last one has a gap before it too) and of the first two after it (null if there is but
    one). points: unique by (keys, s), without spikes."""
    w = ordered(keys, [s])
    step = F.col(s) - F.lag(s).over(w)
    slope = F.when(step >= 0.01, F.degrees(F.atan2(F.col(d) - F.lag(d).over(w), step)))
    rows = points.select(*keys, F.col(s).alias("s1"), F.col(d).alias("d1"), F.lag(s).over(w).alias("s0"), F.lag(d).over(w).alias("d0"), step.alias("_step"), slope.alias("_h"))
    w = ordered(keys, ["s1"])
    rows = rows.withColumns({"h0": F.lag(F.when(F.col("_step") <= most_gap, F.col("_h"))).over(w), "h1": F.lead("_h").over(w)})
    return rows.filter(F.col("_step") > most_gap).select(*keys, "s0", "d0", "h0", "s1", "d1", "h1")


def bridge_reasons(gaps: DataFrame, obs: DataFrame, keys: list[str], s: str, frame: str, within: float = 10.0, dropout: float = 30.0, most: float = 28.0, positive: tuple[float, float] = (12.0, 18.0), jump: float = 7.5, least: int = 2, least_frames: int = 2, least_positive: int = 6, aside: float = 0.8, turn: float = 25.0) -> DataFrame:
    """gaps (keys, s0, d0, s1, d1, side) with n_obs, n_frames and reason: why the track's own observations do not carry it over the gap between
    two fused points; null where they do. side is outer, positive or null (no proven boundary); a positive boundary counts the gap's ends
    too and has limits of its own. With columns h0 and h1 (end_headings) the ends must fit as well: within `aside` metres (and within a third
    of jump where the column `chosen` says that the far end was picked among clusters), and within `turn` degrees if both are known."""
    met = touching(gaps.select(*keys, "s0", "s1", "side"), obs.select(*keys, F.col(s).alias("_s"), F.col(frame).alias("_frame")), keys, "s0", "s1", "_s", "_s")
    inside = (F.col("side") == "positive") | ((F.col("_s") > F.col("s0")) & (F.col("_s") < F.col("s1")))
    counts = met.filter(inside).groupBy(*keys, "s0").agg(F.count(F.lit(1)).alias("n_obs"), F.count_distinct("_frame").alias("n_frames"))
    out = gaps.join(counts, [*keys, "s0"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_obs", "n_frames")})
    wide, plus = F.col("s1") - F.col("s0"), F.col("side") == "positive"
    checks = [
        ("notProvenBoundary", F.col("side").isNull()),
        ("withinMaxGap", wide <= within),
        ("belowMinPositiveGap", plus & (wide < positive[0])),
        ("dropoutScaleGap", wide >= dropout),
        ("exceedsMaxGap", wide > F.when(plus, positive[1]).otherwise(most)),
        ("lateralJump", F.abs(F.col("d1") - F.col("d0")) > jump),
        ("insufficientObs", F.col("n_obs") < least),
        ("insufficientFrames", F.col("n_frames") < least_frames),
        ("insufficientPositiveObs", plus & (F.col("n_obs") < least_positive)),
    ]
    if "h0" in gaps.columns:
        near = F.when(F.col("chosen") & ~plus, jump / 3).otherwise(aside) if "chosen" in gaps.columns else F.lit(aside)
        checks += [
            ("lateralMismatch", F.abs(F.col("d1") - F.col("d0")) > near),
            ("headingMismatch", F.abs(F.col("h1") - F.col("h0")) > turn),
        ]
    return out.withColumn("reason", first_reason(*checks))


def partners(runs: DataFrame, same: list[str], other: list[str]) -> DataFrame:
    """runs with n_partners: how many runs agree in `same` and differ in every column of `other`. Rows are counted by (same, other) first;
    those counts are added up over the groups that agree in parts of `other` (inclusion and exclusion), so no pairs are made and a hot
    group is a few rows. Rows with a null in these columns have no partners and are none."""
    at = [*same, *other]
    counts = runs.dropna(subset=at).groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    n = F.lit(0).cast("long")
    for i in range(1 << len(other)):
        also = [c for k, c in enumerate(other) if i >> k & 1]
        of_group = F.sum("_n").over(W.partitionBy(*same, *also))
        n = n + of_group if len(also) % 2 == 0 else n - of_group
    return runs.join(counts.select(*at, n.alias("n_partners")), at, "left").select(*runs.columns, F.coalesce("n_partners", F.lit(0).cast("long")).alias("n_partners"))


def heading_conflicts(estimates: DataFrame, keys: list[str], unit: str, heading: str, most: float = 10.0, least_units: int = 2) -> DataFrame:
    """keys, n_units, arc, conflict: do two headings differ by more than `most` (below 120) degrees, given enough units? Headings all lie that
    near to each other if the shortest arc that holds them is no longer, and that is the circle less the widest gap between neighbours."""
    h = F.pmod(F.col(heading), F.lit(360))
    ways = estimates.filter(F.col(heading).isNotNull()).withColumn("_h", h)
    gap = F.col("_h") - F.lag("_h").over(ordered(keys, ["_h"]))
    out = ways.withColumn("_gap", gap).groupBy(*keys).agg(F.count_distinct(unit).alias("n_units"), F.max("_gap").alias("_gap"), F.min("_h").alias("_low"), F.max("_h").alias("_high"))
    arc = 360 - F.greatest(F.coalesce("_gap", F.lit(0)), 360 - F.col("_high") + F.col("_low"))
    return out.withColumn("arc", arc).withColumn("conflict", (F.col("n_units") >= least_units) & (F.col("arc") > most)).drop("_gap", "_low", "_high")


def link_state(linked: Column, kind: Column, aligned: Column, shared: Column, traversed: Column, self_: Column, same_pass: Column, collides: Column, matches: Column, least: float = 20.0) -> tuple[Column, Column]:
    """(state, code) of two runs of different passes, given their link (kind sameSegment or crossSegment, null without one), if that is aligned, the
    length they share, if their traversal is proven, and if their keys collide or match. Nothing but a link makes them one corridor."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    cross, short = kind == "crossSegment", yes((kind == "sameSegment") & (F.coalesce(shared, F.lit(0.0)) < least))
    loose = yes(linked & (yes(cross) | yes(collides)) & ~(yes(cross) & yes(aligned)))
    steps = [
        (yes(self_), "unavailable", "selfPair"),
        (yes(same_pass), "unavailable", "samePass"),
        (yes(collides) & ~yes(linked), "hypothesis", "keyCollision"),
        (yes(matches) & ~yes(linked), "hypothesis", "keyMatch"),
        (~yes(linked), "unavailable", "noCorridor"),
        (loose, "provisional", "unverifiedAlignment"),
        (short, "provisional", "shortOverlap"),
        (~yes(traversed), "provisional", "unprovenTraversal"),
    ]
    state, code = F, F
    for condition, s, c in steps:
        state, code = state.when(condition, s), code.when(condition, c)
    return state.otherwise("genuine"), code
