"""Pairs of boundaries as lanes: signed widths along them, stretches with nothing in between, and what first speaks against a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions.scalars import first_reason
from tracklark.operators.intervals import touching
from tracklark.operators.lanes import pair_places
from tracklark.operators.sequence import ordered

# Fixed values (metres): shortest stretch, slack of the order, limits of widths with their slack, of their spread and of their range.
LEAST, TOLERANCE, NARROW, WIDE, SLACK, MOST_STD, MOST_RANGE = 5.0, 0.15, 2.0, 5.5, 1e-3, 0.8, 1.2
#: Widths up to this are not positive.
POSITIVE = 1e-9


def stretches(places: DataFrame, at: list[str], s: str, least: float) -> DataFrame:
    """at, n, n_adjacent, n_between, crossing and best: of the stretches of places in a row that are adjacent (a positive width and nothing
    in between) the first of at least `least` metres, or the first if none is (short), as a struct of short, low, high, n, min, max, mean and
    std of its widths. crossing: do the runs change sides, places on one line left aside?"""
    w = ordered(at, [s])
    sign = F.when(F.col("width") > POSITIVE, 1).when(F.col("width") < -POSITIVE, -1)
    before = F.last(sign, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    adjacent = (F.col("width") > POSITIVE) & ~F.col("hidden")
    rows = places.withColumns({"_adjacent": adjacent, "_turns": F.coalesce(sign != before, F.lit(False))})
    # Adjacent places with as many others before them are one stretch.
    rows = rows.withColumn("_part", F.count_if(~F.col("_adjacent")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = rows.filter("_adjacent").groupBy(*at, "_part").agg(F.min(s).alias("low"), F.max(s).alias("high"), F.count(F.lit(1)).alias("n"), F.min("width").alias("min"), F.max("width").alias("max"), F.avg("width").alias("mean"), F.stddev_pop("width").alias("std"))
    short = (F.col("high") - F.col("low") < least).alias("short")
    best = parts.groupBy(*at).agg(F.min(F.struct(short, "low", "high", "n", "min", "max", "mean", "std")).alias("best"))
    counts = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.count_if("_adjacent").alias("n_adjacent"), F.count_if("hidden").alias("n_between"), F.bool_or("_turns").alias("crossing"))
    return counts.join(best, at, "left")


def pair_outcomes(
    pairs: DataFrame, samples: DataFrame, gaps: DataFrame, keys: list[str], run: str, s: str, d: str,
    least: float = LEAST, tolerance: float = TOLERANCE, widths: tuple[float, float] = (NARROW, WIDE), most_std: float = MOST_STD, most_range: float = MOST_RANGE, slack: float = SLACK,
) -> DataFrame:
    """pairs (keys, left, right, left_d, right_d, s0, s1, same_section, same_chunk) with n, n_adjacent, n_between, adjacency (full, partial,
    none), low, high, n_widths, min_width, max_width, mean_width and std_width of the stretch judged, outcome (accepted or the first
    objection), notes and status. samples: runs resampled to shared places, unique by (keys, run, s); gaps: keys, run, s0, s1.

    Objections in order: another section, another chunk, mean order, a short overlap, a gap of either run in it, a run in between, no adjacent
    place, no stretch that is long enough (unless all places are adjacent, then the whole is judged), a change of sides, widths outside their
    limits, unstable widths. Notes say what a pair that came to its widths has besides: partialSpan, crossingCandidate. An unknown section
    or chunk is another one; pairs without a shared place are not adjacent. pairs: unique by (keys, left, right)."""
    at = [*keys, "left", "right"]
    found = stretches(pair_places(samples, pairs, keys, run, s, d, tolerance), at, s, least)
    sides = pairs.select(*at, "s0", "s1", F.explode(F.array("left", "right")).alias("_run"))
    holes = gaps.select(*keys, F.col(run).alias("_run"), F.col("s0").alias("_g0"), F.col("s1").alias("_g1"))
    met = touching(sides, holes, [*keys, "_run"], "s0", "s1", "_g0", "_g1").filter(F.least("s1", "_g1") > F.greatest("s0", "_g0"))
    out = pairs.join(found, at, "left").join(met.select(*at).distinct().withColumn("_holed", F.lit(True)), at, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "n_adjacent", "n_between")})
    none, full = F.col("n_adjacent") == 0, F.col("n_adjacent") == F.col("n")
    low, high = widths
    outcome = first_reason(
        ("sectionMismatch", ~F.coalesce("same_section", F.lit(False))),
        ("chunkMismatch", ~F.coalesce("same_chunk", F.lit(False))),
        ("meanOrder", F.col("left_d") < F.col("right_d") - tolerance),
        ("shortOverlap", F.col("s1") - F.col("s0") < least),
        ("trackGap", F.col("_holed")),
        ("interveningRun", none & (F.col("n_between") > 0)),
        ("notAdjacent", none),
        ("noLongStretch", ~full & F.col("best.short")),
        ("crossing", F.col("crossing")),
        ("widthOutlier", (F.col("best.min") < low - slack) | (F.col("best.max") > high + slack)),
        ("unstableWidth", (F.col("best.std") > most_std) | (F.col("best.max") - F.col("best.min") > most_range)),
    )
    out = out.withColumns({"outcome": F.coalesce(outcome, F.lit("accepted")), "adjacency": F.when(none, "none").when(full, "full").otherwise("partial")})
    judged = F.col("outcome").isin("crossing", "widthOutlier", "unstableWidth", "accepted")
    notes = F.array_compact(F.array(F.when(judged & ~full, F.lit("partialSpan")), F.when(judged & F.col("crossing"), F.lit("crossingCandidate"))))
    status = F.when(F.col("outcome").isin("crossing", "meanOrder"), "crossingOrInvalidOrder").when(F.col("outcome") == "accepted", "plausible").otherwise("insufficientSupport")
    stretch = [F.when(judged, F.col(f"best.{c}")).alias(name) for c, name in (("low", "low"), ("high", "high"), ("n", "n_widths"), ("min", "min_width"), ("max", "max_width"), ("mean", "mean_width"), ("std", "std_width"))]
    return out.select(*at, "s0", "s1", "n", "n_adjacent", "n_between", "adjacency", *stretch, "outcome", notes.alias("notes"), status.alias("status"))
