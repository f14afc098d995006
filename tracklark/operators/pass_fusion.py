"""The road of a pass from its observations in one call: fused boundaries and lane lines, surfaces between them, and what they cover.

Surfaces come from the road's edges; where these cover under 50 metres or a tenth of the pass, from pairs of outer lane tracks, if
there are any. All in (s, d) along the path: `runs.polygon_checks` judges surfaces once they are projected to the map.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklark.operators import fusion, runs
from tracklark.operators.sequence import ordered, split_by
from tracklark.operators.spatial import resample
from tracklark.operators.surface import supported_runs
from tracklark.sources.scratch import saved

# Fixed values (metres): step of samples, longest step of a supported run of edges and of lanes, bridge where no gaps tell one,
# least span of a track that may bound a road.
STEP, EDGE_SPAN, LANE_SPAN, BRIDGE, LEAST_SPAN = 2.0, 4.0, 8.0, 8.0, 12.0


@dataclass(frozen=True)
class Road:
    """boundaries: keys, side, fragment, bin, s, d; lanes: keys, track, fragment, bin, s, d; surfaces: keys, left, right (tracks; null
    between edges), surface, s0, s1, n_spans, area, source; coverage: keys, total, left, right, paired, surface, percent, source."""

    boundaries: DataFrame
    lanes: DataFrame
    surfaces: DataFrame
    coverage: DataFrame


def spans_between(left: DataFrame, right: DataFrame, at: list[str], most_span: float, step: float = STEP, least: int = 3) -> DataFrame:
    """at, s0, s1, n, area and left0, right0, left1, right1 at the ends, of the stretches where points (at, s, d) of a left and a right boundary,
    each without steps over most_span, lie between runs.NARROW and runs.WIDE apart at no fewer than `least` places in a row."""
    side = lambda points, name: resample(supported_runs(points, at, "s", most_span), [*at, "run"], "s", "d", step).withColumnsRenamed({"run": f"_{name}", "d": name})
    both = side(left, "left_d").join(side(right, "right_d"), [*at, "s"]).withColumn("_w", F.col("left_d") - F.col("right_d"))
    valid = both.filter(F.col("_w").between(runs.NARROW, runs.WIDE))
    of_runs = [*at, "_left_d", "_right_d"]
    ahead = F.col("s") - F.lag("s").over(ordered(of_runs, ["s"]))
    rows = split_by(valid, of_runs, ["s"], ahead > 1.5 * step, "_strip")
    w = ordered([*of_runs, "_strip"], ["s"])
    piece = (F.lead("s").over(w) - F.col("s")) * (F.col("_w") + F.lead("_w").over(w)) / 2
    ends = [f("_x", "s").getField(c).alias(f"{c[:-2]}{i}") for f, i in ((F.min_by, 0), (F.max_by, 1)) for c in ("left_d", "right_d")]
    rows = rows.withColumns({"_area": F.coalesce(piece, F.lit(0.0)), "_x": F.struct("left_d", "right_d")})
    out = rows.groupBy(*of_runs, "_strip").agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.count(F.lit(1)).alias("n"), F.sum("_area").alias("area"), *ends)
    return out.filter(F.col("n") >= least).drop("_left_d", "_right_d", "_strip")


def bridged_surfaces(spans: DataFrame, points: DataFrame, at: list[str]) -> DataFrame:
    """at, surface, s0, s1, n_spans, area: spans bridged over gaps that the steps between a pair's own points (at, side, s) prove safe."""
    steps = points.withColumn("gap", F.col("s") - F.lag("s").over(ordered([*at, "side"], ["s"])))
    safe = runs.safe_bridges(steps.filter("gap is not null"), at, "gap")
    rows, _ = runs.bridged(spans.join(safe, at, "left"), at, F.coalesce("bridge", F.lit(BRIDGE)))
    w = ordered([*at, "surface"], ["s0", "s1"])
    between = (F.col("s0") - F.lag("s1").over(w)) * (F.lag("left1").over(w) - F.lag("right1").over(w) + F.col("left0") - F.col("right0")) / 2
    return rows.withColumn("_b", F.coalesce(between, F.lit(0.0))).groupBy(*at, "surface").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("area") + F.col("_b")).alias("area"))


def track_surfaces(points: DataFrame, keys: list[str], track: str) -> DataFrame:
    """keys, left, right, surface, s0, s1, n_spans, area between the pairs of outer tracks of fused points (keys, track, s, d)."""
    tracks = points.groupBy(*keys, track).agg(F.avg("d").alias("mean_d"), F.min("s").alias("s0"), F.max("s").alias("s1")).filter(F.col("s1") - F.col("s0") >= LEAST_SPAN)
    pairs = fusion.outer_pairs(tracks, keys, track).select(*keys, "left", "right")
    at = [*keys, "left", "right"]
    side = lambda name: pairs.join(points.select(*keys, F.col(track).alias(name), "s", "d"), [*keys, name]).select(*at, "s", "d")
    left, right = side("left"), side("right")
    both = left.withColumn("side", F.lit("left")).union(right.withColumn("side", F.lit("right")))
    return bridged_surfaces(spans_between(left, right, at, LANE_SPAN), both, at)


def fuse_pass(edges: DataFrame, lines: DataFrame, length: DataFrame, keys: list[str], track: str, weight: str, frame: str, tie: str) -> Road:
    """edges: keys, side (left or right), s, d, weight, frame; lines: keys, track, s, d, weight, frame, tie (unique within a track); length: keys, total.
    Rows without s or d, edges without a side and lines without a track take no part; passes without a length are judged by the
    50 metres alone; a pass of length without observations has a row of coverage with zeros. Fused points are written once, as each is
    read for runs, pairs and coverage."""
    placed = F.col("s").isNotNull() & F.col("d").isNotNull()
    of_side, of_track = [*keys, "side"], [*keys, track]
    bins = fusion.counted_bins(edges.filter(placed & F.col("side").isNotNull()), of_side, "s", "d", weight, frame, relax=False)
    good = saved(bins.filter("reason is null").select(*of_side, "bin", "s", "d"))
    boundaries = saved(fusion.fragments(good, of_side, light=True))
    bins = fusion.cluster_bins(lines.filter(placed & F.col(track).isNotNull()), of_track, "s", "d", weight, frame, tie, counted=True)
    lanes = saved(fusion.fragments(fusion.chosen_bins(bins, of_track, light=True), of_track, light=True))

    points = boundaries.select(*of_side, "s", "d")
    left, right = (points.filter(F.col("side") == name).drop("side") for name in ("left", "right"))
    spans = spans_between(left, right, keys, EDGE_SPAN)
    number = F.row_number().over(ordered(keys, ["s0", "s1"])).cast("long") - 1
    none = F.lit(None).cast(lines.schema[track].dataType)
    first = spans.select(*keys, none.alias("left"), none.alias("right"), number.alias("surface"), "s0", "s1", F.lit(1).cast("long").alias("n_spans"), "area")
    second = track_surfaces(lanes, keys, track).select(*first.columns)
    known = first.select(*keys).union(second.select(*keys)).distinct()
    total = length.select(*keys, F.col("total").cast("double").alias("total"))
    surfaces = saved(fusion.with_fallback(first, second, known.join(total, keys, "left").fillna(0.0, ["total"]), keys))

    reach = lambda name: F.coalesce(F.max(F.when(F.col("side") == name, F.col("s"))) - F.min(F.when(F.col("side") == name, F.col("s"))), F.lit(0.0)).alias(name)
    sides = good.groupBy(*keys).agg(reach("left"), reach("right"))
    covered = surfaces.groupBy(*keys).agg(F.sum(F.col("s1") - F.col("s0")).alias("surface"), F.first("source").alias("source"))
    out = total.join(sides, keys, "left").join(covered, keys, "left").fillna(0.0, ["left", "right", "surface"])
    percent = F.when(F.col("total") > 0, F.col("surface") / F.col("total") * 100).otherwise(0.0)
    return Road(boundaries, lanes, surfaces, out.select(*keys, "total", "left", "right", F.least("left", "right").alias("paired"), "surface", percent.alias("percent"), "source"))
