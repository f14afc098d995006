"""Joining of fragments of one boundary: ends, candidates, gates, evidence between them, scores, selection, connectors, paths.

A table of points has the keys of a boundary, fragment, i (order in the fragment), s, east, north and t (seconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions.scalars import first_reason, ramp, segments_cross
from tracklark.operators.graph import chains

# Gates (metres, degrees, seconds) and the weights of the score.
RADIUS, MOST_GAP, MOST_ALONG, MOST_TURN, MOST_LATERAL, MOST_CURVE = 40.0, 40.0, 40.0, 20.0, 3.0, 25.0
MOST_APART_S, MOST_BACK_S, LARGE_GAP, LEAST_SUPPORTED = 30.0, 10.0, 12.0, 2
WEIGHTS = {"gap": 0.25, "turn": 0.25, "lateral": 0.20, "curve": 0.10, "time": 0.05, "support": 0.10, "identity": 0.05}
LEAST_SCORE, LEAST_MARGIN = 0.55, 0.12
SUPPORT = {"directlySupported": 1.0, "weaklySupported": 0.6, "occludedOrMissing": 0.4, "unsupported": 0.0}


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two directions; null if one has no length."""
    size = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(size > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size)))))


def ends(points: DataFrame, keys: list[str], reach: int = 4) -> DataFrame:
    """One row per fragment of at least two points: its first (s0, e0, n0, t0) and last point (s1, e1, n1, t1), directions there over
    `reach` points, curvature over the three outermost ones (degrees a metre; 0 under four points), and n."""
    by = [*keys, "fragment"]
    w = W.partitionBy(*by)
    p = points.withColumns({"_n": F.count(F.lit(1)).over(w), "_a": F.row_number().over(w.orderBy("i")) - 1}).withColumn("_z", F.col("_n") - 1 - F.col("_a"))
    at = lambda side, k, c: F.max(F.when(F.col(side) == k, F.col(c)))
    step = F.least(F.lit(reach), F.col("_n") - 1)
    picks = [at("_a", 0, c).alias(f"{c}_a") for c in ("s", "east", "north", "t")] + [at("_z", 0, c).alias(f"{c}_z") for c in ("s", "east", "north", "t")]
    picks += [F.max(F.when(F.col(side) == step, F.col(c))).alias(f"{c}{side}r") for side in ("_a", "_z") for c in ("east", "north")]
    picks += [at(side, k, c).alias(f"{c}{side}{k}") for side in ("_a", "_z") for k in (1, 2) for c in ("east", "north")]
    g = p.groupBy(*by).agg(F.max("_n").alias("n"), *picks).filter("n >= 2")
    c = F.col

    def curvature(side: str) -> Column:
        x = [(c(f"east{side}"), c(f"north{side}")), (c(f"east{side}1"), c(f"north{side}1")), (c(f"east{side}2"), c(f"north{side}2"))]
        turn = angle_between(x[1][0] - x[0][0], x[1][1] - x[0][1], x[2][0] - x[1][0], x[2][1] - x[1][1])
        return F.when(c("n") >= 4, F.coalesce(turn / F.nullif(F.hypot(x[2][0] - x[0][0], x[2][1] - x[0][1]), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)

    return g.select(
        *by,
        "n",
        *(c(f"{a}_a").alias(f"{b}0") for a, b in (("s", "s"), ("east", "e"), ("north", "n"), ("t", "t"))),
        *(c(f"{a}_z").alias(f"{b}1") for a, b in (("s", "s"), ("east", "e"), ("north", "n"), ("t", "t"))),
        (c("east_ar") - c("east_a")).alias("dx0"),
        (c("north_ar") - c("north_a")).alias("dy0"),
        (c("east_z") - c("east_zr")).alias("dx1"),
        (c("north_z") - c("north_zr")).alias("dy1"),
        curvature("_a").alias("curve0"),
        curvature("_z").alias("curve1"),
    )


def candidates(ends_: DataFrame, keys: list[str], radius: float = RADIUS) -> DataFrame:
    """Pairs of a fragment's end (a_) and another one's start (b_) of the same boundary within the radius, further along in s. Starts are
    entered in the cells around them, so that an equi-join on key and cell finds the pairs."""
    others = [x for x in ends_.columns if x not in keys]
    a = ends_.select(*keys, *(F.col(x).alias(f"a_{x}") for x in others)).withColumns({"_x": F.floor(F.col("a_e1") / radius), "_y": F.floor(F.col("a_n1") / radius)})
    b = ends_.select(*keys, *(F.col(x).alias(f"b_{x}") for x in others))
    b = b.withColumn("_x", F.explode(F.sequence(F.floor(F.col("b_e0") / radius) - 1, F.floor(F.col("b_e0") / radius) + 1)))
    b = b.withColumn("_y", F.explode(F.sequence(F.floor(F.col("b_n0") / radius) - 1, F.floor(F.col("b_n0") / radius) + 1)))
    pairs = a.join(b, [*keys, "_x", "_y"]).drop("_x", "_y").withColumns({"gap": F.hypot(F.col("b_e0") - F.col("a_e1"), F.col("b_n0") - F.col("a_n1")), "along": F.col("b_s0") - F.col("a_s1")})
    return pairs.filter((F.col("a_fragment") != F.col("b_fragment")) & (F.col("gap") <= radius) & (F.col("along") > 0))


def corridor(pairs: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with inside, supported and corridor: observations (keys, s, support) of the boundary more than half a metre inside the gap,
    those of at least two frames among them, and the label. Gaps are entered in bands of s of MOST_ALONG, wider than any of them."""
    p = pairs.withColumn("_band", F.explode(F.array_distinct(F.array(F.floor(F.col("a_s1") / MOST_ALONG), F.floor(F.col("b_s0") / MOST_ALONG)))))
    e = evidence.select(*keys, F.col("s").alias("_s"), F.col("support").alias("_sup")).withColumn("_band", F.floor(F.col("_s") / MOST_ALONG))
    near = p.filter(F.col("along") <= MOST_ALONG).select(*keys, "a_fragment", "b_fragment", "a_s1", "b_s0", "_band").join(e, [*keys, "_band"])
    near = near.filter((F.col("_s") > F.col("a_s1") + 0.5) & (F.col("_s") < F.col("b_s0") - 0.5))
    counts = near.groupBy(*keys, "a_fragment", "b_fragment").agg(F.count(F.lit(1)).alias("inside"), F.count_if(F.col("_sup") >= 2).alias("supported"))
    out = pairs.join(counts, [*keys, "a_fragment", "b_fragment"], "left").fillna(0, ["inside", "supported"])
    label = F.when(F.col("supported") >= LEAST_SUPPORTED, "directlySupported").when((F.col("supported") >= 1) | (F.col("inside") >= 2), "weaklySupported")
    return out.withColumn("corridor", label.when((F.col("inside") == 0) & (F.col("gap") > LARGE_GAP), "unsupported").otherwise("occludedOrMissing"))


def crossing(pairs: DataFrame, points: DataFrame, keys: list[str], boundary: list[str], cell: float = RADIUS) -> DataFrame:
    """pairs with crosses: does the straight connector cross a piece of another boundary? keys: what both share; boundary: the
    further keys that tell boundaries apart. Connectors and pieces meet by grid cell."""
    all_ = [*keys, *boundary]
    w = W.partitionBy(*all_, "fragment").orderBy("i")
    pieces = points.select(*all_, F.col("east").alias("_ae"), F.col("north").alias("_an"), F.lead("east").over(w).alias("_be"), F.lead("north").over(w).alias("_bn")).filter("_be is not null")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    q = pieces.withColumn("_x", span("_ae", "_be")).withColumn("_y", span("_an", "_bn")).select(*keys, *(F.col(b).alias(f"_{b}") for b in boundary), "_x", "_y", "_ae", "_an", "_be", "_bn")
    c = pairs.select(*all_, "a_fragment", "b_fragment", "a_e1", "a_n1", "b_e0", "b_n0").withColumn("_x", span("a_e1", "b_e0")).withColumn("_y", span("a_n1", "b_n0"))
    other = F.lit(False)
    for b in boundary:
        other = other | (F.col(b) != F.col(f"_{b}"))
    hit = segments_cross(*((F.col(x), F.col(y)) for x, y in (("a_e1", "a_n1"), ("b_e0", "b_n0"), ("_ae", "_an"), ("_be", "_bn"))))
    hits = c.join(q, [*keys, "_x", "_y"]).filter(other & hit).select(*all_, "a_fragment", "b_fragment").distinct().withColumn("crosses", F.lit(True))
    return pairs.join(hits, [*all_, "a_fragment", "b_fragment"], "left").fillna(False, ["crosses"])


def evaluated(pairs: DataFrame) -> DataFrame:
    """Pairs with corridor and crosses, judged: turn, lateral, curve, apart_s, the first gate that fails (reason, null if none) and the
    score of those that pass all."""
    c = F.col
    size = F.nullif(F.hypot("a_dx1", "a_dy1"), F.lit(0.0))
    ux, uy = c("a_dx1") / size, c("a_dy1") / size
    turn = angle_between(c("a_dx1"), c("a_dy1"), c("b_dx0"), c("b_dy0"))
    # How far B's start lies beside A's continuation.
    lateral = F.abs(-(c("b_e0") - c("a_e1")) * uy + (c("b_n0") - c("a_n1")) * ux)
    p = pairs.withColumns({"turn": turn, "lateral": lateral, "apart_s": c("b_t0") - c("a_t1")})
    implied = c("turn") / F.greatest(c("along"), F.lit(0.5))
    p = p.withColumn("curve", F.greatest(F.abs(implied - c("a_curve1")), F.abs(implied - c("b_curve0"))))
    reason = first_reason(
        ("endpointGapTooLarge", c("gap") > MOST_GAP),
        ("alongTrackGapTooLarge", c("along") > MOST_ALONG),
        ("tangentIncompatible", c("turn").isNull() | (c("turn") > MOST_TURN)),
        ("lateralMisalignment", c("lateral") > MOST_LATERAL),
        ("curvatureKink", c("curve") > MOST_CURVE),
        ("temporalRevisit", c("apart_s") < -MOST_BACK_S),
        ("temporalGap", c("apart_s") > MOST_APART_S),
        ("unsupportedGap", c("corridor") == "unsupported"),
        ("largeGapInsufficientEvidence", (c("gap") > LARGE_GAP) & (c("corridor") != "directlySupported")),
        ("crossesOtherBoundary", c("crosses")),
    )
    support = F.create_map(*(F.lit(x) for kv in SUPPORT.items() for x in kv))[c("corridor")]
    parts = {
        "gap": 1 - ramp("gap", 0, MOST_GAP),
        "turn": 1 - ramp("turn", 0, MOST_TURN),
        "lateral": 1 - ramp("lateral", 0, MOST_LATERAL),
        "curve": 1 - ramp("curve", 0, MOST_CURVE),
        "time": F.when(c("apart_s").isNull(), 0.5).otherwise(1 - ramp(F.abs("apart_s"), 0, MOST_APART_S)),
        "support": support,
        "identity": F.lit(1.0),
    }
    score = sum((w * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    return p.withColumn("reason", reason).withColumn("score", F.when(c("reason").isNull(), F.round(score, 4)))


def selected(pairs: DataFrame, keys: list[str], a: str = "a_fragment", b: str = "b_fragment", score: str = "score", least: float = LEAST_SCORE, margin: float = LEAST_MARGIN) -> DataFrame:
    """The pairs that are the best of both sides, score at least `least` and lead the source's second best by `margin` (1 without one).
    As best of both sides, no fragment has two successors or predecessors."""
    of_a = W.partitionBy(*keys, a).orderBy(F.desc(score), b)
    of_b = W.partitionBy(*keys, b).orderBy(F.desc(score), a)
    p = pairs.filter(F.col(score).isNotNull())
    p = p.withColumns({"_ra": F.row_number().over(of_a), "_rb": F.row_number().over(of_b), "second_score": F.lead(score).over(of_a)})
    p = p.withColumn("margin", F.coalesce(F.col(score) - F.col("second_score"), F.lit(1.0)))
    return p.filter((F.col("_ra") == 1) & (F.col("_rb") == 1) & (F.round("margin", 9) >= margin) & (F.col(score) >= least)).drop("_ra", "_rb")


def connectors(joins: DataFrame, keys: list[str], segments: int = 6, handle: float = 0.35) -> DataFrame:
    """keys, a_fragment, b_fragment, i, east, north, s of the cubic from A's end to B's start along their directions."""
    c = F.col
    f, g = c("i") / segments, 1 - c("i") / segments

    def axis(p: str, q: str, d1: str, d0: str, size1: Column, size0: Column) -> Column:
        first, last = c(p) + c(d1) / size1 * c("gap") * handle, c(q) - c(d0) / size0 * c("gap") * handle
        return g**3 * c(p) + 3 * g**2 * f * first + 3 * g * f**2 * last + f**3 * c(q)

    size1, size0 = F.hypot("a_dx1", "a_dy1"), F.hypot("b_dx0", "b_dy0")
    x = joins.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(segments))))
    return x.select(*keys, "a_fragment", "b_fragment", "i", axis("a_e1", "b_e0", "a_dx1", "b_dx0", size1, size0).alias("east"), axis("a_n1", "b_n0", "a_dy1", "b_dy0", size1, size0).alias("north"), (c("a_s1") + c("along") * f).alias("s"))


def join_fragments(points: DataFrame, evidence: DataFrame, keys: list[str], boundary: list[str]) -> tuple[DataFrame, DataFrame]:
    """All steps: the fragments (one row each) with their path, fragments without a join as paths of their own; and the judged
    candidates with the margin of those chosen. Fragment ids are unique over all boundaries."""
    all_ = [*keys, *boundary]
    e = ends(points, all_)
    judged = evaluated(crossing(corridor(candidates(e, all_), evidence, all_), points, keys, boundary))
    chosen = selected(judged, all_)
    known = chosen.select(*all_, "a_fragment", "b_fragment", "margin")
    paths = chains(e.select(*all_, "fragment", "s0", "s1"), known, "fragment", "a_fragment", "b_fragment")
    return paths, judged.join(known, [*all_, "a_fragment", "b_fragment"], "left")
