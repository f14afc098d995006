"""Queries for pairs of boundaries and for the ends of gaps; see queries.py for the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.operators import lanes, pairing, pass_fusion
from tracklark.plans.map_queries import P_, points

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Users as runs: days as s, and a level for each run (9 in all) with the day's least cents, folded, around it.
LEVELS = f"{P_}, m AS (SELECT user_id % 5 AS grp, user_id AS run, day AS s, user_id // 5 % 9 * 900 + min(cents) % 1300 AS d FROM p GROUP BY user_id, day)"


def levels(spark: SparkSession, d: str) -> DataFrame:
    lowest = points(spark, d).groupBy((F.col("user_id") % 5).alias("grp"), F.col("user_id").alias("run"), F.col("day").alias("s")).agg(F.min("cents").alias("c"))
    return lowest.select("grp", "run", "s", (F.floor(F.col("run") / 5) % 9 * 900 + F.col("c") % 1300).alias("d"))


@query(f"""WITH {LEVELS}, r AS (SELECT grp, run, avg(d) AS mean_d, min(s) AS s0, max(s) AS s1 FROM m GROUP BY ALL), g AS (SELECT grp, run, s AS s0, s + 1 AS s1 FROM m WHERE d % 89 = 0),
q AS (SELECT l.grp, l.run AS "left", r.run AS "right", l.mean_d AS left_d, r.mean_d AS right_d, greatest(l.s0, r.s0) AS s0, least(l.s1, r.s1) AS s1, l.run // 60 = r.run // 60 AS section, l.run // 20 <> 7 AS chunk FROM r l JOIN r ON l.run = r.run + 5),
w AS (SELECT q.grp, q."left", q."right", l.s, l.d - r.d AS width, EXISTS (SELECT 1 FROM m WHERE m.grp = q.grp AND m.s = l.s AND m.d > least(l.d, r.d) + 50 AND m.d < greatest(l.d, r.d) - 50) AS hidden FROM q JOIN m l ON l.run = q."left" JOIN m r ON r.run = q."right" AND r.s = l.s),
a AS (SELECT *, width > 0 AND NOT hidden AS adj, lag(sign(width)) OVER (PARTITION BY "left", "right", width <> 0 ORDER BY s) AS was FROM w), p2 AS (SELECT *, sum(CASE WHEN adj THEN 0 ELSE 1 END) OVER (PARTITION BY "left", "right" ORDER BY s) AS part FROM a),
c AS (SELECT grp, "left", "right", count(*) AS n, count(*) FILTER (adj) AS n_adjacent, count(*) FILTER (hidden) AS n_between, count(*) FILTER (width <> 0 AND sign(width) <> was) > 0 AS crossing FROM p2 GROUP BY ALL),
t AS (SELECT "left", "right", max(s) - min(s) < 2 AS short, min(s) AS low, max(s) AS high, count(*) AS n_widths, min(width) AS mn, max(width) AS mx, avg(width) AS mean, stddev_pop(width) AS std FROM p2 WHERE adj GROUP BY "left", "right", part),
b AS (SELECT *, row_number() OVER (PARTITION BY "left", "right" ORDER BY short, low) AS k FROM t),
o AS (SELECT q.*, coalesce(c.n, 0) AS n, coalesce(n_adjacent, 0) AS n_adjacent, coalesce(n_between, 0) AS n_between, crossing, short, low, high, n_widths, mn, mx, mean, std,
 CASE WHEN NOT section THEN 'sectionMismatch' WHEN NOT chunk THEN 'chunkMismatch' WHEN left_d < right_d - 50 THEN 'meanOrder' WHEN q.s1 - q.s0 < 2 THEN 'shortOverlap'
  WHEN EXISTS (SELECT 1 FROM g WHERE g.run IN (q."left", q."right") AND least(g.s1, q.s1) > greatest(g.s0, q.s0)) THEN 'trackGap' WHEN coalesce(n_adjacent, 0) = 0 AND n_between > 0 THEN 'interveningRun' WHEN coalesce(n_adjacent, 0) = 0 THEN 'notAdjacent'
  WHEN n_adjacent < c.n AND short THEN 'noLongStretch' WHEN crossing THEN 'crossing' WHEN mn < 150 OR mx > 2000 THEN 'widthOutlier' WHEN std > 500 OR mx - mn > 1200 THEN 'unstableWidth' ELSE 'accepted' END AS outcome
 FROM q LEFT JOIN c USING (grp, "left", "right") LEFT JOIN b ON b."left" = q."left" AND b."right" = q."right" AND k = 1), j AS (SELECT *, outcome IN ('crossing', 'widthOutlier', 'unstableWidth', 'accepted') AS judged FROM o)
SELECT grp, "left", "right", s0, s1, n, n_adjacent, n_between, CASE WHEN n_adjacent = 0 THEN 'none' WHEN n_adjacent = n THEN 'full' ELSE 'partial' END AS adjacency, CASE WHEN judged THEN low END AS low, CASE WHEN judged THEN high END AS high, CASE WHEN judged THEN n_widths END AS n_widths,
 CASE WHEN judged THEN mn::DOUBLE END AS min_width, CASE WHEN judged THEN mx::DOUBLE END AS max_width, CASE WHEN judged THEN round(mean, 4) END AS mean_width, CASE WHEN judged THEN round(std, 4) END AS std_width, outcome,
 concat_ws(',', CASE WHEN judged AND n_adjacent < n THEN 'partialSpan' END, CASE WHEN judged AND crossing THEN 'crossingCandidate' END) AS notes, CASE WHEN outcome IN ('crossing', 'meanOrder') THEN 'crossingOrInvalidOrder' WHEN outcome = 'accepted' THEN 'plausible' ELSE 'insufficientSupport' END AS status FROM j""")
def pair_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = levels(spark, d)
    runs = rows.groupBy("grp", "run").agg(F.avg("d").alias("d"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    left = runs.select("grp", F.col("run").alias("left"), F.col("d").alias("left_d"), F.col("s0").alias("_l0"), F.col("s1").alias("_l1"))
    right = runs.select("grp", F.col("run").alias("right"), F.col("d").alias("right_d"), F.col("s0").alias("_r0"), F.col("s1").alias("_r1"), (F.col("run") + 5).alias("left"))
    both = left.join(right, ["grp", "left"])
    same = {"same_section": F.floor(F.col("left") / 60) == F.floor(F.col("right") / 60), "same_chunk": F.floor(F.col("left") / 20) != 7}
    pairs = both.withColumns({"s0": F.greatest("_l0", "_r0"), "s1": F.least("_l1", "_r1"), **same}).drop("_l0", "_l1", "_r0", "_r1")
    gaps = rows.filter("d % 89 = 0").select("grp", "run", F.col("s").alias("s0"), (F.col("s") + 1).alias("s1"))
    out = pairing.pair_outcomes(pairs, rows, gaps, ["grp"], "run", "s", "d", 2.0, 50.0, (150.0, 2000.0), 500.0, 1200.0)
    return out.withColumns({"mean_width": F.round("mean_width", 4), "std_width": F.round("std_width", 4), "notes": F.concat_ws(",", "notes")})


@query(f"""WITH {P_}, f AS (SELECT user_id, h AS s, min(cents) % 40 AS d FROM p GROUP BY user_id, h), a AS (SELECT user_id, s AS s1, d AS d1, lag(s) OVER w AS s0, lag(d) OVER w AS d0, lag(s, 2) OVER w AS sa, lag(d, 2) OVER w AS da, lead(s) OVER w AS sb, lead(d) OVER w AS db FROM f WINDOW w AS (PARTITION BY user_id ORDER BY s)),
g AS (SELECT *, CASE WHEN s0 - sa <= 30 THEN degrees(atan2(d0 - da, s0 - sa)) END AS h0, degrees(atan2(db - d1, sb - s1)) AS h1, CASE user_id % 3 WHEN 0 THEN 'outer' WHEN 1 THEN 'positive' END AS side, s1 % 2 = 0 AS chosen FROM a WHERE s1 - s0 > 30),
c AS (SELECT g.user_id, s0, count(*) AS n_obs, count(DISTINCT day) AS n_frames FROM g JOIN p ON p.user_id = g.user_id AND p.h BETWEEN s0 AND s1 AND (side = 'positive' OR (p.h > s0 AND p.h < s1)) GROUP BY ALL)
SELECT user_id, s0, d0, round(h0, 4) AS h0, s1, d1, round(h1, 4) AS h1, side, chosen, coalesce(n_obs, 0)::BIGINT AS n_obs, coalesce(n_frames, 0)::BIGINT AS n_frames, CASE WHEN side IS NULL THEN 'notProvenBoundary' WHEN s1 - s0 <= 30 THEN 'withinMaxGap' WHEN side = 'positive' AND s1 - s0 < 40 THEN 'belowMinPositiveGap'
 WHEN s1 - s0 >= 400 THEN 'dropoutScaleGap' WHEN s1 - s0 > CASE side WHEN 'positive' THEN 200 ELSE 300 END THEN 'exceedsMaxGap' WHEN abs(d1 - d0) > 36 THEN 'lateralJump' WHEN coalesce(n_obs, 0) < 0 THEN 'insufficientObs' WHEN coalesce(n_frames, 0) < 0 THEN 'insufficientFrames' WHEN side = 'positive' AND coalesce(n_obs, 0) < 2 THEN 'insufficientPositiveObs'
 WHEN abs(d1 - d0) > CASE WHEN chosen AND side = 'outer' THEN 12 ELSE 20 END THEN 'lateralMismatch' WHEN abs(h1 - h0) > 25 THEN 'headingMismatch' END AS reason FROM g LEFT JOIN c USING (user_id, s0)""")
def gap_ends(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    fused = p.groupBy("user_id", F.col("h").alias("s")).agg((F.min("cents") % 40).alias("d"))
    side = F.when(F.col("user_id") % 3 == 0, "outer").when(F.col("user_id") % 3 == 1, "positive")
    gaps = lanes.end_headings(fused, ["user_id"], "s", "d", 30).withColumns({"side": side, "chosen": F.col("s1") % 2 == 0})
    out = lanes.bridge_reasons(gaps, p, ["user_id"], "h", "day", 30, 400, 300, (40, 200), 36, 0, 0, 2, 20, 25)
    return out.withColumns({"h0": F.round("h0", 4), "h1": F.round("h1", 4)})


def roads(spark: SparkSession, d: str) -> pass_fusion.Road:
    """Users fold onto 20 passes of 200 m: all events are the road's edges, by the parity of their id, and lines of three tracks; a third of the
    passes is called 2,000 m long, so that their edges cover too little."""
    p = points(spark, d).withColumns({"pass": F.col("user_id") % 20, "s": F.col("h") % 2000 / 10, "w": 1.0 + F.col("cents") % 3, "frame": F.col("event_id") % 7, "off": F.col("cents") % 100 / 200})
    side = F.when(F.col("event_id") % 2 == 0, "left").otherwise("right")
    edges = p.withColumn("side", side).withColumn("d", F.when(F.col("side") == "left", 5.0).otherwise(-5.0) + F.col("off"))
    lines = p.withColumn("track", F.col("event_id") % 3).withColumn("d", F.col("track") * 3.0 - 3.0 + F.col("off"))
    length = p.select("pass").distinct().withColumn("total", F.when(F.col("pass") % 3 == 0, 2000.0).otherwise(200.0))
    return pass_fusion.fuse_pass(edges, lines, length, ["pass"], "track", "w", "frame", "event_id")


@query()
def pass_roads(spark: SparkSession, d: str) -> DataFrame:
    return roads(spark, d).surfaces.withColumn("area", F.round("area", 4))


@query()
def pass_coverage(spark: SparkSession, d: str) -> DataFrame:
    return roads(spark, d).coverage.withColumns({c: F.round(c, 4) for c in ("left", "right", "paired", "surface", "percent")})
