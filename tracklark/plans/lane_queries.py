"""Queries for stations, runs in between, usage, counts, passes, bridges and links between passes; see queries.py for the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.operators import lanes, sequence
from tracklark.plans.map_queries import P_, points
from tracklark.plans.queries import HOUR

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {P_}, c AS (SELECT user_id % 40 AS cluster, user_id, h AS s, min(cents) AS d FROM p GROUP BY ALL), n AS (SELECT *, lead(s) OVER w AS s2, lead(d) OVER w AS d2, lead(s, 2) OVER w IS NULL AS ends FROM c WINDOW w AS (PARTITION BY cluster, user_id ORDER BY s)),
i AS (SELECT *, unnest(range(ceil((s - 12) / 24.0)::BIGINT, floor((s2 - 12) / 24.0)::BIGINT + 1)) AS i FROM n WHERE s2 IS NOT NULL), v AS (SELECT cluster, (i + 0.5) * 24 AS station, d + (d2 - d) * ((i + 0.5) * 24 - s) / (s2 - s) AS d FROM i WHERE ends OR (i + 0.5) * 24 < s2),
g AS (SELECT *, d - lag(d) OVER (PARTITION BY cluster, station ORDER BY d) AS step FROM v), a AS (SELECT cluster, station, count(*) AS n, quantile_cont(d, 0.5) AS d, max(d) - min(d) AS spread, coalesce(max(step), 0) AS gap FROM g GROUP BY ALL),
r AS (SELECT *, CASE WHEN n < 3 THEN 'support' WHEN spread > 2500 AND gap > 1200 THEN 'bimodal' END AS reason FROM a)
SELECT cluster, station::DOUBLE AS station, n, CASE WHEN reason IS NULL THEN round(d, 4)::DOUBLE END AS d, round(spread, 4)::DOUBLE AS spread, round(gap, 4)::DOUBLE AS gap, reason FROM r""")
def lane_stations(spark: SparkSession, d: str) -> DataFrame:
    curves = points(spark, d).groupBy((F.col("user_id") % 40).alias("cluster"), "user_id", F.col("h").alias("s")).agg(F.min("cents").alias("d"))
    out = lanes.stations(curves, ["cluster"], "user_id", "s", "d", 24, 3, 2500, 1200)
    return out.withColumns({c: F.round(c, 4) for c in ("d", "spread", "gap")})


RUNS = f"{P_}, m AS (SELECT user_id % 5 AS grp, user_id AS run, day AS s, min(cents) AS d FROM p GROUP BY ALL)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy((F.col("user_id") % 5).alias("grp"), F.col("user_id").alias("run"), F.col("day").alias("s")).agg(F.min("cents").alias("d"))


@query(f"""WITH {RUNS}, q AS (SELECT DISTINCT grp, run AS "left", run + 5 AS "right" FROM m), b AS (SELECT q.*, l.s, least(l.d, r.d) AS lo, greatest(l.d, r.d) AS hi FROM q JOIN m l ON l.run = q."left" JOIN m r ON r.run = q."right" AND r.s = l.s)
SELECT grp, "left", "right", count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM m WHERE m.grp = b.grp AND m.s = b.s AND m.d > b.lo + 50 AND m.d < b.hi - 50)) AS n_between FROM b GROUP BY ALL""")
def runs_between(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d)
    pairs = rows.select("grp", F.col("run").alias("left"), (F.col("run") + 5).alias("right")).distinct()
    return lanes.between(rows, pairs, ["grp"], "run", "s", "d", 50.0)


@query(f"""WITH {RUNS}, r AS (SELECT grp, run, min(d) AS d FROM m GROUP BY ALL), u AS (SELECT run FROM r WHERE run % 3 = 0 UNION SELECT run + 5 FROM r WHERE run % 3 = 0)
SELECT grp, run, d, CASE WHEN run IN (SELECT run FROM u) THEN 'boundary' WHEN row_number() OVER (PARTITION BY grp ORDER BY d DESC, run) = 1 OR row_number() OVER (PARTITION BY grp ORDER BY d, run DESC) = 1 THEN 'outer' ELSE 'isolated' END AS usage FROM r""")
def run_usage(spark: SparkSession, d: str) -> DataFrame:
    runs = samples(spark, d).groupBy("grp", "run").agg(F.min("d").alias("d"))
    pairs = runs.filter("run % 3 = 0").select(F.col("run").alias("left"), (F.col("run") + 5).alias("right"))
    return lanes.run_usage(runs, pairs, ["grp"], "run", "d")


@query(f"""WITH {P_}, r AS (SELECT user_id % 40 AS grp, user_id, min(h) AS s0, max(h) AS s1 FROM p GROUP BY ALL), i AS (SELECT user_id % 40 AS grp, day, min(h) AS s0, max(h) AS s1, min(cents) - 60 AS width FROM p WHERE event_id % 3 = 0 AND user_id % 2 = 0 GROUP BY ALL),
g AS (SELECT user_id % 40 AS grp, h AS s0, h + 2 AS s1 FROM p WHERE event_id % 7 = 0 AND user_id % 4 = 0), x AS (SELECT grp, count(*) AS n_runs, min(s0) AS r0, max(s1) AS r1 FROM r GROUP BY grp), y AS (SELECT grp, count(*) AS n, min(s0) AS i0, max(s1) AS i1, min(width) AS width FROM i GROUP BY grp),
z AS (SELECT DISTINCT i.grp, true AS holed FROM i JOIN g ON i.grp = g.grp AND g.s0 < i.s1 AND i.s0 < g.s1), o AS (SELECT grp, n_runs, coalesce(n, 0)::BIGINT AS n_intervals, coalesce(i1, r1) - coalesce(i0, r0) AS span, width, holed FROM x LEFT JOIN y USING (grp) LEFT JOIN z USING (grp) WHERE n_runs > 1 OR n > 0),
s AS (SELECT *, CASE WHEN width <= 0 THEN 'orderFailure' WHEN holed THEN 'unsupportedGap' WHEN span < 400 THEN 'insufficientSpan' WHEN n_intervals < n_runs - 1 THEN 'incompleteBoundaries' ELSE 'assessed' END AS status FROM o)
SELECT grp, n_runs, n_intervals, span, status, CASE WHEN status = 'assessed' THEN n_intervals END AS lanes FROM s""")
def lane_count_status(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("grp", F.col("user_id") % 40)
    ends = [F.min("h").alias("s0"), F.max("h").alias("s1")]
    intervals = p.filter("event_id % 3 = 0 and user_id % 2 = 0").groupBy("grp", "day").agg(*ends, (F.min("cents") - 60).alias("width"))
    gaps = p.filter("event_id % 7 = 0 and user_id % 4 = 0").select("grp", F.col("h").alias("s0"), (F.col("h") + 2).alias("s1"))
    return lanes.count_status(p.groupBy("grp", "user_id").agg(*ends), intervals, gaps, ["grp"], 400)


@query(f"""WITH {P_}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > {48 * HOUR} THEN 1 ELSE 0 END AS n FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS pass FROM g), k AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY user_id, pass ORDER BY t, event_id)),
a AS (SELECT user_id, pass, count(*) AS n, coalesce(sum(step), 0) AS length, arg_min(h, i) AS first_t, arg_max(h, i) AS last_t, sqrt((arg_max(x, i) - arg_min(x, i)) ** 2 + (arg_max(y, i) - arg_min(y, i)) ** 2) AS apart, coalesce(avg(cents) FILTER (cents > 0), 0) AS mean_speed FROM k GROUP BY ALL)
SELECT user_id, pass, n, round(length, 4) AS length, first_t, last_t, round(apart, 4) AS apart, round(mean_speed, 4) AS mean_speed, length > 30 AND apart < 150 AND mean_speed > 0 AND abs(length / greatest(last_t - first_t, 0.1) - mean_speed) > 0.5 * mean_speed AS suspicious FROM a""")
def pass_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = sequence.sessionize(points(spark, d), ["user_id"], "t", "event_id", 48 * HOUR, "pass")
    out = lanes.pass_summaries(rows, ["user_id", "pass"], ["t", "event_id"], "h", "x", "y", "cents", 150.0)
    return out.withColumns({c: F.round(c, 4) for c in ("length", "apart", "mean_speed")})


@query(f"""WITH {P_}, f AS (SELECT user_id, day, min(h) AS s, min(cents) AS d FROM p GROUP BY ALL), g AS (SELECT user_id, lag(s) OVER w AS s0, lag(d) OVER w AS d0, s AS s1, d AS d1, CASE user_id % 3 WHEN 0 THEN 'outer' WHEN 1 THEN 'positive' END AS side FROM f WINDOW w AS (PARTITION BY user_id ORDER BY s)),
c AS (SELECT g.user_id, g.s0, count(*) AS n_obs, count(DISTINCT day) AS n_frames FROM g JOIN p ON p.user_id = g.user_id AND (p.h > g.s0 AND p.h < g.s1 OR side = 'positive' AND p.h BETWEEN g.s0 AND g.s1) GROUP BY ALL),
o AS (SELECT g.*, coalesce(n_obs, 0)::BIGINT AS n_obs, coalesce(n_frames, 0)::BIGINT AS n_frames, s1 - s0 AS wide FROM g LEFT JOIN c USING (user_id, s0) WHERE s0 IS NOT NULL)
SELECT user_id, s0, s1, d0, d1, side, n_obs, n_frames, CASE WHEN side IS NULL THEN 'notProvenBoundary' WHEN wide <= 10 THEN 'withinMaxGap' WHEN side = 'positive' AND wide < 12 THEN 'belowMinPositiveGap' WHEN wide >= 90 THEN 'dropoutScaleGap' WHEN wide > CASE side WHEN 'positive' THEN 70 ELSE 60 END THEN 'exceedsMaxGap'
 WHEN abs(d1 - d0) > 1500 THEN 'lateralJump' WHEN n_obs < 2 THEN 'insufficientObs' WHEN n_frames < 1 THEN 'insufficientFrames' WHEN side = 'positive' AND n_obs < 3 THEN 'insufficientPositiveObs' END AS reason FROM o""")
def gap_bridges(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    w = W.partitionBy("user_id").orderBy("s")
    fused = p.groupBy("user_id", "day").agg(F.min("h").alias("s"), F.min("cents").alias("d"))
    side = F.when(F.col("user_id") % 3 == 0, "outer").when(F.col("user_id") % 3 == 1, "positive")
    gaps = fused.select("user_id", F.lag("s").over(w).alias("s0"), F.lag("d").over(w).alias("d0"), F.col("s").alias("s1"), F.col("d").alias("d1"), side.alias("side")).filter("s0 is not null")
    return lanes.bridge_reasons(gaps, p, ["user_id"], "h", "day", 10, 90, 60, (12, 70), 1500, 2, 1, 3)


@query(f"""WITH {P_}, r AS (SELECT event_id, user_id % 5 AS segment, cents % 3 AS corridor, user_id AS parent, day % 4 AS pass FROM p)
SELECT a.event_id, (SELECT count(*) FROM r b WHERE b.segment = a.segment AND b.corridor = a.corridor AND b.parent <> a.parent AND b.pass <> a.pass) AS n_matches, (SELECT count(*) FROM r b WHERE b.corridor = a.corridor AND b.segment <> a.segment) AS n_collisions FROM r a""")
def pass_partners(spark: SparkSession, d: str) -> DataFrame:
    runs = points(spark, d).select("event_id", (F.col("user_id") % 5).alias("segment"), (F.col("cents") % 3).alias("corridor"), F.col("user_id").alias("parent"), (F.col("day") % 4).alias("pass"))
    matched = lanes.partners(runs, ["segment", "corridor"], ["parent", "pass"]).withColumnRenamed("n_partners", "n_matches")
    return lanes.partners(matched, ["corridor"], ["segment"]).select("event_id", "n_matches", F.col("n_partners").alias("n_collisions"))


@query(f"""WITH {P_}, r AS (SELECT user_id % 50 AS grp, day, event_id % 6 AS unit, (user_id % 50 * 11 + cents % (8 + user_id % 50)) % 360 AS h FROM p), g AS (SELECT grp, day, count(DISTINCT unit) AS n_units FROM r GROUP BY ALL)
SELECT grp, day, n_units, n_units >= 2 AND EXISTS (SELECT 1 FROM r a JOIN r b ON a.grp = b.grp AND a.day = b.day WHERE a.grp = g.grp AND a.day = g.day AND least(abs(a.h - b.h), 360 - abs(a.h - b.h)) > 10) AS conflict FROM g""")
def heading_conflicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 50
    rows = points(spark, d).select(k.alias("grp"), "day", (F.col("event_id") % 6).alias("unit"), ((k * 11 + F.col("cents") % (8 + k)) % 360).alias("heading"))
    return lanes.heading_conflicts(rows, ["grp", "day"], "unit", "heading").drop("arc")


@query(f"""WITH {P_}, l AS (SELECT event_id, cents % 7 > 2 AS linked, CASE cents % 3 WHEN 0 THEN 'crossSegment' ELSE 'sameSegment' END AS kind, event_id % 4 > 0 AS aligned, (cents % 60)::DOUBLE AS shared, event_id % 5 > 1 AS walked, event_id % 17 = 0 AS same_run, event_id % 13 = 0 AS same_pass, cents % 3 = 0 AND event_id % 2 = 0 AS collides, event_id % 3 = 0 AS matches FROM p)
SELECT event_id, CASE WHEN same_run OR same_pass THEN 'unavailable' WHEN linked THEN CASE WHEN kind = 'crossSegment' AND NOT aligned OR kind = 'sameSegment' AND shared < 20 OR NOT walked THEN 'provisional' ELSE 'genuine' END WHEN collides OR matches THEN 'hypothesis' ELSE 'unavailable' END AS state,
 CASE WHEN same_run THEN 'selfPair' WHEN same_pass THEN 'samePass' WHEN linked THEN CASE WHEN kind = 'crossSegment' AND NOT aligned THEN 'unverifiedAlignment' WHEN kind = 'sameSegment' AND shared < 20 THEN 'shortOverlap' WHEN NOT walked THEN 'unprovenTraversal' END WHEN collides THEN 'keyCollision' WHEN matches THEN 'keyMatch' ELSE 'noCorridor' END AS code FROM l""")
def link_states(spark: SparkSession, d: str) -> DataFrame:
    c, i = F.col("cents"), F.col("event_id")
    linked = c % 7 > 2
    kind = F.when(linked, F.when(c % 3 == 0, "crossSegment").otherwise("sameSegment"))
    state, code = lanes.link_state(linked, kind, i % 4 > 0, (c % 60).cast("double"), i % 5 > 1, i % 17 == 0, i % 13 == 0, (c % 3 == 0) & (i % 2 == 0), i % 3 == 0)
    return points(spark, d).select("event_id", state.alias("state"), code.alias("code"))
