"""Queries for partitions into paths, longest chains and uncertainties; see queries.py for the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.operators import covers, line_tracker, ordering, partials, purity, revisits
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


@query()
def path_partition(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).select("user_id", "event_id", F.col("h").cast("double").alias("s"), (F.col("cents") / 100.0).alias("d"), (F.col("cents") % 90).cast("double").alias("heading"))
    out = covers.path_cover(rows, ["user_id"], "event_id", "s", "d", "heading", 36.0, 40.0, free=12.0)
    return out.select("user_id", "event_id", "piece", "path", F.round("cost", 6).alias("cost"), "outcome")


CHAIN = f"""{P_}, r AS (SELECT user_id, event_id AS id, h AS s, cents AS d FROM p),
l AS (SELECT a.user_id, a.id AS source, b.id AS target FROM r a JOIN r b ON a.user_id = b.user_id AND b.s > a.s AND b.s - a.s <= 48 AND abs(a.d - b.d) <= 600)"""


@query(f"""WITH RECURSIVE {CHAIN}, c AS (SELECT id, s AS start, 1::BIGINT AS n FROM r UNION SELECT l.target, c.start, c.n + 1 FROM c JOIN l ON l.source = c.id),
b AS (SELECT user_id, r.id AS "end", (s - start)::DOUBLE AS length, n AS n_rows, row_number() OVER (PARTITION BY user_id ORDER BY s - start DESC, n DESC, r.id) AS k FROM c JOIN r USING (id))
SELECT user_id, "end", length, n_rows FROM b WHERE k = 1 AND length >= 5 AND n_rows >= 2""")
def longest_chains(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).select("user_id", "event_id", F.col("h").alias("s"), F.col("cents").alias("d"))
    links = covers.steps(rows, ["user_id"], "event_id", "s", 48, F.abs(F.col("a_d") - F.col("b_d")) <= 600, ["d"])
    return covers.longest_chains(rows, links, ["user_id"], "event_id")


@query(f"""WITH {P_}, r AS (SELECT event_id, x / 100.0 AS a, y / 100.0 AS b, w / 10.0 AS c, CASE event_id % 3 WHEN 0 THEN 'one_sigma' WHEN 1 THEN 'bound' ELSE 'other' END AS kind, cents % 2 = 0 AS independent, event_id % 11 <> 0 AS usable, cents % 5 = 0 AS has, (cents % 7 - 1) / 10.0 AS v FROM p),
f AS (SELECT *, a * a * v + 2 * 0.1 * a * b + b * b * v AS form FROM r)
SELECT event_id, round(CASE WHEN NOT usable THEN NULL WHEN has THEN CASE WHEN form >= 0 THEN sqrt(form) END WHEN kind = 'one_sigma' AND independent THEN sqrt(a * a + b * b + c * c) WHEN kind <> 'other' THEN a + b + c END, 6)::DOUBLE AS value,
 CASE WHEN NOT usable THEN 'confidence' WHEN has AND form < 0 THEN 'covariance' WHEN NOT has AND kind = 'other' THEN 'interpretation' END AS reason FROM f""")
def branch_uncertainties(spark: SparkSession, d: str) -> DataFrame:
    c, i = F.col("cents"), F.col("event_id")
    a, b, w, v = F.col("x") / 100.0, F.col("y") / 100.0, F.col("w") / 10.0, (c % 7 - 1) / 10.0
    kind = F.when(i % 3 == 0, "one_sigma").when(i % 3 == 1, "bound").otherwise("other")
    matrix = F.when(c % 5 == 0, F.array(F.array(v, F.lit(0.1)), F.array(F.lit(0.1), v)))
    value, reason = covers.branch_uncertainty(F.array(a, b, w), i % 11 != 0, matrix, F.array(a, b), kind, c % 2 == 0, F.lit(True))
    return points(spark, d).select("event_id", F.round(value, 6).alias("value"), reason.alias("reason"))


@query(f"""WITH {P_}, r AS (SELECT user_id, x, y, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM p)
SELECT user_id, round(coalesce((SELECT min(sqrt((a.x - b.x)^2 + (a.y - b.y)^2)) FROM r a JOIN r b ON a.user_id = b.user_id AND b.i >= a.i + 3 WHERE a.user_id = u.user_id), 0), 6)::DOUBLE AS distance FROM (SELECT DISTINCT user_id FROM r) u""")
def least_apart(spark: SparkSession, d: str) -> DataFrame:
    out = revisits.least_apart(points(spark, d), ["user_id"], ["t", "event_id"], "x", "y")
    return out.select("user_id", F.round("distance", 6).alias("distance"))


BEARING = "(degrees(atan2({e}, {n})) + 360) % 360"
OFF = "(180 - abs(180 - abs({a} - {b})))"
_old, _new = (BEARING.format(e=f"{p}.be - {p}.ae", n=f"{p}.bn - {p}.an") for p in "ab")
_side = lambda p, q, r: f"(({q}e - {p}e) * ({r}n - {p}n) - ({q}n - {p}n) * ({r}e - {p}e))"


@query(f"""WITH {P_}, o AS (SELECT user_id AS k, x::DOUBLE AS e, y::DOUBLE AS n, (cents * 7 % 360)::DOUBLE AS h, row_number() OVER w - 1 AS i, lag(x) OVER w AS e0, lag(y) OVER w AS n0, lead(x) OVER w AS e2, lead(y) OVER w AS n2, lead((cents * 7 % 360)::DOUBLE) OVER w AS h2 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT k, i, e AS ae, n AS an, e2::DOUBLE AS be, n2::DOUBLE AS bn, h AS ha, h2 AS hb, {BEARING.format(e='e2 - coalesce(e0, e)', n='n2 - coalesce(n0, n)')} AS tangent, sum(coalesce(sqrt((e - e0)^2 + (n - n0)^2), 0)) OVER (PARTITION BY k ORDER BY i) AS s FROM o),
m AS (SELECT a.k, a.i AS a, b.i AS b, b.s - a.s AS travelled, {OFF.format(a=_new, b=_old)} AS between_, {OFF.format(a='b.ha', b='b.hb')} AS turned, {OFF.format(a='a.tangent', b=_new)} AS off_tangent, {OFF.format(a=_old, b='a.tangent')} < 30 AND {OFF.format(a=_new, b='b.hb')} < 30 AS aligned
 FROM g a JOIN g b ON a.k = b.k AND b.i >= a.i + 3 AND b.be IS NOT NULL AND {_side('a.a', 'a.b', 'b.a')} * {_side('a.a', 'a.b', 'b.b')} < 0 AND {_side('b.a', 'b.b', 'a.a')} * {_side('b.a', 'b.b', 'a.b')} < 0),
v AS (SELECT *, CASE WHEN between_ > 90 THEN 180 - between_ ELSE between_ END AS angle FROM m)
SELECT k, a, b, round(travelled, 4)::DOUBLE AS travelled, round(angle, 4)::DOUBLE AS angle, CASE WHEN travelled >= 45 AND turned < 45 AND (aligned OR angle < 35 AND off_tangent < 60) THEN 'curveChordArtifact' WHEN angle >= 35 THEN 'genuineCrossing' ELSE 'ambiguous' END AS verdict FROM v""")
def path_crossings(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).select(F.col("user_id").alias("k"), "t", "event_id", F.col("x").cast("double").alias("e"), F.col("y").cast("double").alias("n"), (F.col("cents") * 7 % 360).cast("double").alias("h"))
    out = revisits.crossings(rows, ["k"], ["t", "event_id"], "e", "n", "h")
    return out.select("k", "a", "b", F.round("travelled", 4).alias("travelled"), F.round("angle", 4).alias("angle"), "verdict")


@query(f"""WITH {P_}, s AS (SELECT *, CASE WHEN bn IS NULL THEN ae ELSE be END AS ce, coalesce(bn, an) AS cn FROM (SELECT user_id, x::DOUBLE AS ae, y::DOUBLE AS an, lead(x) OVER w AS be, lead(y) OVER w AS bn FROM p WHERE event_id % 5 = 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id))),
f AS (SELECT user_id, event_id, x + (cents % 9)::DOUBLE AS e, y::DOUBLE AS n FROM p WHERE event_id % 5 > 0),
l AS (SELECT *, (ce - ae)^2 + (cn - an)^2 AS l2 FROM s), q AS (SELECT user_id, event_id, e, n, ae, an, ce, cn, CASE WHEN l2 > 0 THEN greatest(0, least(1, ((e - ae) * (ce - ae) + (n - an) * (cn - an)) / l2)) ELSE 0 END AS u FROM f JOIN l USING (user_id))
SELECT user_id, round(max(off), 6)::DOUBLE AS max_off FROM (SELECT user_id, event_id, min(sqrt((e - ae - u * (ce - ae))^2 + (n - an - u * (cn - an))^2)) AS off FROM q GROUP BY ALL) GROUP BY user_id""")
def corridor_distances(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    source = p.filter("event_id % 5 = 0").select("user_id", "event_id", F.col("x").cast("double").alias("e"), F.col("y").cast("double").alias("n"))
    fitted = p.filter("event_id % 5 > 0").select("user_id", "event_id", (F.col("x") + F.col("cents") % 9).cast("double").alias("e"), F.col("y").cast("double").alias("n"))
    return revisits.corridor(fitted, source, ["user_id"], "event_id", "event_id", 60.0).filter("max_off is not null").select("user_id", F.round("max_off", 6).alias("max_off"))


FRAMES = f"""{P_}, f AS (SELECT user_id % 4 AS grp, day, user_id AS track, max(cents) AS d FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY grp, day ORDER BY d DESC, track) AS r FROM f),
n AS (SELECT *, lag(day) OVER w AS day0, lag(n) OVER w AS n0 FROM (SELECT grp, day, count(*) AS n FROM k GROUP BY ALL) WINDOW w AS (PARTITION BY grp ORDER BY day)),
c AS (SELECT n.grp, n.day, a.track, a.r, b.r AS r0 FROM n JOIN k a ON a.grp = n.grp AND a.day = n.day JOIN k b ON b.grp = n.grp AND b.day = n.day0 AND b.track = a.track),
i AS (SELECT grp, day, count(*) AS n_inversions FROM c a JOIN c b USING (grp, day) WHERE a.r0 < b.r0 AND a.r > b.r GROUP BY ALL),
s AS (SELECT grp, day, count(*) AS n_common, count(*) FILTER (r = r0) AS same FROM c GROUP BY ALL),
z AS (SELECT grp, day, coalesce(n_common, 0) AS n_common, coalesce(n_common, 0) * (coalesce(n_common, 0) - 1) // 2 AS n_pairs, least(n, n0) - coalesce(same, 0) AS n_mismatches, coalesce(n_inversions, 0) AS n_inversions FROM n LEFT JOIN s USING (grp, day) LEFT JOIN i USING (grp, day) WHERE day0 IS NOT NULL),
t AS (SELECT *, CASE WHEN n_inversions > 0 THEN 'pairwise_inversion' WHEN n_mismatches > 0 THEN 'support_change_only' END AS kind FROM z)"""


def order_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).select((F.col("user_id") % 4).alias("grp"), "day", F.col("user_id").alias("track"), F.col("cents").alias("d"))
    return ordering.transitions(rows, ["grp"], "day", "track", "d")


@query(f"WITH {FRAMES} SELECT grp, count(*) AS n_transitions, sum(n_pairs)::BIGINT AS n_pairs, sum(n_mismatches)::BIGINT AS n_mismatches, sum(n_inversions)::BIGINT AS n_inversions, count(*) FILTER (kind = 'support_change_only') AS n_support_only FROM t GROUP BY grp")
def lateral_order_audit(spark: SparkSession, d: str) -> DataFrame:
    return ordering.audit(order_rows(spark, d), ["grp"])


@query(f"""WITH {FRAMES}, ep AS (SELECT *, sum(new) OVER (PARTITION BY grp ORDER BY day) AS episode FROM (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY grp ORDER BY day))::INT AS new FROM t))
SELECT grp, kind, min(day) AS first, max(day) AS last, count(*) AS n_transitions, sum(n_inversions)::BIGINT AS n_inversions FROM ep WHERE kind IS NOT NULL GROUP BY grp, episode, kind""")
def lateral_order_episodes(spark: SparkSession, d: str) -> DataFrame:
    return ordering.episodes(order_rows(spark, d), ["grp"], "day").drop("episode")


@query(f"""WITH {P_}, v AS (SELECT event_id % 5 AS grp, 'x' AS metric, x::DOUBLE AS v FROM p UNION ALL SELECT event_id % 5, 'cents', cents::DOUBLE FROM p)
SELECT grp, metric, count(*) AS n, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, round(avg(v), 4)::DOUBLE AS mean, {", ".join(f"round(quantile_cont(v, {p / 100}), 4)::DOUBLE AS p{p}" for p in (10, 25, 50, 75, 90, 95))} FROM v GROUP BY grp, metric""")
def merged_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Three files' counts, made apart and added up."""
    rows = points(spark, d).withColumn("grp", F.col("event_id") % 5)
    parts = [partials.partial(rows.filter(F.col("day") % 3 == i), ["grp"], {"x": F.col("x"), "cents": F.col("cents")}, {}) for i in range(3)]
    return partials.summaries(partials.merged(*parts))


@query(f"WITH {P_} SELECT event_id % 5 AS grp, count(*) FILTER (cents > 20000) AS large, count(*) FILTER (x < 10) AS near FROM p GROUP BY ALL")
def merged_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).withColumn("grp", F.col("event_id") % 5)
    parts = [partials.partial(rows.filter(F.col("day") % 3 == i), ["grp"], {}, {"large": F.col("cents") > 20000, "near": F.col("x") < 10}) for i in range(3)]
    n = lambda m: F.sum(F.when(F.col("metric") == m, F.col("n")).otherwise(0)).alias(m)
    return partials.totals(partials.merged(*parts)).groupBy("grp").agg(n("large"), n("near"))


@query()
def line_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines: a day is a frame of its user, the amount a line's place aside, the vehicle 10 m further each day."""
    aside = (F.col("cents") % 24 - 12).cast("double")
    rows = points(spark, d).select("user_id", F.col("day").alias("frame"), "event_id", (2.0 * F.col("day")).alias("t"), (10.0 * F.col("day")).alias("e"), F.lit(0.0).alias("n"), F.lit(90.0).alias("heading"), F.lit(2.0).alias("accuracy"), (0.5 + F.col("w") / 8.0).alias("prob"), F.array(F.lit(4.0), F.lit(18.0), F.lit(32.0)).alias("x"), F.array(aside, aside, aside + F.col("y") / 300.0).alias("y"))
    return line_tracker.tracked(rows, ["user_id"], "frame", "event_id").withColumn("cost", F.round("cost", 6))


@query(f"""WITH {P_}, k AS (SELECT user_id % 7 AS grp, user_id * 400 + x AS track, count(*) AS n, (max(day) - min(day))::DOUBLE AS s FROM p GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY grp) AS c FROM k)
SELECT grp, count(*) AS n_tracks, count(*) FILTER (n = 1) AS n_one, count(*) FILTER (n = 2) AS n_two, count(*) FILTER (n > 2) AS n_more, max(n) AS most_frames, max(s) AS longest, round(count(*) FILTER (n = 1) / count(*)::DOUBLE, 9) AS share_one, round((sum(n) - count(*))::DOUBLE / sum(n)::DOUBLE, 9) AS share_continued, max(n) FILTER (i = c // 2) AS median_frames FROM o GROUP BY grp""")
def track_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).select((F.col("user_id") % 7).alias("grp"), "day", (F.col("user_id") * 400 + F.col("x")).alias("track"))
    return line_tracker.summarised(rows, ["grp"], "day", "day", "track").withColumns({c: F.round(c, 9) for c in ("share_one", "share_continued")})


CURVES = f"""{P_}, r AS (SELECT user_id % 8 AS grp, user_id AS curve, h::DOUBLE AS s, min((user_id % 16 // 8) * 15 + cents % 40 / 10.0 + CASE WHEN user_id % 8 = 3 THEN x / 10.0 ELSE 0 END)::DOUBLE AS d FROM p GROUP BY ALL),
b AS (SELECT grp, min(s) + 6 AS b FROM r GROUP BY grp), n AS (SELECT *, lead(s) OVER w AS s2, lead(d) OVER w AS d2, lead(s, 2) OVER w IS NULL AS ends FROM r WINDOW w AS (PARTITION BY grp, curve ORDER BY s)),
g AS (SELECT n.*, b, unnest(range(greatest(0, ceil((s - b) / 12))::BIGINT, floor((s2 - b) / 12)::BIGINT + 1)) AS k FROM n JOIN b USING (grp) WHERE s2 IS NOT NULL),
v AS (SELECT grp, curve, k, d + (d2 - d) * (b + k * 12 - s) / (s2 - s) AS d FROM g WHERE b + k * 12 < s2 OR ends)"""


def curve_samples(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    aside = F.floor(u % 16 / 8) * 15 + F.col("cents") % 40 / 10.0 + F.when(u % 8 == 3, F.col("x") / 10.0).otherwise(0.0)
    return points(spark, d).groupBy((u % 8).alias("grp"), u.alias("curve"), F.col("h").cast("double").alias("s")).agg(F.min(aside).cast("double").alias("d"))


@query(f"""WITH {CURVES}, t AS (SELECT grp, k, d, d - lag(d) OVER (PARTITION BY grp, k ORDER BY d) AS gap FROM v), m AS (SELECT grp, k, max(d) - min(d) AS spread, max(gap) AS gap, arg_min(d - gap / 2, (-gap, d - gap / 2)) FILTER (gap IS NOT NULL) AS middle FROM t GROUP BY ALL HAVING max(gap) IS NOT NULL),
f AS (SELECT *, spread > 8 AND gap > 3 AS bimodal FROM m), c AS (SELECT *, sum(new) OVER (PARTITION BY grp ORDER BY k) AS run FROM (SELECT *, (bimodal IS DISTINCT FROM lag(bimodal) OVER (PARTITION BY grp ORDER BY k))::INT AS new FROM f)),
z AS (SELECT grp, run, count(*) AS n FROM c WHERE bimodal GROUP BY ALL), br AS (SELECT grp, run FROM z WHERE n >= 5 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, run) = 1),
i AS (SELECT grp, k, middle FROM c JOIN br USING (grp, run)), l AS (SELECT grp, list_sort(list(middle))[count(*) // 2 + 1] AS level FROM i GROUP BY grp), h AS (SELECT v.* FROM v JOIN i USING (grp, k)),
o AS (SELECT grp, curve, CASE WHEN quantile_cont(d, 0.5) < any_value(level) THEN 1 ELSE 2 END AS side FROM h JOIN l USING (grp) GROUP BY ALL), q AS (SELECT grp, side, d, quantile_cont(d, 0.5) OVER (PARTITION BY grp, side) AS mid FROM h JOIN o USING (grp, curve)),
y AS (SELECT grp, side, quantile_cont(abs(d - mid), 0.5) AS mad, count(*) AS n FROM q GROUP BY ALL), x AS (SELECT grp FROM y WHERE mad <= 2.5 AND n >= 2 GROUP BY grp HAVING count(*) = 2)
SELECT a.grp, a.curve, CASE WHEN x.grp IS NULL THEN 0 ELSE coalesce(side, 3) END::INT AS part FROM (SELECT DISTINCT grp, curve FROM r) a LEFT JOIN x ON a.grp = x.grp LEFT JOIN o ON a.grp = o.grp AND a.curve = o.curve""")
def mode_splits(spark: SparkSession, d: str) -> DataFrame:
    return purity.split(curve_samples(spark, d), "grp", "curve", "s", "d", 12.0, 60.0)


@query()
def curve_strands(spark: SparkSession, d: str) -> DataFrame:
    curves = curve_samples(spark, d).groupBy("grp", "curve", F.floor(F.col("s") / 60).alias("piece")).agg(F.min("s").alias("s0"), F.max("s").alias("s1"), (F.sum("d") % 180).alias("heading"))
    named = curves.withColumn("id", F.col("curve") * 1000 + F.col("piece") % 1000)
    return purity.strands(named, ["grp"], "id", "s0", "s1", "heading").drop("piece")
