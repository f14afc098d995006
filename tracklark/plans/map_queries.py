"""Queries for accumulated points, profiles, clipping and selected fits; see queries.py for the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.operators import accumulate, fits, sequence
from tracklark.plans.queries import DAY, E_, HOUR
from tracklark.sources.tables import events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Events as points: h = hours, x and y from the cents, day = frame.
P_ = f"{E_}, p AS (SELECT event_id, user_id, cents, t, t // {HOUR} AS h, t // {DAY} AS day, cents % 400 AS x, event_id % 300 AS y, 1 + event_id % 3 AS w FROM e)"


def points(spark: SparkSession, d: str) -> DataFrame:
    c, i = F.col("cents"), F.col("event_id")
    return events(spark, d).select("event_id", "user_id", "cents", "t", F.floor(F.col("t") / HOUR).alias("h"), F.floor(F.col("t") / DAY).alias("day"), (c % 400).alias("x"), (i % 300).alias("y"), (1 + i % 3).alias("w"))


def middle(value: str) -> str:
    return f"(SELECT user_id, cell_e, cell_n, min({value}) AS v FROM (SELECT user_id, cell_e, cell_n, {value}, sum(w) OVER (PARTITION BY user_id, cell_e, cell_n ORDER BY {value}) AS run, sum(w) OVER (PARTITION BY user_id, cell_e, cell_n) AS total FROM c) WHERE 2 * run >= total GROUP BY ALL)"


@query(f"""WITH {P_}, c AS (SELECT *, floor(x / 100.0 + 0.5)::BIGINT AS cell_e, floor(y / 100.0 + 0.5)::BIGINT AS cell_n FROM p), g AS (SELECT user_id, cell_e, cell_n, count(*) AS n, quantile_cont(w, 0.5)::DOUBLE AS weight FROM c GROUP BY ALL)
SELECT g.*, a.v AS east, b.v AS north FROM g JOIN {middle("x")} a USING (user_id, cell_e, cell_n) JOIN {middle("y")} b USING (user_id, cell_e, cell_n)""")
def stationary_cells(spark: SparkSession, d: str) -> DataFrame:
    return accumulate.stationary_cells(points(spark, d), ["user_id"], "x", "y", "w", 100.0)


@query(f"WITH {P_} SELECT user_id, count(DISTINCT (floor(x / 100.0 + 0.5), floor(y / 100.0 + 0.5))) AS n_poses FROM p GROUP BY user_id")
def distinct_poses(spark: SparkSession, d: str) -> DataFrame:
    return accumulate.distinct_poses(points(spark, d), ["user_id"], "x", "y", 100.0)


@query(f"""WITH {P_}, s AS (SELECT user_id, event_id, h, CASE WHEN event_id % 4 > 0 THEN cents % 360 END AS heading, cents / 100 AS speed, row_number() OVER (PARTITION BY user_id ORDER BY h, event_id) AS i FROM p),
q AS (SELECT *, last_value(CASE WHEN heading IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS j FROM s),
k AS (SELECT q.*, CASE WHEN q.h - b.h <= 48 THEN q.h - b.h END AS dt, q.heading - b.heading AS turn FROM q LEFT JOIN s b ON b.user_id = q.user_id AND b.i = q.j)
SELECT event_id, dt, CASE WHEN speed >= 5 AND dt > 0 THEN round(CASE WHEN turn > 180 THEN turn - 360 WHEN turn < -180 THEN turn + 360 ELSE turn END / dt, 6) END AS turn_rate FROM k""")
def turning_context(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).withColumns({"heading": F.when(F.col("event_id") % 4 > 0, F.col("cents") % 360), "speed": F.col("cents") / 100})
    return accumulate.turning(rows, ["user_id"], "h", "event_id", "heading", "speed", 48, 5).select("event_id", "dt", F.round("turn_rate", 6).alias("turn_rate"))


@query(f"""WITH {P_}, f AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM (SELECT DISTINCT user_id, day FROM p)),
m AS (SELECT a.event_id, b.x AS bx, b.y AS by_, b.event_id AS b_id, abs(b.x - a.x - (a.event_id % 30 - 5)) AS gap FROM p a JOIN f USING (user_id, day) JOIN p b ON b.user_id = a.user_id AND b.day = f.before WHERE a.event_id % 30 > 5),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, bx, b_id) = 1)
SELECT p.event_id, CASE WHEN gap <= 20 THEN round(sqrt((x - bx) ** 2 + (y - by_) ** 2), 6) END AS disagreement FROM p LEFT JOIN k USING (event_id)""")
def frame_disagreement(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).withColumn("ahead", F.col("event_id") % 30 - 5)
    return accumulate.disagreement(rows, ["user_id"], "day", "event_id", "x", "x", "y", "ahead", 20.0).select("event_id", F.round("disagreement", 6).alias("disagreement"))


PROFILE = f"""{P_}, g AS (SELECT user_id, unnest(range(min(h), max(h) + 1, 24)) AS s FROM p GROUP BY user_id),
o AS (SELECT g.user_id, g.s, p.cents AS d FROM g JOIN p USING (user_id) QUALIFY row_number() OVER (PARTITION BY g.user_id, g.s ORDER BY abs(p.h - g.s), p.h, p.event_id) = 1)"""


def profiled(spark: SparkSession, d: str) -> DataFrame:
    return accumulate.profile(points(spark, d), ["user_id"], "event_id", "h", "cents", 24)


@query(f"WITH {PROFILE} SELECT * FROM o")
def d_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiled(spark, d)


@query(f"WITH {PROFILE}, a AS (SELECT user_id // 2 AS pair, user_id % 2 AS side, s // 24 AS s, d FROM o) SELECT a.pair, count(*) AS n, round(sqrt(avg((a.d - b.d) ** 2)), 6) AS rmse FROM a JOIN a b ON a.pair = b.pair AND a.s = b.s WHERE a.side = 0 AND b.side = 1 GROUP BY a.pair")
def profile_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = profiled(spark, d).select(F.floor(F.col("user_id") / 2).alias("pair"), (F.col("user_id") % 2).alias("side"), F.floor(F.col("s") / 24).alias("s"), "d")
    out = accumulate.profile_rmse(rows.filter("side = 0"), rows.filter("side = 1"), ["pair"])
    return out.withColumn("rmse", F.round("rmse", 6))


@query(f"""WITH {P_}, b AS (SELECT user_id, least(0, min(x - 150)) AS w, greatest(0, max(x - 150)) AS e, least(0, min(y)) AS s, greatest(0, max(y)) AS n FROM p GROUP BY user_id)
SELECT user_id, round(w - greatest(5, (e - w) * 0.08), 6)::DOUBLE AS min_e, round(e + greatest(5, (e - w) * 0.08), 6)::DOUBLE AS max_e, round(s - greatest(5, (n - s) * 0.08), 6)::DOUBLE AS min_n, round(n + greatest(5, (n - s) * 0.08), 6)::DOUBLE AS max_n FROM b""")
def map_bounds(spark: SparkSession, d: str) -> DataFrame:
    out = accumulate.bounds(points(spark, d).withColumn("x", F.col("x") - 150), ["user_id"], "x", "y")
    return out.withColumns({c: F.round(c, 6) for c in out.columns[1:]})


@query(f"""WITH {P_}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > {12 * HOUR} THEN 1 ELSE 0 END AS n FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session, lead(n) OVER w AS ends, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
d AS (SELECT user_id, session, session + 1 AS next_chunk, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS gap FROM s WHERE ends = 1)
SELECT user_id, session, next_chunk, round(gap, 6) AS gap FROM d WHERE gap > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, session) = 1""")
def largest_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = sequence.sessionize(points(spark, d), ["user_id"], "t", "event_id", 12 * HOUR)
    return accumulate.largest_gap(rows, ["user_id"], "session", ["t", "event_id"], "x", "y").withColumn("gap", F.round("gap", 6))


@query(f"""WITH {P_}, v AS (SELECT user_id, t, event_id, CASE WHEN event_id % 5 > 0 THEN sign(cents // 100 - 12) END AS s FROM p), k AS (SELECT *, last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM v)
SELECT user_id, t FROM k WHERE s <> 0 AND past <> s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) = 1""")
def first_sign_change(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).withColumn("v", F.when(F.col("event_id") % 5 > 0, F.floor(F.col("cents") / 100) - 12))
    return accumulate.first_sign_change(rows, ["user_id"], ["t", "event_id"], "t", "v")


@query(f"WITH {P_} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY x, y DESC, event_id) AS place FROM p QUALIFY place <= 64")
def best_buckets(spark: SparkSession, d: str) -> DataFrame:
    return accumulate.best_of(points(spark, d), ["user_id"], ["x", F.desc("y"), "event_id"]).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {P_}, b AS (SELECT event_id, x, y, 20 + cents % 90 AS w, 30 + cents % 70 AS h, lag(x) OVER k AS x0, lag(y) OVER k AS y0 FROM p WINDOW k AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, (greatest(0, least(x + w, x0 + 150) - greatest(x, x0)) * greatest(0, least(y + h, y0 + 120) - greatest(y, y0)))::DOUBLE AS area FROM b WHERE x0 IS NOT NULL""")
def clipped_areas(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    rows = points(spark, d).withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w)}).filter("x0 is not null")
    corner = lambda e, n: F.struct(e.cast("double").alias("e"), n.cast("double").alias("n"))
    box = lambda e, n, a, b: F.array(corner(e, n), corner(e + a, n), corner(e + a, n + b), corner(e, n + b))
    own = box(F.col("x"), F.col("y"), 20 + F.col("cents") % 90, 30 + F.col("cents") % 70)
    part = rows.select("event_id", accumulate.clipped(own, box(F.col("x0"), F.col("y0"), F.lit(150), F.lit(120))).alias("ring"))
    return part.select("event_id", F.round(accumulate.ring_area(F.col("ring")), 6).alias("area"))


@query()
def selected_curves(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d)
    out = fits.selected_fits(rows, ["user_id"], "h", "cents", F.col("day") % 5)
    return out.select("user_id", "strength", "n", F.round("held_out", 6).alias("held_out"), F.round("rmse", 6).alias("rmse"))
