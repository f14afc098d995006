"""Queries for runs with gaps, widths and bridges; see queries.py for the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.operators import runs
from tracklark.plans.queries import DAY, E_, HOUR
from tracklark.sources.tables import events, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Events as stretches: low = cents, high = cents + 300, time in hours.
STRETCHES = f"""{E_}, o AS (SELECT event_id, user_id, t // {HOUR} AS h, cents AS low, cents + 300 AS high FROM e), l AS (SELECT *, lag(low) OVER w AS l0, lag(high) OVER w AS h0, abs(h - lag(h) OVER w) AS dt FROM o WINDOW w AS (PARTITION BY user_id ORDER BY h, event_id)),
c AS (SELECT *, low > h0 + 0.5 AS clear, CASE WHEN low > h0 + 0.5 AND low - h0 > 1500 THEN 'disconnectedSupport' WHEN dt > 72 THEN 'temporalGap' END AS reason FROM l),
n AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY h, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c)"""


def stretches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, d).select("event_id", "user_id", F.floor(F.col("t") / HOUR).alias("h"), F.col("cents").alias("low"), (F.col("cents") + 300).alias("high"))
    return runs.runs_and_gaps(rows, ["user_id"], "h", "event_id", "low", "high", 1500.0, 72.0)


@query(f"WITH {STRETCHES} SELECT user_id, run, min(low) AS s0, max(high) AS s1, count(*) AS n, count(DISTINCT h) AS n_frames FROM n GROUP BY ALL")
def track_runs(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = stretches(spark, d)
    return rows.groupBy("user_id", "run").agg(F.min("low").alias("s0"), F.max("high").alias("s1"), F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("n_frames"))


@query(f"""WITH {STRETCHES}, g AS (SELECT user_id, run - 1 AS run, CASE WHEN clear THEN h0 ELSE l0 END AS s0, CASE WHEN clear THEN low ELSE high END AS s1, dt, reason FROM n WHERE reason IS NOT NULL)
SELECT user_id, run, s0, s1, greatest(0, s1 - s0)::DOUBLE AS length, dt, reason FROM g""")
def track_gaps(spark: SparkSession, d: str) -> DataFrame:
    return stretches(spark, d)[1]


@query("""WITH w AS (SELECT l_suppkey AS k, CASE WHEN l_orderkey % 13 > 0 THEN floor(l_extendedprice / 100 + 0.5) - 300 END AS v FROM lineitem), s AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM w WHERE v IS NOT NULL),
m AS (SELECT k, v AS median FROM s WHERE i = n // 2), o AS (SELECT k, abs(v - median) AS off FROM s JOIN m USING (k)), p AS (SELECT k, off, row_number() OVER (PARTITION BY k ORDER BY off) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM o), q AS (SELECT k, off FROM p WHERE i = n // 2),
c AS (SELECT k, count(v) AS n, count(*) FILTER (v IS NULL) AS n_invalid, count(*) FILTER (v <= 0) AS n_not_positive, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, count(*) FILTER (v >= 0 AND v < 200)::DOUBLE / count(*) AS low, count(*) FILTER (v >= 200 AND v < 500)::DOUBLE / count(*) AS high FROM w GROUP BY k)
SELECT k, n, n_invalid, n_not_positive, min::DOUBLE AS min, max::DOUBLE AS max, median::DOUBLE AS median, round(mean, 6) AS mean, round(std, 6) AS std, round(1.4826 * off, 6) AS robust_spread, round(low, 6) AS low, round(high, 6) AS high FROM c JOIN m USING (k) JOIN q USING (k)""")
def width_summary(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("l_orderkey") % 13 > 0, F.floor(F.col("l_extendedprice") / 100 + 0.5) - 300)
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), v.alias("v"))
    out = runs.width_stats(rows, ["k"], "v", {"low": (0, 200), "high": (200, 500)})
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "robust_spread", "low", "high")})


@query(f"""WITH {E_}, s AS (SELECT DISTINCT user_id, t // {HOUR} AS h FROM e), g AS (SELECT user_id, (h - lag(h) OVER (PARTITION BY user_id ORDER BY h)) / 8.0 AS gap FROM s), k AS (SELECT * FROM g WHERE gap > 0.8 AND gap < 30),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM k) SELECT user_id, least(greatest(gap + 1, 6), 12)::DOUBLE AS bridge FROM r WHERE i = least(floor(n * 0.9), n - 1)""")
def bridge_limits(spark: SparkSession, d: str) -> DataFrame:
    hours = events(spark, d).select("user_id", F.floor(F.col("t") / HOUR).alias("h")).distinct()
    gaps = hours.withColumn("gap", (F.col("h") - F.lag("h").over(W.partitionBy("user_id").orderBy("h"))) / 8)
    return runs.safe_bridges(gaps, ["user_id"], "gap")


SPANS = f"""{E_}, d AS (SELECT user_id, t // {DAY} AS day, min(t // {HOUR}) AS a, max(t // {HOUR}) + 1 AS b, min(cents) AS c FROM e GROUP BY ALL),
s AS (SELECT user_id, a AS s0, b AS s1, 3 + c % 5 AS left0, -(c % 3) AS right0, 3 + c % 7 AS left1, -(c % 2) AS right1 FROM d),
x AS (SELECT *, s0 - lag(s1) OVER w AS gap, lag(left1) OVER w AS l, lag(right1) OVER w AS r FROM s WINDOW w AS (PARTITION BY user_id ORDER BY s0, s1)),
y AS (SELECT *, coalesce(gap > 0 AND gap <= 60 AND abs((left0 - right0) - (l - r)) <= 1.5 AND l - r BETWEEN 2 AND 30 AND left0 - right0 BETWEEN 2 AND 30, false) AS ok FROM x),
z AS (SELECT *, sum(CASE WHEN NOT ok AND gap IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING)::BIGINT AS surface FROM y)"""


def day_spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    day = events(spark, d).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(F.min(F.floor(F.col("t") / HOUR)).alias("s0"), (F.max(F.floor(F.col("t") / HOUR)) + 1).alias("s1"), F.min("cents").alias("c"))
    c = F.col("c")
    spans = day.select("user_id", "s0", "s1", (3 + c % 5).alias("left0"), (-(c % 3)).alias("right0"), (3 + c % 7).alias("left1"), (-(c % 2)).alias("right1"))
    return runs.bridged(spans, ["user_id"], F.lit(60.0))


@query(f"WITH {SPANS} SELECT user_id, surface, min(s0) AS s0, max(s1) AS s1, count(*) AS n FROM z GROUP BY ALL")
def bridged_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return day_spans(spark, d)[0].groupBy("user_id", "surface").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SPANS}, i AS (SELECT *, unnest(range(1, gap // 2 + 2)) AS i FROM z WHERE ok AND gap > 2)
SELECT user_id, surface, (s0 - gap + 2 * i)::DOUBLE AS s, round(l + 2 * i / gap * (left0 - l), 6)::DOUBLE AS "left", round(r + 2 * i / gap * (right0 - r), 6)::DOUBLE AS "right" FROM i WHERE 2 * i < gap - 1e-6""")
def bridge_samples(spark: SparkSession, d: str) -> DataFrame:
    return day_spans(spark, d)[1].withColumns({c: F.round(c, 6) for c in ("left", "right")})
