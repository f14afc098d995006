"""Queries for motion, chains, clusters and audits; see queries.py for the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.operators import chains, motion, surface
from tracklark.plans.queries import DAY, E_, HOUR, order_spans
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


def positions(spark: SparkSession, d: str) -> DataFrame:
    """Events as positions: hours since 1970, east and north in metres from the ids and values."""
    e = events(spark, d)
    return e.select("user_id", "event_id", (F.col("t") / HOUR).alias("h"), (F.col("cents") % 1000).cast("double").alias("east"), (F.floor(F.col("cents") / 1000) * 10).cast("double").alias("north"), "cents")


@query(f"""WITH {E_}, p AS (SELECT user_id, event_id, t, (cents % 1000)::DOUBLE AS east, (floor(cents / 1000) * 10)::DOUBLE AS north FROM e),
m AS (SELECT *, lag(east) OVER w AS e0, lag(north) OVER w AS n0, lag(t) OVER w AS t0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(sqrt((east - e0) ** 2 + (north - n0) ** 2), 6) AS step FROM m""")
def motion_steps(spark: SparkSession, d: str) -> DataFrame:
    out = motion.with_motion(positions(spark, d), ["user_id"], "h", "event_id", "east", "north")
    return out.select("event_id", F.round("step", 6).alias("step"))


@query()
def motion_headings(spark: SparkSession, d: str) -> DataFrame:
    out = motion.with_motion(positions(spark, d), ["user_id"], "h", "event_id", "east", "north").withColumn("reported", (F.col("cents") % 360).cast("double"))
    out = motion.choose_heading(out, ["user_id"], "h", "event_id", "reported", "speed", 20.0)
    return out.select("event_id", F.round("heading", 6).alias("heading"), "heading_source")


@query()
def pose_sections(spark: SparkSession, d: str) -> DataFrame:
    return motion.pose_sections(positions(spark, d), ["user_id"], "h", "event_id", "east", "north", 24.0, 2000.0, 4.0)


@query()
def passes(spark: SparkSession, d: str) -> DataFrame:
    return motion.passes(positions(spark, d), ["user_id"], "h", "event_id", "east", "north", 20.0, 500.0)


@query(f"WITH {E_}, c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT user_id, max(n) AS n FROM c GROUP BY ALL) SELECT user_id, min(event_type) AS mode, n FROM c JOIN m USING (user_id, n) GROUP BY user_id, n")
def dominant_mode(spark: SparkSession, d: str) -> DataFrame:
    return chains.mode(events(spark, d), ["user_id"], "event_type")


@query(f"""WITH {E_}, b AS (SELECT *, t // {5 * DAY} AS bin, (event_id % 100)::BIGINT AS y FROM e), m AS (SELECT user_id, bin, quantile_cont(cents, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM b GROUP BY ALL)
SELECT user_id, bin, event_id FROM b JOIN m USING (user_id, bin) QUALIFY row_number() OVER (PARTITION BY user_id, bin ORDER BY (cents - mx) ** 2 + (y - my) ** 2, event_id) = 1""")
def bin_medoids(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumns({"bin": F.floor(F.col("t") / (5 * DAY)), "y": F.col("event_id") % 100})
    return chains.medoids(rows, ["user_id", "bin"], "cents", "y", ["event_id"]).select("user_id", "bin", "event_id")


@query(f"WITH {E_} SELECT event_id, user_id, sum(cents) OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC ROWS UNBOUNDED PRECEDING) > 40000 AS evict FROM e")
def lru_eviction(spark: SparkSession, d: str) -> DataFrame:
    return chains.evicted(events(spark, d), ["user_id"], "t", "event_id", "cents", 40000).select("event_id", "user_id", "evict")


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n, sha256('q::' || l_suppkey) AS h FROM lineitem GROUP BY ALL),
r AS (SELECT l_suppkey, sum(n) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total FROM c)
SELECT l_suppkey, CASE WHEN before < 0.6 * total THEN 'calibration' ELSE 'validation' END AS split, count(*) AS n FROM lineitem JOIN r USING (l_suppkey) GROUP BY ALL""")
def quota_split(spark: SparkSession, d: str) -> DataFrame:
    return chains.quota_split(table(spark, d, "lineitem"), "l_suppkey", "q", 0.6).groupBy("l_suppkey", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
SELECT k, a.n AS before, b.n AS after, b.n - a.n AS delta, CASE WHEN b.n > a.n THEN 'improvement' WHEN b.n < a.n THEN 'regression' ELSE 'same' END AS change FROM a JOIN b USING (k)""")
def audit_deltas(spark: SparkSession, d: str) -> DataFrame:
    counts = lambda r: table(spark, d, "orders").filter(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return chains.audit_deltas(counts(0), counts(1), ["k"], "n")


@query()
def best_chains(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", (F.col("t") / HOUR).alias("s"), "cents", (1 + F.col("event_id") % 3).alias("w"))
    return chains.best_chain(rows, ["user_id"], "s", "event_id", "cents", "w", 48.0, 1500.0)


@query("""WITH p AS (SELECT p_brand AS k, (p_partkey % 50)::DOUBLE AS x, (p_partkey % 31)::DOUBLE AS y FROM part), q AS (SELECT *, 0.8 * x - 0.6 * y + 3 AS u, 0.6 * x + 0.8 * y - 2 AS v FROM p)
SELECT k, count(*) AS n, round(atan2(0.6, 0.8), 6) AS angle, 3.0 AS tx, -2.0 AS ty FROM q GROUP BY k""")
def rigid_alignment(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("k"), (F.col("p_partkey") % 50).cast("double").alias("x"), (F.col("p_partkey") % 31).cast("double").alias("y"))
    moved = p.withColumns({"u": 0.8 * F.col("x") - 0.6 * F.col("y") + 3, "v": 0.6 * F.col("x") + 0.8 * F.col("y") - 2})
    return chains.rigid_fits(moved, ["k"]).select("k", "n", *(F.round(c, 6).alias(c) for c in ("angle", "tx", "ty")))


@query("""WITH s AS (SELECT o_custkey AS k, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 1 + o_orderkey % 90 AS b FROM orders),
x AS (SELECT k, a AS s0, 1 AS d FROM s UNION ALL SELECT k, b, -1 FROM s), g AS (SELECT k, s0, sum(d) AS d FROM x GROUP BY ALL),
r AS (SELECT k, s0, lead(s0) OVER w AS s1, sum(d) OVER (PARTITION BY k ORDER BY s0 ROWS UNBOUNDED PRECEDING)::BIGINT AS lanes FROM g WINDOW w AS (PARTITION BY k ORDER BY s0)) SELECT k, s0, s1, lanes FROM r WHERE lanes > 0 AND s1 > s0""")
def lane_counts(spark: SparkSession, d: str) -> DataFrame:
    return surface.lane_counts(order_spans(spark, d), ["k"], "a", "b")


@query(f"""WITH {E_}, h AS (SELECT user_id, t // {HOUR} AS s, min(cents) AS d FROM e GROUP BY ALL), l AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) > 10 THEN 1 ELSE 0 END AS n FROM h),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l) SELECT user_id, run, min(s) AS s0, max(s) AS s1, count(*) AS n, round(sum(d)::DOUBLE / count(*), 4) AS mean_d FROM r GROUP BY ALL""")
def supported_runs(spark: SparkSession, d: str) -> DataFrame:
    hourly = events(spark, d).groupBy("user_id", F.floor(F.col("t") / HOUR).alias("s")).agg(F.min("cents").alias("d"))
    runs = surface.supported_runs(hourly, ["user_id"], "s", 10)
    return surface.run_spans(runs, ["user_id"], "s", "d").withColumn("mean_d", F.round("mean_d", 4))


@query()
def surface_strips(spark: SparkSession, d: str) -> DataFrame:
    side = lambda kind, shift: events(spark, d).filter(F.col("event_type") == kind).groupBy("user_id", (F.col("t") / HOUR).alias("s")).agg((F.max("cents") / 100 + shift).alias("d"))
    samples = surface.paired_samples(side("view", 30.0), side("click", 0.0), ["user_id"], "s", "d", 2.0, 10.0, 60.0)
    return surface.strips(samples, ["user_id"], 2.0).withColumns({c: F.round(c, 4) for c in ("mean_width", "area")})
