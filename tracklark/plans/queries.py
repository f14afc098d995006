"""Queries over the driver tables, one per operator family, with SQL for DuckDB.

`events` stands in for observations: user = key, t = clock, seconds since the user's first event = along-track position, value in
cents = lateral value. Integers keep sums independent of their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions import scalars as S
from tracklark.operators import evaluation, fits, folds, intervals, joins, sequence, statistics, temporal
from tracklark.sources.tables import events, micros, table

HOUR = 3_600_000_000
DAY = 24 * HOUR
QUERIES: dict = {}
SQL: dict[str, str] = {}
E_ = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, floor(value * 100 + 0.5)::BIGINT AS cents, value FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH {E_}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > {6 * HOUR} THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS n_events, sum(cents)::BIGINT AS cents, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY user_id, session
""")
def sessionize(spark: SparkSession, d: str) -> DataFrame:
    rows = sequence.sessionize(events(spark, d), ["user_id"], "t", "event_id", 6 * HOUR)
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.sum("cents").alias("cents"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"""
WITH {E_}, p AS (SELECT *, t - lag(t) OVER w AS dt, abs(cents - lag(cents) OVER w) AS dv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT *, CASE WHEN dt > {12 * HOUR} THEN 'timeGap' WHEN dv > 5000 THEN 'jump' WHEN event_type = 'error' AND dt IS NOT NULL THEN 'minorTurn' END AS reason FROM p),
s AS (SELECT *, sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) OVER w AS chunk, sum(CASE WHEN reason <> 'minorTurn' THEN 1 ELSE 0 END) OVER w AS session
 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, session::BIGINT AS session, chunk::BIGINT AS chunk, count(*) AS n_events, sum(cents)::BIGINT AS cents, min(reason) AS min_reason FROM s GROUP BY ALL
""")
def sessionize_compound(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, d).withColumns({"dt": F.col("t") - F.lag("t").over(w), "dv": F.abs(F.col("cents") - F.lag("cents").over(w))})
    reason = S.first_reason(("timeGap", F.col("dt") > 12 * HOUR), ("jump", F.col("dv") > 5000), ("minorTurn", (F.col("event_type") == "error") & F.col("dt").isNotNull()))
    out = sequence.sessionize_compound(rows, ["user_id"], "t", "event_id", reason, "minorTurn")
    return out.groupBy("user_id", "session", "chunk").agg(F.count(F.lit(1)).alias("n_events"), F.sum("cents").alias("cents"), F.min("reason").alias("min_reason"))


@query(f"""
WITH {E_}, g AS (SELECT *, CASE WHEN abs(cents - lag(cents) OVER w) > 3000 THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g),
k AS (SELECT user_id, island, count(*) AS island_rows FROM s GROUP BY ALL), c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY island_rows DESC, island) = 1)
SELECT s.user_id, s.island, island_rows, min(t) AS first_t, max(t) AS last_t FROM s JOIN c USING (user_id, island) GROUP BY ALL
""")
def longest_island(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    rows = sequence.longest_island(events(spark, d), ["user_id"], ["t", "event_id"], F.abs(F.col("cents") - F.lag("cents").over(w)) > 3000)
    return rows.groupBy("user_id", "island", "island_rows").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"""
WITH {E_}, s AS (SELECT *, coalesce(abs(cents - lag(cents) OVER (PARTITION BY user_id ORDER BY t, event_id)), 0) AS step FROM e),
r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS s1 FROM s)
SELECT event_id, user_id, (s1 - step)::BIGINT AS s0, s1 FROM r
""")
def arc_length(spark: SparkSession, d: str) -> DataFrame:
    step = F.abs(F.col("cents") - F.lag("cents").over(W.partitionBy("user_id").orderBy("t", "event_id")))
    rows = events(spark, d).withColumn("step", F.coalesce(step, F.lit(0)))
    out = sequence.running_length(rows, ["user_id"], ["t", "event_id"], F.col("step"), "s1")
    return out.select("event_id", "user_id", (F.col("s1") - F.col("step")).alias("s0"), "s1")


@query(f"""
WITH {E_} SELECT event_id, user_id, cents FROM (SELECT *, max(cents) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
WHERE top IS NULL OR cents >= top
""")
def monotonic_filter(spark: SparkSession, d: str) -> DataFrame:
    return sequence.above_running_max(events(spark, d), ["user_id"], ["t", "event_id"], "cents").select("event_id", "user_id", "cents")


@query(f"""
WITH {E_}, v AS (SELECT t // {DAY} AS day, event_type, sum(cents)::BIGINT AS total FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, event_type) AS rank FROM v),
b AS (SELECT *, lag(rank) OVER (PARTITION BY event_type ORDER BY day) AS before FROM r)
SELECT event_type, count(*) AS n_frames, count(*) FILTER (rank <> before) AS n_changes FROM b GROUP BY event_type
""")
def rank_change_count(spark: SparkSession, d: str) -> DataFrame:
    daily = events(spark, d).groupBy(F.floor(F.col("t") / DAY).alias("day"), "event_type").agg(F.sum("cents").alias("total"))
    return sequence.rank_changes(daily, ["day"], "event_type", "total", ["day"])


@query(f"""
WITH {E_}, a AS (SELECT *, sum(cents) OVER w AS s, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT event_id, round(CASE WHEN n = 5 THEN cents + greatest(-800.0, least(800.0, s / 5.0 - cents)) ELSE cents END, 3)::DOUBLE AS smooth FROM a
""")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    out = sequence.centred_average(events(spark, d), ["user_id"], ["t", "event_id"], "cents", 2, 800.0, "smooth")
    return out.select("event_id", F.round(F.col("smooth").cast("double"), 3).alias("smooth"))


@query(f"""
WITH {E_}, p AS (SELECT *, lead(t) OVER w AS t2, lead(cents) OVER w AS c2, lead(event_id) OVER w AS id2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, id2 AS next_event_id, t2 - t AS dt, c2 - cents AS dv, CASE WHEN t2 > t THEN round((c2 - cents) * 1000000.0 / (t2 - t), 6) END AS rate FROM p WHERE id2 IS NOT NULL
""")
def lag_metrics_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = sequence.consecutive_pairs(events(spark, d), ["user_id"], ["t", "event_id"], ["t", "cents", "event_id"])
    dt, dv = F.col("next_t") - F.col("t"), F.col("next_cents") - F.col("cents")
    return p.select("event_id", "next_event_id", dt.alias("dt"), dv.alias("dv"), F.when(dt > 0, F.round(dv * 1000000.0 / dt, 6)).alias("rate"))


@query(f"""
WITH {E_}, q AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'), f AS (SELECT user_id, t, max(cents) AS cents FROM e WHERE event_type = 'view' GROUP BY ALL),
j AS (SELECT q.*, b.t AS bt, b.cents AS bc, a.t AS nt, a.cents AS ac FROM q ASOF LEFT JOIN f b ON q.user_id = b.user_id AND q.t >= b.t ASOF LEFT JOIN f a ON q.user_id = a.user_id AND q.t <= a.t)
SELECT event_id, user_id, t, round(CASE WHEN bt IS NOT NULL AND nt IS NOT NULL THEN CASE WHEN nt = bt THEN bc ELSE bc + (ac - bc) * ((t - bt)::DOUBLE / (nt - bt)) END
 WHEN bt IS NOT NULL AND t - bt <= {DAY} THEN bc WHEN nt IS NOT NULL AND nt - t <= {DAY} THEN ac END, 4)::DOUBLE AS cents FROM j
""")
def asof_interpolate(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    points = e.filter("event_type = 'purchase'").select("user_id", "t", "event_id")
    fixes = e.filter("event_type = 'view'").groupBy("user_id", "t").agg(F.max("cents").alias("cents"))
    out = temporal.asof_interpolate(points, fixes, "user_id", "t", "cents", DAY)
    return out.select("event_id", "user_id", "t", F.round("cents", 4).alias("cents"))


@query(f"""
WITH {E_}, q AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'), f AS (SELECT user_id, t, min(event_id) AS id FROM e WHERE event_type = 'view' GROUP BY ALL),
j AS (SELECT q.*, q.t - b.t AS bg, b.id AS bi, a.t - q.t AS ag, a.id AS ai FROM q ASOF LEFT JOIN f b ON q.user_id = b.user_id AND q.t >= b.t ASOF LEFT JOIN f a ON q.user_id = a.user_id AND q.t <= a.t)
SELECT event_id, user_id, CASE WHEN ag IS NULL OR bg <= ag THEN bi ELSE ai END AS nearest_id, CASE WHEN ag IS NULL OR bg <= ag THEN bg ELSE ag END AS gap FROM j
""")
def nearest_event(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    points = e.filter("event_type = 'purchase'").select("user_id", "t", "event_id")
    out = temporal.nearest(points, e.filter("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("nearest_id")), "user_id", "t", "nearest_id")
    return out.select("event_id", "user_id", "nearest_id", "gap")


SESSIONS_SQL = f"""{E_}, v AS (SELECT * FROM e WHERE event_type = 'view'), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {6 * HOUR} THEN 1 ELSE 0 END AS n FROM v),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g),
spans AS (SELECT user_id, session, min(t) AS a, max(t) AS b FROM s GROUP BY ALL)"""


@query(f"WITH {SESSIONS_SQL} SELECT e.event_id, e.user_id, coalesce(session, -1) AS session FROM e LEFT JOIN spans ON e.user_id = spans.user_id AND t BETWEEN a AND b WHERE event_type <> 'view'")
def range_join_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    s = sequence.sessionize(e.filter("event_type = 'view'"), ["user_id"], "t", "event_id", 6 * HOUR)
    spans = s.groupBy("user_id", "session").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    out = temporal.in_spans(e.filter("event_type != 'view'").select("event_id", "user_id", "t"), spans, "user_id", "t", "a", "b", "session")
    return out.select("event_id", "user_id", F.coalesce("session", F.lit(-1).cast("long")).alias("session"))


SPANS_SQL = f"s AS (SELECT o_orderkey AS id, o_custkey AS k, epoch_us(o_orderdate) // {DAY} AS a, epoch_us(o_orderdate) // {DAY} + 1 + o_orderkey % 90 AS b, o_orderstatus AS layer FROM orders)"


def order_spans(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(micros("o_orderdate") / DAY)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), day.alias("a"), (day + 1 + F.col("o_orderkey") % 90).alias("b"), F.col("o_orderstatus").alias("layer"))


UNION_SQL = """{0}_t AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {1}),
{0}_g AS (SELECT *, sum(CASE WHEN top IS NULL OR a > top THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM {0}_t),
{0} AS (SELECT k, min(a) AS a, max(b) AS b FROM {0}_g GROUP BY k, g)"""


@query(f"WITH {SPANS_SQL}, {UNION_SQL.format('u', 's')} SELECT k, sum(b - a)::BIGINT AS length, count(*) AS n_parts FROM u GROUP BY k")
def interval_union_length(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union_length(order_spans(spark, d), ["k"], "a", "b")


@query(f"""WITH {SPANS_SQL}, so AS (SELECT * FROM s WHERE layer = 'O'), sf AS (SELECT * FROM s WHERE layer = 'F'), {UNION_SQL.format('uo', 'so')}, {UNION_SQL.format('uf', 'sf')}
SELECT uo.k, greatest(uo.a, uf.a) AS a, least(uo.b, uf.b) AS b FROM uo JOIN uf ON uo.k = uf.k AND least(uo.b, uf.b) > greatest(uo.a, uf.a)""")
def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    s = order_spans(spark, d)
    return intervals.intersect(s.filter("layer = 'O'"), s.filter("layer = 'F'"), ["k"], "a", "b")


@query(f"""WITH {SPANS_SQL}, so AS (SELECT * FROM s WHERE layer = 'O'), sf AS (SELECT * FROM s WHERE layer = 'F'), {UNION_SQL.format('uo', 'so')}, {UNION_SQL.format('uf', 'sf')},
days AS (SELECT k, unnest(range(a, b)) AS x FROM uo), gone AS (SELECT k, unnest(range(a, b)) AS x FROM uf), kept AS (SELECT * FROM days EXCEPT SELECT * FROM gone),
i AS (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM kept) SELECT k, min(x) AS a, max(x) + 1 AS b FROM i GROUP BY k, g""")
def interval_except(spark: SparkSession, d: str) -> DataFrame:
    s = order_spans(spark, d)
    return intervals.subtract(s.filter("layer = 'O'"), s.filter("layer = 'F'"), ["k"], "a", "b")


@query(f"WITH {SPANS_SQL} SELECT x.k, x.id AS id_a, y.id AS id_b, least(x.b, y.b) - greatest(x.a, y.a) AS shared FROM s x JOIN s y ON x.k = y.k AND x.id < y.id WHERE least(x.b, y.b) - greatest(x.a, y.a) >= 5")
def interval_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_pairs(order_spans(spark, d), ["k"], "id", "a", "b", 5)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""WITH a AS (SELECT o_custkey AS k, arg_min(o_orderstatus, o_orderkey) AS left_status FROM orders WHERE o_orderstatus <> 'O' GROUP BY k),
b AS (SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) AS right_priority FROM orders WHERE o_orderstatus = 'O' GROUP BY k)
SELECT k, left_status, right_priority, CASE WHEN left_status IS NOT NULL AND right_priority IS NOT NULL THEN 'joined' WHEN left_status IS NOT NULL THEN 'leftOnly' ELSE 'rightOnly' END AS side FROM a FULL JOIN b USING (k)""")
def full_outer_audit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    a = joins.first_of(o.filter("o_orderstatus != 'O'"), ["k"], ["o_orderkey"]).select("k", F.col("o_orderstatus").alias("left_status"))
    b = joins.first_of(o.filter("o_orderstatus = 'O'"), ["k"], ["o_orderkey"]).select("k", F.col("o_orderpriority").alias("right_priority"))
    return joins.audit_join(a, b, ["k"])


@query("""SELECT p_brand, p_partkey, p_retailprice, coalesce(lead(p_partkey) OVER w, -1) AS right_p_partkey, lead(p_retailprice) OVER w AS right_p_retailprice FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)""")
def right_neighbor(spark: SparkSession, d: str) -> DataFrame:
    return joins.next_below(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_partkey", "p_retailprice").fillna(-1, ["right_p_partkey"])


@query("""WITH p AS (SELECT s_nationkey AS k, s_suppkey AS a, c_custkey AS b, -abs(s_acctbal - c_acctbal) AS score FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE abs(s_acctbal - c_acctbal) < 500)
SELECT k, a, b, round(score, 4) AS score FROM p QUALIFY row_number() OVER (PARTITION BY k, a ORDER BY score DESC, b) = 1 AND row_number() OVER (PARTITION BY k, b ORDER BY score DESC, a) = 1""")
def mutual_best(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("v"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("b"), F.col("c_acctbal").alias("v"))
    off = F.abs(F.col("a_value") - F.col("b_value"))
    pairs = joins.nearest_pairs(s, c, ["k"], "a", "b", "v").filter(off < 500).select("k", "a", "b", (-off).alias("score"))
    return joins.mutual_best(pairs, ["k"], "a", "b", "score").withColumn("score", F.round("score", 4))


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 37 % 301)::DOUBLE AS x, (p_partkey * 91 % 307)::DOUBLE AS y FROM part)
SELECT a.id, b.id AS id_b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM p a JOIN p b ON abs(a.x - b.x) <= 12 AND abs(a.y - b.y) <= 12 AND a.id < b.id
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144""")
def grid_radius_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 301).cast("double").alias("x"), (F.col("p_partkey") * 91 % 307).cast("double").alias("y"))
    return joins.within_radius(p, p, "x", "y", 12.0, 6).filter("id < id_b").select("id", "id_b", "distance")


@query(f"""WITH {E_}, o AS (SELECT *, t // {HOUR} AS h FROM e)
SELECT a.user_id, a.event_id, count(DISTINCT b.event_type) AS support FROM o a JOIN o b ON a.user_id = b.user_id AND abs(a.h - b.h) <= 4 AND abs(a.cents - b.cents) <= 500 GROUP BY ALL""")
def band_support(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("h", F.floor(F.col("t") / HOUR))
    return joins.band_support(rows, ["user_id"], "event_id", "h", "cents", "event_type", 4, 500)


@query("""WITH a AS (SELECT c_nationkey AS nation FROM customer), b AS (SELECT s_nationkey AS nation FROM supplier)
SELECT nation, side, count(*) AS n FROM ((SELECT nation, 'leftOnly' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT nation, 'rightOnly' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))) GROUP BY ALL""")
def set_difference_audit(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return joins.set_difference_audit(a, b).groupBy("nation", "side").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT l_suppkey AS k, floor(l_extendedprice * 100 + 0.5)::BIGINT AS v FROM lineitem), m AS (SELECT k, quantile_cont(v, 0.5) AS median FROM l GROUP BY k),
o AS (SELECT k, v, median, abs(v - median) AS dev FROM l JOIN m USING (k)), s AS (SELECT k, median(dev) AS mad FROM o GROUP BY k)
SELECT k, median::DOUBLE AS median, mad::DOUBLE AS mad, count(*) FILTER (dev > 3 * mad) AS n_out FROM o JOIN s USING (k) GROUP BY ALL""")
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("v"))
    return statistics.with_mad(rows, ["k"], "v").groupBy("k", "median", "mad").agg(F.count_if(F.col("deviation") > 3 * F.col("mad")).alias("n_out"))


@query("""WITH l AS (SELECT l_suppkey AS k, floor(l_extendedprice * 100 + 0.5)::BIGINT AS v, l_quantity::BIGINT AS w FROM lineitem), g AS (SELECT k, v, sum(w) AS w FROM l GROUP BY ALL),
r AS (SELECT k, v, sum(w) OVER (PARTITION BY k ORDER BY v) AS run, sum(w) OVER (PARTITION BY k) AS total FROM g) SELECT k, min(v) AS weighted_median FROM r WHERE 2 * run >= total GROUP BY k""")
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("v"), F.col("l_quantity").cast("long").alias("w"))
    return statistics.weighted_median(rows, ["k"], "v", "w")


@query("SELECT l_suppkey AS k, list_sort(list(l_extendedprice))[(count(*) // 2 + 1)::INT] AS upper_median FROM lineitem GROUP BY k")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return statistics.upper_median(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "k"), ["k"], "l_extendedprice")


@query("SELECT (CASE WHEN l_extendedprice >= 0 AND l_extendedprice < 20000 THEN floor(l_extendedprice / 1000) ELSE 19 END)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY bin")
def histogram_overflow(spark: SparkSession, d: str) -> DataFrame:
    return statistics.histogram(table(spark, d, "lineitem"), "l_extendedprice", 0.0, 20000.0, 20)


@query("""SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag""")
def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    return statistics.summary(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("""SELECT grouping(l_returnflag, l_linestatus, l_linenumber)::BIGINT AS dims, coalesce(l_returnflag, l_linestatus, l_linenumber::VARCHAR) AS key, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber))""")
def grouping_sets_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    out = rows.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().cast("long").alias("dims"), F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return out.select("dims", F.coalesce("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("key"), "n", "quantity")


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_totalprice > 200000) AS n_large, count(DISTINCT o_custkey) AS n_customers, min(o_orderkey) AS first_key FROM orders GROUP BY ALL""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"), F.count_distinct("o_custkey").alias("n_customers"), F.min("o_orderkey").alias("first_key"))


ROBUST_SQL = f"""{E_}, b AS (SELECT user_id, t // {2 * DAY} AS bin, cents AS v, 1 + event_id % 5 AS w FROM e), m AS (SELECT user_id, bin, median(v) AS med FROM b GROUP BY ALL),
o AS (SELECT b.*, abs(v - med) AS dev FROM b JOIN m USING (user_id, bin)), s AS (SELECT user_id, bin, greatest(median(dev), 30.0) AS mad FROM o GROUP BY ALL),
x AS (SELECT o.*, mad, dev <= 3 * mad AS inl FROM o JOIN s USING (user_id, bin)), c AS (SELECT user_id, bin, count(*) AS n_rows, count(*) FILTER (inl) AS n_inliers FROM x GROUP BY ALL),
g AS (SELECT user_id, bin, v, sum(w) AS w FROM x WHERE inl GROUP BY ALL), r AS (SELECT user_id, bin, v, sum(w) OVER (PARTITION BY user_id, bin ORDER BY v) AS run, sum(w) OVER (PARTITION BY user_id, bin) AS tot FROM g),
f AS (SELECT user_id, bin, min(v) AS wm FROM r WHERE 2 * run >= tot GROUP BY ALL)"""


@query(f"WITH {ROBUST_SQL} SELECT c.*, CASE WHEN n_inliers >= 3 THEN wm END::DOUBLE AS fused, CASE WHEN n_inliers < 3 THEN 'tooFewInliers' END AS reject FROM c LEFT JOIN f USING (user_id, bin)")
def robust_bin_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("w", 1 + F.col("event_id") % 5)
    return statistics.robust_bins(rows, ["user_id"], F.floor(F.col("t") / (2 * DAY)), "cents", "w", floor=30.0).withColumn("fused", F.col("fused").cast("double"))


@query(f"""WITH {E_}, g AS (SELECT *, CASE WHEN cents - lag(cents) OVER (PARTITION BY user_id ORDER BY cents, event_id) > 150 THEN 1 ELSE 0 END AS n FROM e),
c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY cents, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g) SELECT user_id, cluster, count(*) AS n, min(cents) AS low, max(cents) AS high FROM c GROUP BY ALL""")
def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.gap_clusters(events(spark, d), ["user_id"], "cents", "event_id", 150)
    return out.groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("cents").alias("low"), F.max("cents").alias("high"))


@query(f"""WITH {E_}, r AS (SELECT user_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY cents, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT user_id, greatest(100.0, least(5000.0, cents))::DOUBLE AS value FROM r WHERE i = least(floor(n * 0.9), n - 1)""")
def floor_index_percentile(spark: SparkSession, d: str) -> DataFrame:
    return statistics.floor_index_percentile(events(spark, d), ["user_id"], "cents", "event_id", 0.9, 100.0, 5000.0)


@query(f"""WITH {E_} SELECT user_id, t // {5 * DAY} AS bin, count(*) AS n, count(DISTINCT event_type) AS n_types, round(sum(cents)::BIGINT::DOUBLE / count(*), 4) AS mean, min(cents) AS low, round((count(*) * sum(cents * cents)::BIGINT - sum(cents)::BIGINT * sum(cents)::BIGINT)::DOUBLE / (count(*) * count(*)), 4) AS variance FROM e GROUP BY ALL""")
def bin_variance_support(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id", F.floor(F.col("t") / (5 * DAY)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("n_types"), F.round(F.sum("cents") / F.count(F.lit(1)), 4).alias("mean"), F.min("cents").alias("low"), F.round((F.count(F.lit(1)) * F.sum(F.col("cents") * F.col("cents")) - F.sum("cents") * F.sum("cents")) / (F.count(F.lit(1)) * F.count(F.lit(1))), 4).alias("variance"))


RULE = "(n_chars >= 300 AND lang = 'en')"
CONFUSION_SQL = f"""l AS (SELECT lang, n_chars, {RULE} AS said, quality = 1 AS truth FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM l GROUP BY lang)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id").filter("quality is not null")


@query(f"WITH {CONFUSION_SQL} SELECT * FROM c")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(labelled(spark, d), ["lang"], F.expr(RULE), F.col("quality") == 1)


def _rate(a: str, b: str, zero: str) -> str:
    return f"coalesce(({a}) / nullif(({b})::DOUBLE, 0), {zero})"


def _metrics_sql(zero: str) -> str:
    p, r, s = _rate("tp", "tp + fp", zero), _rate("tp", "tp + fn", zero), _rate("tn", "tn + fp", zero)
    f, a = _rate("2 * tp", "2 * tp + fp + fn", zero), _rate("tp + tn", "tp + fp + fn + tn", zero)
    g = _rate("2 * tn", "2 * tn + fp + fn", zero)
    return f"*, round({p}, 4) AS precision, round({r}, 4) AS recall, round({f}, 4) AS f1, round({a}, 4) AS accuracy, round(({r} + {s}) / 2, 4) AS balanced_accuracy, round(({f} + {g}) / 2, 4) AS macro_f1"


@query(f"WITH {CONFUSION_SQL} SELECT {_metrics_sql('NULL')} FROM c")
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(confusion_matrix(spark, d))


@query(f"WITH {CONFUSION_SQL} SELECT {_metrics_sql('0')} FROM c")
def classification_metrics_zero(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(confusion_matrix(spark, d), zero=0.0)


@query(f"""WITH p AS (SELECT unnest([100.0, 300.0, 1000.0, 3000.0]) AS least_chars), l AS (SELECT least_chars, n_chars >= least_chars AS said, quality = 1 AS truth FROM documents JOIN labels USING (doc_id), p),
c AS (SELECT least_chars::DOUBLE AS least_chars, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM l GROUP BY ALL)
SELECT {_metrics_sql('NULL')} FROM c""")
def param_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.sweep(labelled(spark, d), "least_chars", [100.0, 300.0, 1000.0, 3000.0], F.col("n_chars") >= F.col("least_chars"), F.col("quality") == 1)


@query("SELECT CASE WHEN a AND b THEN 'keptYes' WHEN a THEN 'lost' WHEN b THEN 'gained' ELSE 'keptNo' END AS change, count(*) AS n FROM (SELECT n_chars >= 300 AS a, n_chars >= 1000 OR lang = 'de' AS b FROM documents) GROUP BY change")
def decision_change(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.decision_change(table(spark, d, "documents"), F.expr("n_chars >= 300"), F.expr("n_chars >= 1000 OR lang = 'de'"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang FROM r WHERE i % ceil(n / 20.0)::BIGINT = 0""")
def stratified_stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.stride_sample(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 20)


@query("SELECT doc_id, CASE WHEN ('0x' || sha256('seed-1::' || doc_id)[1:8])::BIGINT % 100 < 70 THEN 'calibration' ELSE 'validation' END AS split FROM documents")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", "seed-1", 70)


@query("SELECT l_orderkey, l_linenumber, ((dense_rank() OVER (ORDER BY l_suppkey)) - 1) % 5 AS fold FROM lineitem")
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.folds(table(spark, d, "lineitem"), "l_suppkey", 5).select("l_orderkey", "l_linenumber", F.col("fold").cast("long").alias("fold"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, least(i // 25, CASE WHEN n % 25 >= 20 THEN n // 25 ELSE greatest(n // 25 - 1, 0) END)::BIGINT AS batch FROM r""")
def review_batches(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.batches(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 25, 20)


@query("""SELECT event_id, CASE WHEN value < 5 THEN '<5m' WHEN value < 20 THEN '5m-20m' WHEN value >= 20 THEN '>=20m' END AS bucket,
concat_ws(',', CASE WHEN value > 20 THEN 'large' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN event_id % 10 = 0 THEN 'tenth' END) AS flags FROM events""")
def bucket_labels(spark: SparkSession, d: str) -> DataFrame:
    flags = S.all_reasons(("large", F.col("value") > 20), ("error", F.col("event_type") == "error"), ("tenth", F.col("event_id") % 10 == 0))
    return table(spark, d, "events").select("event_id", S.bucket("value", [5, 20], "m").alias("bucket"), F.array_join(flags, ",").alias("flags"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS last_number, regexp_matches(lower(url), 'item|page') AS mentions FROM pages")
def regex_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1).alias("last_number"), F.lower("url").rlike("item|page").alias("mentions"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id, count(*) AS n, count(*) FILTER (v > 0) AS n_positive, max(v) AS high, arg_max(i, v)::BIGINT - 1 AS high_at FROM x GROUP BY vec_id""")
def array_explode_stats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return x.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") > 0).alias("n_positive"), F.max("v").alias("high"), F.max_by("i", "v").cast("long").alias("high_at"))


@query("""SELECT event_id, round(((value * 40 % 360) + 360) % 360, 6) AS heading, round(abs(CASE WHEN ((value * 40 - 90) % 360 + 360) % 360 > 180 THEN ((value * 40 - 90) % 360 + 360) % 360 - 360 ELSE ((value * 40 - 90) % 360 + 360) % 360 END), 6) AS off_east,
floor(value + 0.5)::BIGINT AS rounded FROM events""")
def angle_functions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") * 40
    return table(spark, d, "events").select("event_id", F.round(S.normalize_deg(v), 6).alias("heading"), F.round(S.bearing_difference(v, F.lit(90.0)), 6).alias("off_east"), S.half_up("value").alias("rounded"))


@query("""SELECT event_id, round(value * 0.001 * 111320.0 * cos(radians(1.3)), 5) AS east, round((event_id % 100) * 0.0001 * 110540.0, 5) AS north FROM events""")
def local_coordinates(spark: SparkSession, d: str) -> DataFrame:
    e, n = S.to_local(F.lit(1.3) + (F.col("event_id") % 100) * 0.0001, F.lit(103.9) + F.col("value") * 0.001, F.lit(1.3), F.lit(103.9))
    return table(spark, d, "events").select("event_id", F.round(e, 5).alias("east"), F.round(n, 5).alias("north"))


@query("""SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN 'invalidNumber' WHEN value > 60 THEN 'range' WHEN value < 0.05 THEN 'nearZero' WHEN event_type = 'error' THEN 'noFix' END AS reason FROM events""")
def validate_records(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    reason = S.first_reason(("invalidNumber", v.isNull() | F.isnan(v)), ("range", v > 60), ("nearZero", v < 0.05), ("noFix", F.col("event_type") == "error"))
    return table(spark, d, "events").select("event_id", reason.alias("reason"))


@query("SELECT field, n_rows, n_rows AS n_present FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus']) AS field), (SELECT count(*) AS n_rows FROM orders)")
def schema_presence(spark: SparkSession, d: str) -> DataFrame:
    from tracklark.sources.tables import presence

    return presence(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


@query()
def hysteresis_states(spark: SparkSession, d: str) -> DataFrame:
    instant = F.when(F.col("cents") < 500, "stationary").when(F.col("cents") < 1500, "creeping").otherwise("moving")
    rows = events(spark, d).select("user_id", "event_id", "t", instant.alias("instant"))
    return folds.hysteresis_states(rows, ["user_id"], ["t", "event_id"], "instant", {"moving": 2, "stationary": 3})


@query()
def stationary_lock(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", (F.col("t") / 1e6 / 3600).alias("h"), (F.col("cents") / 1000).alias("speed"))
    return folds.stationary_lock(rows, ["user_id"], "h", "event_id", "speed", dwell=6.0)


@query()
def spike_filter(spark: SparkSession, d: str) -> DataFrame:
    return folds.keep_against_last(events(spark, d).select("user_id", "event_id", "t", "cents"), ["user_id"], ["t", "event_id"], "cents", 2500)


@query()
def thin_points(spark: SparkSession, d: str) -> DataFrame:
    return folds.thin(events(spark, d).select("user_id", "event_id", "t"), ["user_id"], ["t", "event_id"], "t", float(DAY))


@query()
def dedupe_box(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", (F.col("t") / HOUR).alias("s"), (F.col("cents") / 100).alias("v"), (F.col("event_id") % 7).alias("p"))
    return folds.dedupe_box(rows, ["user_id"], "s", "v", "event_id", "p", 3.0)


@query()
def tracker(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", F.floor(F.col("t") / DAY).alias("frame"), "cents")
    return folds.track(rows, ["user_id"], "frame", "event_id", "cents", 800.0)


@query()
def smoothing_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", (F.col("t") / DAY).alias("x"), "value")
    return fits.robust_curves(rows, ["user_id"], "x", "value").withColumn("fit", F.round("fit", 6))
