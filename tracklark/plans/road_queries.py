"""Queries for fusion, joining, projection, validation and audits; see queries.py for the stand-ins.

Observations are events: user = boundary, hours since 1970 less those of the first event = s, cents / 100 = d, day = frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions import canonical
from tracklark.operators import audits, fusion, graph, joining, joins, observations, playback
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


#: Observations with integer s (hours) and d (cents), so that medians and sums are exact.
OBS = f"{E_}, o AS (SELECT event_id, user_id, t // {HOUR} AS s, cents AS d, 1 + event_id % 5 AS w, t // {DAY} AS frame, event_type FROM e)"


def observed(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "user_id", F.floor(F.col("t") / HOUR).alias("s"), F.col("cents").alias("d"), (1 + F.col("event_id") % 5).alias("w"), F.floor(F.col("t") / DAY).alias("frame"), "event_type")


def fused_sql(relax: bool) -> str:
    need = "CASE WHEN n_inliers < n_rows AND tight <= 0.5 THEN 1 ELSE 2 END" if relax else "2"
    first = "WHEN n_rows < 2 THEN 'insufficientObservations' WHEN all_frames < 2 THEN 'insufficientFrameSupport'" if relax else "WHEN n_rows < 2 THEN 'insufficientObservations'"
    return f"""{OBS}, b AS (SELECT *, floor(s / 48.0 + 0.5)::BIGINT AS bin FROM o), m AS (SELECT user_id, bin, quantile_cont(d, 0.5) AS med FROM b GROUP BY ALL),
v AS (SELECT b.*, abs(d - med) AS dev FROM b JOIN m USING (user_id, bin)), k AS (SELECT user_id, bin, median(dev) AS spread FROM v GROUP BY ALL),
x AS (SELECT v.*, spread, dev <= 3 * greatest(spread, 30.0) AS inl FROM v JOIN k USING (user_id, bin)),
c AS (SELECT user_id, bin, any_value(spread) AS spread, count(*) AS n_rows, count(*) FILTER (inl) AS n_inliers, count(DISTINCT frame) AS all_frames, count(DISTINCT frame) FILTER (inl) AS n_frames FROM x GROUP BY ALL),
i AS (SELECT * FROM x WHERE inl), im AS (SELECT user_id, bin, quantile_cont(d, 0.5) AS med2 FROM i GROUP BY ALL), tt AS (SELECT user_id, bin, median(abs(d - med2)) AS tight FROM i JOIN im USING (user_id, bin) GROUP BY ALL),
gd AS (SELECT user_id, bin, d, sum(w) AS w FROM i GROUP BY ALL), rd AS (SELECT user_id, bin, d, sum(w) OVER (PARTITION BY user_id, bin ORDER BY d) AS run, sum(w) OVER (PARTITION BY user_id, bin) AS tot FROM gd), fd AS (SELECT user_id, bin, min(d) AS d FROM rd WHERE 2 * run >= tot GROUP BY ALL),
gs AS (SELECT user_id, bin, s, sum(w) AS w FROM i GROUP BY ALL), rs AS (SELECT user_id, bin, s, sum(w) OVER (PARTITION BY user_id, bin ORDER BY s) AS run, sum(w) OVER (PARTITION BY user_id, bin) AS tot FROM gs), fs AS (SELECT user_id, bin, min(s) AS s FROM rs WHERE 2 * run >= tot GROUP BY ALL),
z AS (SELECT c.*, fd.d, fs.s, CASE {first} WHEN n_inliers < 2 THEN 'lateralOutliers' WHEN n_frames < {need} THEN 'insufficientFrameSupport' END AS reason FROM c LEFT JOIN tt USING (user_id, bin) LEFT JOIN fd USING (user_id, bin) LEFT JOIN fs USING (user_id, bin)),
fused AS (SELECT user_id, bin, n_rows, n_inliers, n_frames, spread::DOUBLE AS spread, CASE WHEN reason IS NULL THEN s END AS s, CASE WHEN reason IS NULL THEN d END AS d, reason FROM z)"""


def fused(spark: SparkSession, d: str, relax: bool) -> DataFrame:
    return fusion.fused_bins(observed(spark, d), ["user_id"], "s", "d", "w", "frame", 48.0, relax, spread_floor=30.0)


@query(f"WITH {fused_sql(False)} SELECT * FROM fused")
def side_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, False)


@query(f"WITH {fused_sql(True)} SELECT * FROM fused")
def track_bin_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, True)


@query(f"""WITH RECURSIVE {fused_sql(True)}, p AS (SELECT user_id, bin, s, d, row_number() OVER (PARTITION BY user_id ORDER BY s, bin) AS i FROM fused WHERE reason IS NULL),
r AS (SELECT user_id, bin, s, d, i, 0 AS f, s AS ls, d AS ld, true AS keep FROM p WHERE i = 1
UNION ALL SELECT p.user_id, p.bin, p.s, p.d, p.i, CASE WHEN p.s - r.ls > 240 OR abs(p.d - r.ld) > 6000 THEN r.f + 1 ELSE r.f END,
 CASE WHEN p.s - r.ls > 240 OR abs(p.d - r.ld) > 6000 OR abs(p.d - r.ld) <= 2000 THEN p.s ELSE r.ls END, CASE WHEN p.s - r.ls > 240 OR abs(p.d - r.ld) > 6000 OR abs(p.d - r.ld) <= 2000 THEN p.d ELSE r.ld END,
 p.s - r.ls > 240 OR abs(p.d - r.ld) > 6000 OR abs(p.d - r.ld) <= 2000 FROM r JOIN p ON p.user_id = r.user_id AND p.i = r.i + 1),
ends AS (SELECT user_id, bin, s, d, f::BIGINT AS fragment, count(*) OVER (PARTITION BY user_id, f) AS n FROM r WHERE keep) SELECT user_id, bin, s, d, fragment FROM ends WHERE n >= 2""")
def fused_fragments(spark: SparkSession, d: str) -> DataFrame:
    bins = fused(spark, d, True).filter("reason is null").select("user_id", "bin", "s", "d")
    return fusion.fragments(bins, ["user_id"], most_step=240.0, most_jump=2000.0)


@query()
def clustered_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = observed(spark, d).withColumns({"s": F.col("s").cast("double") / 24, "d": F.col("d") / 200})
    return fusion.chosen_bins(fusion.cluster_bins(rows, ["user_id"], "s", "d", "w", "frame", "event_id"), ["user_id"])


@query(f"""WITH {OBS}, t AS (SELECT user_id, event_type, sum(d - 1500)::BIGINT AS sd, count(*) AS n, min(s) AS s0, max(s) AS s1 FROM o GROUP BY ALL), k AS (SELECT *, sd::DOUBLE / n AS m FROM t WHERE s1 - s0 >= 200),
g AS (SELECT *, CASE WHEN m - lag(m) OVER (PARTITION BY user_id, m >= 0 ORDER BY m, event_type) > 2 THEN 1 ELSE 0 END AS new FROM k),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id, m >= 0 ORDER BY m, event_type ROWS UNBOUNDED PRECEDING) AS cl FROM g)
SELECT user_id, event_type, round(m, 6) AS mean_d, s0, s1, s1 - s0 AS span, m < 0 AND row_number() OVER (PARTITION BY user_id, m >= 0 ORDER BY m, event_type) = 1 AS outer,
m >= 0 AND row_number() OVER (PARTITION BY user_id, m >= 0, cl ORDER BY m DESC, event_type) = 1 AS positive FROM c""")
def boundary_tracks(spark: SparkSession, d: str) -> DataFrame:
    rows = observed(spark, d).withColumn("d", F.col("d") - 1500)
    return fusion.boundary_stats(rows, ["user_id"], "event_type", "s", "d", 200).withColumn("mean_d", F.round("mean_d", 6))


@query(f"WITH {OBS} SELECT user_id, floor(s / 48.0 + 0.5)::BIGINT AS bin, count(*) AS n, round(sum(d * w)::DOUBLE / sum(w), 6) AS d, round(sum(s * w)::DOUBLE / sum(w), 6) AS s FROM o GROUP BY ALL")
def bin_centroids(spark: SparkSession, d: str) -> DataFrame:
    out = fusion.centroids(observed(spark, d), ["user_id"], "s", ["d", "s"], "w", 48.0)
    return out.select("user_id", "bin", "n", F.round("d", 6).alias("d"), F.round("s", 6).alias("s"))


@query(f"""WITH {OBS}, l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT DISTINCT user_id, event_type FROM o)),
p AS (SELECT user_id, event_type FROM l WHERE n >= 2 AND r IN (n // 2, n // 2 - 1)), q AS (SELECT o.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS i FROM o JOIN p USING (user_id, event_type))
SELECT user_id, i, sum(s) / 2.0 AS s, sum(d) / 2.0 AS d FROM q GROUP BY user_id, i HAVING count(*) = 2""")
def middle_line(spark: SparkSession, d: str) -> DataFrame:
    return fusion.centre_line(observed(spark, d), ["user_id"], "event_type", "event_id", "s", "d")


@query(f"""WITH {OBS}, c AS (SELECT user_id, event_type, count(*) AS n FROM o GROUP BY ALL), b AS (SELECT user_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1)
SELECT event_id, user_id, event_type FROM o JOIN b USING (user_id, event_type)""")
def dominant_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = observed(spark, d).select("event_id", "user_id", "event_type")
    codes = rows.select("event_type").distinct().withColumn("code", F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4))
    return fusion.dominant_only(rows.join(F.broadcast(codes), "event_type"), ["user_id"], "code").select("event_id", "user_id", "event_type")


@query(f"""WITH {E_}, g AS (SELECT event_id, user_id, t, coalesce(t - lag(t) OVER w > {DAY}, true)::INT AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS s FROM g), c AS (SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id, s) AS component, count(*) OVER (PARTITION BY user_id, s) AS n FROM s) SELECT id, component FROM c WHERE n > 1""")
def linked_components(spark: SparkSession, d: str) -> DataFrame:
    """Events linked with the user's next within a day: chains of any length."""
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, d).select(F.col("event_id").alias("a"), F.lead("event_id").over(w).alias("b"), (F.lead("t").over(w) - F.col("t")).alias("gap"))
    return graph.components(rows.filter(F.col("gap") <= DAY), "a", "b")


@query("""WITH p AS (SELECT s_nationkey AS k, s_suppkey AS a, c_custkey AS b, 1 - abs(s_acctbal - c_acctbal) / 2000 AS score FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE abs(s_acctbal - c_acctbal) < 1000),
r AS (SELECT *, row_number() OVER x AS ra, row_number() OVER (PARTITION BY k, b ORDER BY score DESC, a) AS rb, lead(score) OVER x AS second_score FROM p WINDOW x AS (PARTITION BY k, a ORDER BY score DESC, b))
SELECT k, a, b, round(score, 6) AS score, round(second_score, 6) AS second_score, round(coalesce(score - second_score, 1), 6)::DOUBLE AS margin FROM r WHERE ra = 1 AND rb = 1 AND score >= 0.55 AND round(coalesce(score - second_score, 1), 9) >= 0.01""")
def selected_joins(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("v"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("b"), F.col("c_acctbal").alias("v"))
    off = F.abs(F.col("a_value") - F.col("b_value"))
    pairs = joins.nearest_pairs(s, c, ["k"], "a", "b", "v").filter(off < 1000).select("k", "a", "b", (1 - off / 2000).alias("score"))
    return joining.selected(pairs, ["k"], "a", "b", margin=0.01).withColumns({c: F.round(c, 6) for c in ("score", "second_score", "margin")})


@query("""WITH x AS (SELECT vec_id, [embedding[1]::DOUBLE * 20, embedding[2]::DOUBLE * 20, embedding[3]::DOUBLE * 20, embedding[4]::DOUBLE * 20] AS x, [embedding[5]::DOUBLE, embedding[6]::DOUBLE, embedding[7]::DOUBLE, embedding[8]::DOUBLE] AS y FROM embeddings WHERE len(embedding) >= 8),
p AS (SELECT vec_id, unnest([1, 2, 3, 4]) AS i, unnest(x) AS px, unnest(y) AS py FROM x), q AS (SELECT *, lead(px) OVER w AS qx, lead(py) OVER w AS qy FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
h AS (SELECT vec_id, arg_min(CASE WHEN qx IS NOT NULL AND least(px, qx) <= 2 AND greatest(px, qx) >= 2 AND px <> qx THEN py + (2 - px) / (qx - px) * (qy - py) END, i) FILTER (qx IS NOT NULL AND least(px, qx) <= 2 AND greatest(px, qx) >= 2 AND px <> qx) AS y,
 arg_min(py, abs(px - 2)) AS n, bool_or(px BETWEEN -3 AND 3 AND py > 0.05) AND bool_or(px BETWEEN -3 AND 3 AND py < -0.05) AS crossing FROM q GROUP BY vec_id)
SELECT vec_id, round(coalesce(y, n), 6) AS y, CASE WHEN y IS NULL THEN 'nearest' ELSE 'interpolated' END AS how, crossing FROM h""")
def line_anchors(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i, k: F.get("embedding", F.lit(i)).cast("double") * k
    rows = table(spark, d, "embeddings").filter(F.size("embedding") >= 8).select("vec_id", F.array(*(at(i, 20) for i in range(4))).alias("x"), F.array(*(at(i, 1) for i in range(4, 8))).alias("y"))
    a = observations.anchor("x", "y", 2.0)
    return rows.select("vec_id", F.round(a["y"], 6).alias("y"), a["how"].alias("how"), observations.crosses_centre("x", "y", (-3.0, 3.0)).alias("crossing"))


@query(f"""WITH RECURSIVE {E_}, p AS (SELECT *, CASE WHEN event_type = 'error' THEN 'noFix' WHEN cents > 6000 THEN 'accuracyTooHigh' END AS own FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM p WHERE own IS NULL),
r AS (SELECT user_id, event_id, i, cents AS last, NULL::VARCHAR AS reason FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, CASE WHEN abs(o.cents - r.last) > 2000 THEN r.last ELSE o.cents END, CASE WHEN abs(o.cents - r.last) > 2000 THEN 'positionJump' END
FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT user_id, event_id, reason FROM r UNION ALL SELECT user_id, event_id, own FROM p WHERE own IS NOT NULL""")
def validated_positions(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("event_type") == "error", "noFix").when(F.col("cents") > 6000, "accuracyTooHigh")
    rows = events(spark, d).select("user_id", "event_id", "t", "cents", F.lit(0).alias("zero"), reason.alias("reason"))
    return observations.with_jumps(rows, ["user_id"], ["t", "event_id"], "cents", "zero", most=2000).select("user_id", "event_id", "reason")


@query("""SELECT o_orderpriority, count(*) FILTER (v IS NOT NULL) AS n, count(*) FILTER (v IS NULL) AS n_missing, round(min(v), 4) AS min, round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median,
round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.95), 4) AS p95, round(max(v), 4) AS max, count(*) FILTER (v <= 150000) AS n_within, count(*) FILTER (v > 150000) AS n_beyond
FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS v FROM orders) GROUP BY ALL""")
def residual_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")))
    return audits.residual_stats(rows, ["o_orderpriority"], "v", 150000.0)


DOCS = "d AS (SELECT doc_id, lang, source, n_chars, n_chars >= 300 AS a, n_chars >= 1000 OR lang = 'de' AS b FROM documents)"


@query(f"""WITH {DOCS}, s AS (SELECT *, unnest(list_filter(['long', 'english', 'any'], lambda x: (x = 'long' AND n_chars >= 2000) OR (x = 'english' AND lang = 'en') OR x = 'any')) AS stratum FROM d)
SELECT stratum, count(*) AS n, count(*) FILTER (a = b) AS n_agree, count(*) FILTER (a) AS n_a, round(count(*) FILTER (a = b)::DOUBLE / count(*), 4) AS rate FROM s GROUP BY stratum""")
def overlapping_strata(spark: SparkSession, d: str) -> DataFrame:
    rows = decided(spark, d)
    return audits.strata_metrics(rows, {"long": F.expr("n_chars >= 2000"), "english": F.expr("coalesce(lang = 'en', false)"), "any": F.lit(True)}, F.expr("a = b"), {"n_a": F.col("a")})


def decided(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.expr("n_chars >= 300").alias("a"), F.expr("n_chars >= 1000 OR lang = 'de'").alias("b"))


@query(f"""WITH {DOCS}, m AS (SELECT *, CASE WHEN a AND NOT b THEN 'lost' WHEN b AND NOT a THEN 'gained' END AS change FROM d), g AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM m WHERE change = 'gained'),
h AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM m WHERE change = 'gained' AND n_chars < 150),
p AS (SELECT doc_id, 1 AS priority, 'lost' AS review_group FROM m WHERE change = 'lost' UNION ALL SELECT doc_id, 2, 'unsure' FROM m WHERE n_chars BETWEEN 290 AND 310
 UNION ALL SELECT doc_id, 3, 'gained:short' FROM h WHERE i % greatest(1, n // 8) = 0 AND i < greatest(1, n // 8) * 8 UNION ALL SELECT doc_id, 3, 'gained' FROM g WHERE i % greatest(1, n // 40) = 0 AND i < greatest(1, n // 40) * 40)
SELECT doc_id, min(priority)::INT AS priority, arg_min(review_group, (priority, review_group)) AS review_group FROM p GROUP BY doc_id""")
def review_manifest(spark: SparkSession, d: str) -> DataFrame:
    return audits.manifest(decided(spark, d), "doc_id", F.col("a"), F.col("b"), F.expr("n_chars BETWEEN 290 AND 310"), {"short": F.expr("n_chars < 150")})


@query("""WITH l AS (SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber, l_quantity > 25 AS hit FROM lineitem), u AS (SELECT 'l_returnflag' AS dimension, l_returnflag AS key, hit FROM l UNION ALL SELECT 'l_linestatus', l_linestatus, hit FROM l UNION ALL SELECT 'l_linenumber', l_linenumber, hit FROM l)
SELECT dimension, key, count(*) AS n, count(*) FILTER (hit) AS n_hit, round(count(*) FILTER (hit)::DOUBLE / count(*), 4) AS rate FROM u GROUP BY ALL""")
def coverage_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    return audits.coverage_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], F.col("l_quantity") > 25)


@query("""WITH m AS (SELECT l_partkey AS item, l_suppkey AS grp FROM lineitem), o AS (SELECT p_partkey AS item, p_size > 25 AS associated FROM part WHERE p_partkey % 5 > 0)
SELECT item, 'inSeveralGroups' AS issue FROM m GROUP BY item HAVING count(DISTINCT grp) > 1 UNION ALL SELECT DISTINCT item, 'withoutOutcome' FROM m WHERE item NOT IN (SELECT item FROM o)
UNION ALL SELECT item, 'inNoGroup' FROM o WHERE associated AND item NOT IN (SELECT item FROM m)""")
def track_membership(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("grp"))
    o = table(spark, d, "part").filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("item"), (F.col("p_size") > 25).alias("associated"))
    return audits.membership(o, m, "item", "grp")


@query("""WITH b AS (SELECT 'orders.unique' AS rule, sum(n - 1)::BIGINT AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 > 0)
UNION ALL SELECT 'orders.positive', count(*) FROM orders WHERE NOT o_totalprice > 0 UNION ALL SELECT 'orders.notHuge', count(*) FROM orders WHERE NOT o_totalprice < 300000) SELECT * FROM b WHERE n > 0""")
def integrity_rules(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").filter("c_custkey % 10 > 0")
    return audits.integrity(o, "orders", ["o_custkey", "o_orderstatus"], {"o_custkey": (c, "c_custkey")}, {"positive": F.col("o_totalprice") > 0, "notHuge": F.col("o_totalprice") < 300000})


@query(f"""WITH {E_}, f AS (SELECT user_id, t // {5 * DAY} AS file, count(*) AS n, min(t) / 1e6 AS first_t, max(t) / 1e6 AS last_t FROM e GROUP BY ALL), g AS (SELECT *, (last_t - first_t) / 3600 AS duration, n * 100000 AS size, abs(first_t - lag(last_t) OVER w) AS b, abs(lead(first_t) OVER w - last_t) AS a FROM f WINDOW w AS (PARTITION BY user_id ORDER BY file)),
h AS (SELECT *, duration < 14.5 OR (size < 500000 AND n < 10) AS f1, n < 3 AS f2, n < 3.75 AS f3, coalesce(a > 30, false) OR coalesce(b > 30, false) AS f4 FROM g)
SELECT user_id, file, n, concat_ws(',', CASE WHEN f1 THEN 'incompleteLog' END, CASE WHEN f2 THEN 'insufficientTemporalObservations' END, CASE WHEN f3 THEN 'insufficientLaneSupport' END, CASE WHEN f4 THEN 'adjacentSegmentGap' END) AS flags, NOT (f1 OR f2 OR f3) AS allow_fusion FROM h""")
def qualified_files(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.col("t") / 1e6
    f = events(spark, d).groupBy("user_id", F.floor(F.col("t") / (5 * DAY)).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(seconds).alias("first_t"), F.max(seconds).alias("last_t"))
    f = f.withColumns({"duration": (F.col("last_t") - F.col("first_t")) / 3600, "size": F.col("n") * 100000})
    return audits.qualified(f, ["file"], keys=["user_id"]).select("user_id", "file", "n", F.array_join("flags", ",").alias("flags"), "allow_fusion")


@query("""SELECT p_partkey, CASE WHEN p_size < 2 THEN NULL ELSE round(sqrt(2) * 0, 6) END AS zero, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS digest FROM part""")
def row_digests(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_size", "p_partkey", "p_brand", "p_name")
    zero = F.round(canonical.normal_quantile(F.lit(0.5)), 6)
    return p.select("p_partkey", F.when(F.col("p_size") >= 2, zero).alias("zero"), canonical.row_digest(p.schema, ["p_name"]).alias("digest"))


@query(f"""WITH {E_}, q AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'), f AS (SELECT user_id, t, max(cents) AS cents FROM e WHERE event_type = 'view' GROUP BY ALL),
j AS (SELECT q.*, b.t AS bt, b.cents AS bc, a.t AS nt, a.cents AS ac FROM q ASOF LEFT JOIN f b ON q.user_id = b.user_id AND q.t >= b.t ASOF LEFT JOIN f a ON q.user_id = a.user_id AND q.t <= a.t)
SELECT event_id, user_id, round(CASE WHEN bt IS NULL THEN ac WHEN nt IS NULL THEN bc WHEN nt = bt THEN bc ELSE bc + (ac - bc) * ((t - bt)::DOUBLE / (nt - bt)) END, 4)::DOUBLE AS cents FROM j""")
def timed_positions(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    out = playback.positions_at(e.filter("event_type = 'purchase'").select("user_id", "t", "event_id"), e.filter("event_type = 'view'"), "user_id", "t", ["cents"])
    return out.select("event_id", "user_id", F.round("cents", 4).alias("cents"))


@query("""WITH w AS (SELECT DISTINCT source FROM documents WHERE length(source) % 2 = 0)
SELECT 'leak' AS kind, source, count(*) AS n_rows FROM documents WHERE source NOT IN (SELECT source FROM w) GROUP BY ALL UNION ALL SELECT 'visible', source, count(*) FROM documents WHERE source IN (SELECT source FROM w) GROUP BY ALL""")
def visible_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    shown = docs.filter("length(source) % 2 = 0")
    seen = playback.visible(docs, "source", shown).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    return playback.leaks(docs, "source", shown).select(F.lit("leak").alias("kind"), "source", "n_rows").union(seen.select(F.lit("visible"), "source", "n_rows"))


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank FROM documents")
def table_ranks(spark: SparkSession, d: str) -> DataFrame:
    return audits.ranked(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], "rank").select("doc_id", "rank")


@query(f"""WITH {OBS}, g AS (SELECT user_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS gap, event_type <> 'error' AS ok, lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY s, event_id) AS ok0 FROM o)
SELECT cause, safe, count(*) AS n FROM (SELECT CASE WHEN gap >= 120 THEN 'noSource' WHEN NOT (ok AND ok0) THEN 'fusionRemoved' ELSE 'polygonSplit' END AS cause, CASE WHEN gap >= 120 THEN false WHEN NOT (ok AND ok0) OR gap > 24 THEN gap <= 48 ELSE true END AS safe FROM g WHERE gap IS NOT NULL) GROUP BY ALL""")
def gap_causes(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("s", "event_id")
    rows = observed(spark, d).withColumn("ok", F.col("event_type") != "error")
    rows = rows.withColumns({"gap": F.col("s") - F.lag("s").over(w), "ok0": F.lag("ok").over(w)}).filter("gap is not null")
    cause, safe = audits.gap_class("gap", "ok0", "ok", F.lit(False), 120.0, 48.0, 24.0)
    return rows.select(cause.alias("cause"), safe.alias("safe")).groupBy("cause", "safe").agg(F.count(F.lit(1)).alias("n"))
