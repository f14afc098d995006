"""Joins in time: as-of with interpolation, nearest, interval lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.operators.intervals import touching


def asof_interpolate(points: DataFrame, fixes: DataFrame, key: str, time: str, value: str, most: int) -> DataFrame:
    """points (key, time, ...) with the value of fixes (key, time, value) interpolated at their time.

    Between two fixes any distance is bridged; before the first and after the last the nearest fix holds up to most. Both sides are
    shuffled once by key and merged by a window, so a key's rows meet in order and nothing is compared pairwise.
    """
    extra = [c for c in points.columns if c not in (key, time)]
    a = points.select(key, time, F.lit(1).alias("_side"), F.struct(*extra).alias("_row"), F.lit(None).cast("long").alias("_t"), F.lit(None).cast("double").alias("_v"))
    b = fixes.select(key, time, F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.col(time).alias("_t"), F.col(value).cast("double").alias("_v"))
    both = a.unionByName(b.withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType)))
    fix = F.when(F.col("_side") == 0, F.struct("_t", "_v"))
    back = W.partitionBy(key).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(time, F.desc("_side")).rowsBetween(0, W.unboundedFollowing)
    both = both.withColumns({"p": F.last(fix, True).over(back), "n": F.first(fix, True).over(ahead)}).filter("_side = 1")
    t, pt, nt = F.col(time), F.col("p._t"), F.col("n._t")
    share = (t - pt) / (nt - pt)
    inside = F.when(nt == pt, F.col("p._v")).otherwise(F.col("p._v") + (F.col("n._v") - F.col("p._v")) * share)
    found = F.when(pt.isNotNull() & nt.isNotNull(), inside).when(pt.isNotNull() & (t - pt <= most), F.col("p._v")).when(nt.isNotNull() & (nt - t <= most), F.col("n._v"))
    return both.select(key, time, "_row.*", found.alias(value))


def nearest(points: DataFrame, targets: DataFrame, key: str, time: str, target: str) -> DataFrame:
    """points with the id of the nearest target in time; of equally near ones the earlier, then the smaller id."""
    extra = [c for c in points.columns if c not in (key, time)]
    a = points.select(key, time, F.lit(1).alias("_side"), F.struct(*extra).alias("_row"), F.lit(None).cast("long").alias("_id"))
    b = targets.select(key, time, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(target).alias("_id"))
    both = a.unionByName(b)
    # The latest target before has its smallest id taken by the order within equal times.
    back = W.partitionBy(key).orderBy(F.col(time), F.col("_side"), F.desc("_id")).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(F.col(time), F.desc("_side"), F.col("_id")).rowsBetween(0, W.unboundedFollowing)
    hit = F.when(F.col("_side") == 0, F.struct(F.col(time).alias("t"), F.col("_id").alias("id")))
    both = both.withColumns({"p": F.last(hit, True).over(back), "n": F.first(hit, True).over(ahead)}).filter("_side = 1")
    before, after = F.col(time) - F.col("p.t"), F.col("n.t") - F.col(time)
    pick = F.when(F.col("n").isNull() | (before <= after), F.col("p.id")).otherwise(F.col("n.id"))
    gap = F.when(F.col("n").isNull() | (before <= after), before).otherwise(after)
    return both.select(key, time, "_row.*", pick.alias(target), gap.alias("gap"))


def in_spans(rows: DataFrame, spans: DataFrame, key: str, time: str, start: str, end: str, span: str) -> DataFrame:
    """rows with the first span of their key that holds their time (by start, then span id), else null. Each time of a key is looked up
    once, among the spans around it (intervals.touching)."""
    s = spans.select(F.col(key).alias("_k"), F.col(start).alias("_a"), F.col(end).alias("_b"), F.col(span).alias("_span"))
    times = rows.select(F.col(key).alias("_k"), F.col(time).alias("_t")).distinct()
    first = touching(times, s, ["_k"], "_t", "_t", "_a", "_b").groupBy("_k", "_t").agg(F.min(F.struct("_a", "_span")).alias("_s"))
    joined = rows.join(first, (F.col(key) == F.col("_k")) & (F.col(time) == F.col("_t")), "left")
    return joined.select(*rows.columns, F.col("_s._span").alias(span))
