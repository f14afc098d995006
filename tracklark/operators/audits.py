"""Audits of decisions, tracks and tables: distributions by class, strata, manifests, reconciliation, integrity, causes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions.scalars import all_reasons, first_reason
from tracklark.operators.sequence import ranked


def residual_stats(rows: DataFrame, keys: list[str], value: str, cap: float, places: int = 4) -> DataFrame:
    """keys, n, n_missing, min, p05, p25, median, p75, p95, max, n_within (at most cap), n_beyond of the finite values."""
    v = F.col(value).cast("double")
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    x = F.when(fine, v)
    parts = [F.round(F.percentile(x, p), places).alias(n) for p, n in ((0.05, "p05"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"))]
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.count_if(~fine | v.isNull()).alias("n_missing"), F.round(F.min(x), places).alias("min"), *parts, F.round(F.max(x), places).alias("max"), F.count_if(x <= cap).alias("n_within"), F.count_if(x > cap).alias("n_beyond"))


def changes(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """rows with change: samePositive, sameNegative, lost, gained."""
    return rows.withColumn("change", F.when(before & after, "samePositive").when(before, "lost").when(after, "gained").otherwise("sameNegative"))


def strata_metrics(rows: DataFrame, strata: dict[str, Column], agree: Column, measures: dict[str, Column]) -> DataFrame:
    """stratum, n, n_agree, rate and the counts of the measures for each stratum; strata are conditions and may overlap. One pass: a
    row is copied to each of its strata."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in strata.items())))
    each = rows.withColumn("stratum", F.explode(names))
    out = each.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(agree).alias("n_agree"), *(F.count_if(c).alias(k) for k, c in measures.items()))
    return out.withColumn("rate", F.round(F.col("n_agree") / F.col("n"), 4))


def stride_pick(rows: DataFrame, condition: Column, order: list[str], limit: int) -> DataFrame:
    """At most limit of the rows that meet the condition, at a stride of floor(n / limit), by order. The rows are counted first, so that
    they are ranked in shares and no task gets them all."""
    met = rows.filter(condition)
    n = met.count()
    stride = max(1, n // limit)
    return ranked(met, order).filter((F.col("_rank") % stride == 0) & (F.col("_rank") < stride * limit)).drop("_rank")


def manifest(rows: DataFrame, id_: str, before: Column, after: Column, unsure: Column, groups: dict[str, Column], each: int = 8, sample: int = 40) -> DataFrame:
    """id, priority, review_group: what is to be reviewed. 1: all that was lost; 2: all unsure ones; 3: of those gained, `each` of every group and
    `sample` of all, at equal strides. A row keeps its best priority. Groups have limits of their own."""
    marked = changes(rows, before, after)
    picks = [marked.filter("change = 'lost'").select(id_, F.lit(1).alias("priority"), F.lit("lost").alias("review_group")), marked.filter(unsure).select(id_, F.lit(2), F.lit("unsure"))]
    gained = marked.filter("change = 'gained'")
    for name, condition in groups.items():
        picks.append(stride_pick(gained, condition, [id_], each).select(id_, F.lit(3), F.lit(f"gained:{name}")))
    picks.append(stride_pick(gained, F.lit(True), [id_], sample).select(id_, F.lit(3), F.lit("gained")))
    all_ = reduce(DataFrame.union, picks)
    best = all_.groupBy(id_).agg(F.min(F.struct("priority", "review_group")).alias("b"))
    return best.select(id_, "b.priority", "b.review_group")


def repeated(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    """keys, n of the combinations that occur more than once, the most frequent `top` (a report)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), *keys).limit(top)


def coverage_by(rows: DataFrame, dimensions: list[str], hit: Column) -> DataFrame:
    """dimension, key, n, n_hit, rate for each single dimension: one aggregation over grouping sets."""
    text = rows.select(*(F.col(d).cast("string").alias(d) for d in dimensions), hit.alias("_hit"))
    out = text.groupingSets([[d] for d in dimensions], *dimensions).agg(F.grouping_id().cast("long").alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("n_hit"))
    full = (1 << len(dimensions)) - 1
    which = F
    for i, d in enumerate(dimensions):
        which = which.when(F.col("_g") == (full ^ (1 << (len(dimensions) - 1 - i))), d)
    return out.select(which.alias("dimension"), F.coalesce(*dimensions).alias("key"), "n", "n_hit", F.round(F.col("n_hit") / F.col("n"), 4).alias("rate"))


def membership(outcomes: DataFrame, members: DataFrame, item: str, group: str) -> DataFrame:
    """item, issue: items in several groups, members without an outcome, associated items that no group holds."""
    several = members.groupBy(item).agg(F.count_distinct(group).alias("_n")).filter("_n > 1").select(item, F.lit("inSeveralGroups").alias("issue"))
    unknown = members.select(item).distinct().join(outcomes, item, "left_anti").select(item, F.lit("withoutOutcome").alias("issue"))
    lost = outcomes.filter("associated").join(members, item, "left_anti").select(item, F.lit("inNoGroup").alias("issue"))
    return several.union(unknown).union(lost)


def integrity(rows: DataFrame, name: str, unique: list[str], references: dict[str, tuple[DataFrame, str]], rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule: unique keys (rows too many), references (column -> table, column) and row conditions. Rules
    that hold have no row."""
    broken = [rows.groupBy(*unique).agg((F.count(F.lit(1)) - 1).alias("_n")).filter("_n > 0").agg(F.sum("_n").alias("n")).select(F.lit(f"{name}.unique").alias("rule"), "n")]
    for column, (table, target) in references.items():
        missing = rows.filter(F.col(column).isNotNull()).join(table.select(F.col(target).alias("_t")).distinct(), F.col(column) == F.col("_t"), "left_anti")
        broken.append(missing.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name}.{column}").alias("rule"), "n"))
    counts = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    broken += [counts.select(F.lit(f"{name}.{k}").alias("rule"), F.col(k).alias("n")) for k in rules]
    return reduce(DataFrame.union, broken).filter("n > 0")


def qualified(files: DataFrame, order: list[str], span: str = "duration", count: str = "n", size: str = "size", first: str = "first_t", last: str = "last_t", keys: list[str] = ()) -> DataFrame:
    """files with flags (array), allow_fusion, allow_passes, allow_tracks: too short, too few rows, cut off, or far from the file before or
    after (seconds, over 30)."""
    w = W.partitionBy(*keys).orderBy(*order)
    back, ahead = F.abs(F.col(first) - F.lag(last).over(w)), F.abs(F.lead(first).over(w) - F.col(last))
    rows = files.withColumns({"_back": back, "_ahead": ahead})
    s, n = F.coalesce(F.col(span), F.lit(0.0)), F.coalesce(F.col(count), F.lit(0))
    flags = all_reasons(
        ("incompleteLog", (s < 58 * 0.25) | ((F.col(size) < 500_000) & (n < 10))),
        ("insufficientTemporalObservations", n < 3),
        ("insufficientLaneSupport", n < 25 * 0.15),
        ("adjacentSegmentGap", (F.col("_back") > 30) | (F.col("_ahead") > 30)),
    )
    rows = rows.withColumn("flags", flags).drop("_back", "_ahead")
    fusion = ~F.arrays_overlap("flags", F.array(*map(F.lit, ("incompleteLog", "insufficientTemporalObservations", "insufficientLaneSupport"))))
    return rows.withColumns({"allow_fusion": fusion, "allow_passes": fusion & (n >= 3), "allow_tracks": fusion & (n >= 2)})


def side_flips(a: DataFrame, b: DataFrame, keys: list[str], lane: str, lateral: str, target_a: str, target_b: str) -> DataFrame:
    """keys, n_crossed, swapped: between two frames of a pair (tables keys, lane, lateral, and the target's lane), how many other lanes the
    target has crossed, and if it changed sides of the first other lane of frame a (by lateral, highest first)."""
    own_a = a.filter(F.col(lane) == F.col(target_a)).select(*keys, F.col(lateral).alias("_ta"))
    own_b = b.filter(F.col(lane) == F.col(target_b)).select(*keys, F.col(lateral).alias("_tb"))
    others = a.filter(F.col(lane) != F.col(target_a)).select(*keys, lane, F.col(lateral).alias("_la"))
    both = others.join(b.select(*keys, lane, F.col(lateral).alias("_lb")), [*keys, lane], "left").join(own_a, keys).join(own_b, keys)
    flip = (F.col("_ta") - F.col("_la")) * (F.col("_tb") - F.col("_lb")) < 0
    return both.groupBy(*keys).agg(F.count_if(flip).alias("n_crossed"), F.max_by(F.coalesce(flip, F.lit(False)), F.struct("_la", (-F.col(lane)).alias("l"))).alias("swapped"))


def vector_residual(rows: DataFrame) -> DataFrame:
    """rows (ax, ay, bx, by: anchors; pax, pay, pbx, pby: poses; heading in degrees counter-clockwise from east) with the displacement of
    the anchor less that of the pose: east, north, along and across the heading, and its length."""
    c = F.col
    e, n = c("bx") - c("ax") - (c("pbx") - c("pax")), c("by") - c("ay") - (c("pby") - c("pay"))
    h = F.radians("heading")
    return rows.withColumns({"residual_east": e, "residual_north": n, "residual_along": e * F.cos(h) + n * F.sin(h), "residual_across": -e * F.sin(h) + n * F.cos(h), "residual": F.hypot(e, n)})


def boundary_reason(conditions: str, segment_a: str, segment_b: str, gap: str, dt: str) -> Column:
    """The first boundary that forbids a pair: session, chunk, pose section, pass, gap, time."""
    has = lambda x: F.array_contains(conditions, x)
    return first_reason(
        ("sessionBoundary", F.col(segment_a) != F.col(segment_b)),
        ("chunkBoundary", has("chunkBoundary")),
        ("poseSectionBoundary", has("poseSectionBoundary")),
        ("passBoundary", has("passBoundary")),
        ("gap", has("gap") | F.coalesce(F.col(gap), F.lit(False))),
        ("timestampDiscontinuity", has("timestampDiscontinuity") | (F.col(dt) < 0)),
    )


def gap_class(gap: str, accepted_before: str, accepted_after: str, no_source: Column, dropout: float = 30.0, bridge: float = 12.0, short: float = 8.0) -> tuple[Column, Column]:
    """The cause of a gap between two bins, and if it may be bridged: noSource, fusionRemoved or polygonSplit."""
    g, both = F.col(gap), F.col(accepted_before) & F.col(accepted_after)
    cause = F.when(g >= dropout, "noSource").when(~both & no_source, "noSource").when(~both, "fusionRemoved").otherwise("polygonSplit")
    return cause, F.when(cause == "noSource", False).when(~both | (g > short), g <= bridge).otherwise(True)
