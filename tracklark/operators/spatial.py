"""Planar geometry over polylines and polygons: projection to (s, d), resampling, areas, inclusion, crossings, ribbons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions.scalars import point_segment, segments_cross
from tracklark.operators.intervals import touching


def path_segments(path: DataFrame, keys: list[str], order: str, e: str, n: str) -> DataFrame:
    """keys, segment, ae, an, be, bn, s0, s1 of consecutive points of a path."""
    w = W.partitionBy(*keys).orderBy(order)
    seg = path.select(*keys, F.col(order).alias("segment"), F.col(e).alias("ae"), F.col(n).alias("an"), F.lead(e).over(w).alias("be"), F.lead(n).over(w).alias("bn")).filter("be is not null")
    length = F.hypot(F.col("be") - F.col("ae"), F.col("bn") - F.col("an"))
    s1 = F.sum(length).over(W.partitionBy(*keys).orderBy("segment").rowsBetween(W.unboundedPreceding, 0))
    return seg.withColumn("s1", s1).withColumn("s0", F.col("s1") - length)


def project(points: DataFrame, segments: DataFrame, keys: list[str], id_: str, e: str, n: str, reach: float) -> DataFrame:
    """id, segment, s, d, distance: the nearest segment of the same key within reach (ties: first segment).

    Segments are entered in all grid cells of size reach that their box grown by reach touches, so a point meets only segments near it.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor((lo - reach) / reach), F.floor((hi + reach) / reach)))
    near = segments.withColumn("_x", cells(F.least("ae", "be"), F.greatest("ae", "be"))).withColumn("_y", cells(F.least("an", "bn"), F.greatest("an", "bn")))
    p = points.select(*keys, id_, F.col(e).alias("_e"), F.col(n).alias("_n"), F.floor(F.col(e) / reach).alias("_x"), F.floor(F.col(n) / reach).alias("_y"))
    share, distance, offset = point_segment(F.col("_e"), F.col("_n"), F.col("ae"), F.col("an"), F.col("be"), F.col("bn"))
    both = p.join(near, [*keys, "_x", "_y"]).withColumns({"distance": distance, "s": F.col("s0") + share * (F.col("s1") - F.col("s0")), "d": offset}).filter(F.col("distance") <= reach)
    best = both.groupBy(*keys, id_).agg(F.min(F.struct("distance", "segment", "s", "d")).alias("b"))
    return best.select(*keys, id_, "b.segment", "b.s", "b.d", "b.distance")


def at_route(rows: DataFrame, segments: DataFrame, keys: list[str], s: str, d: str) -> DataFrame:
    """rows with east and north of (s, d); off the path's ends the last vertex, without offset. A place meets only segments around it."""
    ends = segments.groupBy(*keys).agg(F.max(F.struct("s1", "be", "bn")).alias("_last"))
    seg = segments.select(*keys, "ae", "an", "be", "bn", "s0", "s1")
    places = rows.select(*keys, F.col(s).alias("_s")).distinct()
    hit = touching(places, seg, keys, "_s", "_s", "s0", "s1").filter("_s < s1").select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "_s", *seg.columns[len(keys):])
    same = [F.col(k) == F.col(f"_{i}") for i, k in enumerate(keys)]
    joined = rows.join(ends, keys).join(hit, [*same, F.col(s) == F.col("_s")], "left")
    f = (F.col(s) - F.col("s0")) / (F.col("s1") - F.col("s0"))
    length = F.hypot(F.col("be") - F.col("ae"), F.col("bn") - F.col("an"))
    east = F.col("ae") + f * (F.col("be") - F.col("ae")) - F.col(d) * (F.col("bn") - F.col("an")) / length
    north = F.col("an") + f * (F.col("bn") - F.col("an")) + F.col(d) * (F.col("be") - F.col("ae")) / length
    past = F.col("ae").isNull()
    return joined.select(*(rows[c] for c in rows.columns), F.when(past, F.col("_last.be")).otherwise(east).alias("east"), F.when(past, F.col("_last.bn")).otherwise(north).alias("north"))


def area(rings: DataFrame, keys: list[str], order: str, e: str, n: str) -> DataFrame:
    """keys, area: the absolute shoelace area of closed rings."""
    w = W.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    cross = rings.select(*keys, (F.col(e) * nxt(n) - nxt(e) * F.col(n)).alias("c"))
    return cross.groupBy(*keys).agg((F.abs(F.sum("c")) / 2).alias("area"))


def inside(points: DataFrame, id_: str, edges: DataFrame, polygon: str, cell: float = 50.0) -> DataFrame:
    """Pairs (point, polygon) with the point (e, n) inside: an odd number of edges to its right. edges: polygon, ae, an, be, bn. A polygon's
    box is entered in the bands of n that it spans and cells of e, so points meet only boxes around them, by an equi-join."""
    boxes = edges.groupBy(polygon).agg(F.min("ae").alias("_w"), F.max("ae").alias("_e"), F.min("an").alias("_s"), F.max("an").alias("_n"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    boxes = boxes.withColumn("_x", cells("_w", "_e")).withColumn("_y", cells("_s", "_n"))
    p = points.select(id_, "e", "n", F.floor(F.col("e") / cell).alias("_x"), F.floor(F.col("n") / cell).alias("_y"))
    near = p.join(boxes, ["_x", "_y"]).filter(F.col("e").between(F.col("_w"), F.col("_e")) & F.col("n").between(F.col("_s"), F.col("_n"))).select(id_, "e", "n", polygon)
    crossing = ((F.col("an") > F.col("n")) != (F.col("bn") > F.col("n"))) & (F.col("e") < (F.col("be") - F.col("ae")) * (F.col("n") - F.col("an")) / (F.col("bn") - F.col("an")) + F.col("ae"))
    return near.join(edges, polygon).groupBy(id_, polygon).agg(F.count_if(crossing).alias("_crossed")).filter("_crossed % 2 = 1").drop("_crossed")


def self_crossings(segments: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """keys, n_crossings of non-adjacent segments of a path; only segments that share a grid cell are compared."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    c = segments.withColumn("_x", span("ae", "be")).withColumn("_y", span("an", "bn"))
    b = c.select(*keys, "_x", "_y", *(F.col(x).alias(f"_{x}") for x in ("segment", "ae", "an", "be", "bn")))
    hit: Column = segments_cross(*((F.col(f"{u}{p}e"), F.col(f"{u}{p}n")) for u in ("", "_") for p in ("a", "b")))
    pairs = c.join(b, [*keys, "_x", "_y"]).filter((F.col("segment") + 1 < F.col("_segment")) & hit).select(*keys, "segment", "_segment").distinct()
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_crossings"))


def resample(rows: DataFrame, keys: list[str], s: str, d: str, step: float) -> DataFrame:
    """keys, s, d at multiples of step between consecutive samples, linear between them; samples are (key, s) unique."""
    w = W.partitionBy(*keys).orderBy(s)
    pairs = rows.select(*keys, F.col(s).alias("_s"), F.col(d).alias("_d"), F.lead(s).over(w).alias("_s2"), F.lead(d).over(w).alias("_d2")).filter("_s2 > _s")
    grid = pairs.withColumn("i", F.explode(F.sequence(F.ceil(F.col("_s") / step), F.ceil(F.col("_s2") / step)))).withColumn("s", F.col("i") * step).filter("s >= _s and s < _s2")
    return grid.select(*keys, "s", (F.col("_d") + (F.col("_d2") - F.col("_d")) * (F.col("s") - F.col("_s")) / (F.col("_s2") - F.col("_s"))).alias("d"))


def checksum(rows: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """keys, checksum of millimetre-rounded values in order: equal for equal geometry, whatever the partitioning."""
    text = F.concat_ws(":", *(F.floor(F.col(v) * 1000 + 0.5).cast("string") for v in values))
    return rows.groupBy(*keys).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), text.alias("x"))))), 256).alias("checksum"))
