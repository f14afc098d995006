"""Where a path comes near itself: least distance far along the path, crossings with verdicts, verdicts on returns; and how far a polyline
lies from another. Points and segments meet through cells sized so that a cell holds few of them, never pairwise over a key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions.scalars import bearing_difference, bearing_of, first_reason, point_segment, segments_cross
from tracklark.operators.sequence import ordered, ranked, running_length
from tracklark.sources.scratch import saved

#: Levels of cells, each half of the one before, that one aggregation tries.
LEVELS = 8


def least_apart(rows: DataFrame, keys: list[str], order: list[str], e: str, n: str, apart: int = 3) -> DataFrame:
    """keys, distance: the least distance of two points that are at least `apart` places apart in the key's order; 0 for keys without such.

    Places come from ranks over ranges of the order. Cells are halved until none holds two such points: half of the last size that did
    bounds the distance, and at that size a cell holds at most `apart` points, so a point meets a bounded number of others in the cells
    around it, however long or dense the path. Points that coincide are told first."""
    placed = saved(ranked(rows.filter(F.col(e).isNotNull() & F.col(n).isNotNull()), [*keys, *order], "_i").select(*keys, F.col(e).cast("double").alias("_e"), F.col(n).cast("double").alias("_n"), "_i"))
    all_ = rows.select(*keys).distinct()
    box = placed.agg(F.min("_e"), F.min("_n"), F.max("_e"), F.max("_n")).first()
    far = F.max("_i") - F.min("_i") >= apart
    same = saved(placed.groupBy(*keys, "_e", "_n").agg(far.alias("_far")).filter("_far").select(*keys).distinct())
    zero = F.lit(0.0).alias("distance")
    out = same.select(*keys, zero)
    if box[0] is not None:
        size = 2.0 ** (math.ceil(math.log2(max(box[2] - box[0], box[3] - box[1], 1e-9))) + 1)
        left = placed.join(same, keys, "left_anti")
        first, found = 0, None
        while True:
            cells = left.withColumn("_level", F.explode(F.sequence(F.lit(first), F.lit(first + LEVELS - 1)))).withColumn("_c", size / F.pow(F.lit(2.0), F.col("_level")))
            at = [F.floor((F.col("_e") - box[0]) / F.col("_c")).alias("_x"), F.floor((F.col("_n") - box[1]) / F.col("_c")).alias("_y")]
            hit = cells.groupBy(*keys, "_level", *at).agg(far.alias("_far")).filter("_far").groupBy(*keys).agg(F.max("_level").alias("_level"))
            hit = saved(hit)
            # Keys whose last level in this turn hits go on; all others have theirs, from this turn or the end of the one before.
            known = hit if found is None else hit.union(found.join(hit.select(*keys), keys, "left_anti").filter(F.col("_level") == first - 1)).union(found.filter(F.col("_level") < first - 1))
            found = saved(known)
            first += LEVELS
            if not found.filter(F.col("_level") == first - 1).take(1):
                break
            left = placed.join(found.filter(F.col("_level") == first - 1).select(*keys), keys, "left_semi")
        cell = size / F.pow(F.lit(2.0), F.col("_level") + 1)
        own = placed.join(found, keys).withColumns({"_x": F.floor((F.col("_e") - box[0]) / cell), "_y": F.floor((F.col("_n") - box[1]) / cell)})
        # The distance is at most the diagonal of a cell of twice the size: 2.83 cells.
        around = lambda c: F.explode(F.sequence(F.col(c) - 3, F.col(c) + 3)).alias(c)
        asks = own.select(*keys, F.col("_e").alias("_ae"), F.col("_n").alias("_an"), F.col("_i").alias("_ai"), around("_x"), "_y")
        asks = asks.select(*keys, "_ae", "_an", "_ai", "_x", around("_y"))
        met = asks.join(own.select(*keys, "_e", "_n", "_i", "_x", "_y"), [*keys, "_x", "_y"]).filter(F.col("_i") - F.col("_ai") >= apart)
        out = out.union(met.groupBy(*keys).agg(F.min(F.hypot(F.col("_e") - F.col("_ae"), F.col("_n") - F.col("_an"))).alias("distance")))
    return all_.join(out, keys, "left").select(*keys, F.coalesce("distance", F.lit(0.0)).alias("distance"))


def along(rows: DataFrame, keys: list[str], order: list[str], e: str, n: str, heading: str) -> DataFrame:
    """rows with i (place from 0), s (length so far), tangent (bearing from the point before to the next; at the first to the next), and
    heading where it is null taken from the step to the point."""
    w = ordered(keys, order)
    de, dn = F.col(e) - F.lag(e).over(w), F.col(n) - F.lag(n).over(w)
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "_step": F.hypot(de, dn), "_own": bearing_of(de, dn)})
    a, b = F.coalesce(F.lag(e).over(w), F.col(e)), F.coalesce(F.lag(n).over(w), F.col(n))
    rows = rows.withColumn("tangent", F.coalesce(bearing_of(F.lead(e).over(w) - a, F.lead(n).over(w) - b), F.lit(0.0)))
    return running_length(rows, keys, order, F.col("_step")).withColumn(heading, F.coalesce(heading, "_own", F.lit(0.0))).drop("_step", "_own")


def crossings(rows: DataFrame, keys: list[str], order: list[str], e: str, n: str, heading: str, apart: int = 3) -> DataFrame:
    """keys, a, b (places where the older and the newer segment begin), with what tells a crossing from the chord of a curve: travelled,
    angle, turned, off_tangent, aligned, and the verdict genuineCrossing, curveChordArtifact or ambiguous.

    Segments are entered in cells of the power of two that is at least their extent, and of the larger sizes that the key has; two meet
    at the larger one's size, where each covers at most four cells."""
    path = along(rows.select(*keys, *order, e, n, heading), keys, order, e, n, heading)
    w = ordered(keys, order)
    ahead = {f"_{c}2": F.lead(c).over(w) for c in (e, n, heading)}
    seg = path.withColumns(ahead).filter(F.col(f"_{e}2").isNotNull()).select(*keys, "i", "s", "tangent", F.col(e).cast("double").alias("ae"), F.col(n).cast("double").alias("an"), F.col(f"_{e}2").cast("double").alias("be"), F.col(f"_{n}2").cast("double").alias("bn"), F.col(heading).alias("ha"), F.col(f"_{heading}2").alias("hb"))
    extent = F.greatest(F.abs(F.col("be") - F.col("ae")), F.abs(F.col("bn") - F.col("an")), F.lit(1e-6))
    seg = saved(seg.withColumn("_own", F.ceil(F.log2(extent)).cast("int")))
    sizes = seg.groupBy(*keys).agg(F.collect_set("_own").alias("_sizes"))  # at most one for each power of two
    cells = seg.join(sizes, keys).withColumn("_level", F.explode(F.filter("_sizes", lambda x: x >= F.col("_own")))).withColumn("_c", F.pow(F.lit(2.0), F.col("_level")))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / F.col("_c")), F.floor(F.greatest(a, b) / F.col("_c"))))
    cells = cells.withColumn("_x", span("ae", "be")).withColumn("_y", span("an", "bn")).drop("_sizes", "_c")
    b = cells.select(*keys, "_level", "_x", "_y", *(F.col(c).alias(f"q_{c}") for c in ("i", "s", "ae", "an", "be", "bn", "ha", "hb", "_own")))
    met = cells.join(b, [*keys, "_level", "_x", "_y"]).filter(F.greatest("_own", "q__own") == F.col("_level")).filter(F.col("q_i") >= F.col("i") + apart)
    point = lambda x, p="": (F.col(f"{p}{x}e"), F.col(f"{p}{x}n"))
    met = met.filter(segments_cross(point("a"), point("b"), point("a", "q_"), point("b", "q_"))).dropDuplicates([*keys, "i", "q_i"])
    way = lambda p: F.coalesce(bearing_of(F.col(f"{p}be") - F.col(f"{p}ae"), F.col(f"{p}bn") - F.col(f"{p}an")), F.lit(0.0))
    old, new = way(""), way("q_")
    between = bearing_difference(new, old)
    found = met.select(
        *keys,
        F.col("i").cast("long").alias("a"),
        F.col("q_i").cast("long").alias("b"),
        (F.col("q_s") - F.col("s")).alias("travelled"),
        F.when(between > 90, 180 - between).otherwise(between).alias("angle"),
        bearing_difference("q_ha", "q_hb").alias("turned"),
        bearing_difference(F.col("tangent"), new).alias("off_tangent"),
        ((bearing_difference(old, F.col("tangent")) < 30) & (bearing_difference(new, F.col("q_hb")) < 30)).alias("aligned"),
    )
    return found.withColumn("verdict", crossing_verdict(F.col("travelled"), F.col("angle"), F.col("turned"), F.col("off_tangent"), F.col("aligned")))


def crossing_verdict(travelled: Column, angle: Column, turned: Column, off_tangent: Column, aligned: Column, least_travel: float = 45.0, least_angle: float = 35.0, most_turn: float = 45.0, most_off: float = 60.0) -> Column:
    chord = (travelled >= least_travel) & (turned < most_turn) & (aligned | ((angle < least_angle) & (off_tangent < most_off)))
    return F.when(chord, "curveChordArtifact").when(angle >= least_angle, "genuineCrossing").otherwise("ambiguous")


def revisit_verdict(distance: Column, travelled: Column, seconds: Column, heading_off: Column, tangent_off: Column, approach_off: Column, turned: Column, ratio: float = 50.0, near: float = 8.0, travel: float = 25.0) -> tuple[Column, Column]:
    """(verdict, reason) of a return to an earlier point: genuineRevisit, curveArtifact or ambiguous, and the first kind of return that
    it is. heading_off: between both headings; tangent_off: from the path there to the line between the points; approach_off: from the
    heading there to the approach; turned: all turns in between."""
    stretched = F.when(distance > 0.01, travelled / distance).otherwise(F.lit(float("inf")))
    reason = first_reason(
        ("oppositeDirection", heading_off >= 120),
        ("sameRoad", (heading_off >= 60) & (tangent_off >= 90)),
        ("compactLoop", (stretched <= ratio) & (heading_off >= 45) & (seconds <= 600)),
        ("moderateRatio", (stretched <= ratio) & (heading_off >= 60)),
        ("loopClosure", (distance < near) & (travelled >= travel) & (turned >= 150) & ((tangent_off >= 55) | (heading_off <= 30)) & ((distance < 1) | (stretched <= 2 * ratio))),
        ("exactLoop", (distance < 1) & (travelled >= travel) & (turned >= 150) & (heading_off <= 30)),
    )
    long_ = stretched > ratio
    artifact = (long_ & (heading_off < 60) & (tangent_off < 70) & (approach_off < 90) & (turned < 150)) | (long_ & (tangent_off < 45) & (approach_off >= 90) & (heading_off < 120)) | ((stretched > 2 * ratio) & (tangent_off < 70) & (turned >= 150) & (heading_off > 45) & (heading_off < 120))
    return F.when(artifact, "curveArtifact").when(reason.isNotNull(), "genuineRevisit").otherwise("ambiguous"), F.when(~artifact, reason)


def near_pieces(points: DataFrame, lines: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Points with the lines that have a piece within a cell of theirs. The join merges: by the size of its files a table of lines looks
    small enough to broadcast, but its cells are not."""
    pieces = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("be") - F.col("ae"), F.col("bn") - F.col("an")) / reach)).cast("int")
    cut = lines.withColumn("_k", pieces).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    at = lambda a, b, j: F.col(a) + (F.col(b) - F.col(a)) * j / F.col("_k")
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(at(a, b, F.col("_j")), at(a, b, F.col("_j") + 1)) - reach) / reach), F.floor((F.greatest(at(a, b, F.col("_j")), at(a, b, F.col("_j") + 1)) + reach) / reach)))
    cut = cut.withColumn("_x", span("ae", "be")).withColumn("_y", span("an", "bn")).select(*keys, "_x", "_y", "ae", "an", "be", "bn").distinct()
    return points.withColumns({"_x": F.floor(F.col("e") / reach), "_y": F.floor(F.col("n") / reach)}).join(cut.hint("merge"), [*keys, "_x", "_y"])


def off_polyline(points: DataFrame, segments: DataFrame, keys: list[str], id_: str, reach: float) -> DataFrame:
    """keys, id, off: the distance of each point (e, n) from the nearest of the key's segments (ae, an, be, bn); points of keys without
    segments are left out.

    Rings that grow: segments, cut to pieces of at most reach, are entered in the cells within reach of them, and a point that finds
    one within reach has its distance; the others ask again with four times the reach. Most points of a sound fit need one round."""
    waiting = saved(points.join(segments.select(*keys).distinct().hint("merge"), keys, "left_semi").select(*keys, id_, F.col("e").cast("double").alias("e"), F.col("n").cast("double").alias("n")))
    lines, out = saved(segments.select(*keys, *(F.col(c).cast("double").alias(c) for c in ("ae", "an", "be", "bn")))), None
    while waiting.take(1):
        near = near_pieces(waiting, lines, keys, reach)
        _, off, _ = point_segment(*map(F.col, ("e", "n", "ae", "an", "be", "bn")))
        found = saved(near.groupBy(*keys, id_).agg(F.min(off).alias("off")).filter(F.col("off") <= reach))
        out = found if out is None else out.union(found)
        waiting = saved(waiting.join(found.select(*keys, id_).hint("merge"), [*keys, id_], "left_anti"))
        reach *= 4
    return out if out is not None else waiting.select(*keys, id_, F.lit(0.0).alias("off"))


def corridor(fitted: DataFrame, source: DataFrame, keys: list[str], id_: str, order: str, most: float) -> DataFrame:
    """keys, max_off, end_off, reason of each fitted polyline (rows id, order, e, n) against its own source: missingSourceGeometry,
    globalConsumedAsLocal (coordinates far outside of a small source), sourceCorridorExceeded, or null where it lies within most."""
    w = W.partitionBy(*keys).orderBy(order)
    seg = source.select(*keys, F.col("e").alias("ae"), F.col("n").alias("an"), F.coalesce(F.lead("e").over(w), F.col("e")).alias("be"), F.coalesce(F.lead("n").over(w), F.col("n")).alias("bn"), F.lag("e").over(w).isNotNull().alias("_later"), F.lead("e").over(w).isNull().alias("_last"))
    seg = seg.filter("not _last or not _later").drop("_later", "_last")  # a source of one point is a segment without length
    ends = lambda df, p: df.groupBy(*keys).agg(*(f(F.struct("e", "n"), order).alias(f"{p}{x}") for x, f in (("a", F.min_by), ("b", F.max_by))), F.max(F.greatest(F.abs("e"), F.abs("n"))).alias(f"{p}reach"))
    both = ends(fitted, "f_").join(ends(source, "s_"), keys, "left")
    off = off_polyline(fitted, seg, keys, id_, most).groupBy(*keys).agg(F.max("off").alias("max_off"))
    apart = lambda x: F.hypot(F.col(f"f_{x}.e") - F.col(f"s_{x}.e"), F.col(f"f_{x}.n") - F.col(f"s_{x}.n"))
    out = both.join(off, keys, "left").withColumn("end_off", F.greatest(apart("a"), apart("b")))
    reason = first_reason(
        ("missingSourceGeometry", F.col("s_a").isNull()),
        ("globalConsumedAsLocal", (F.col("f_reach") > F.greatest(F.lit(1e4), 50 * F.col("s_reach"))) & (F.col("s_reach") < 5000)),
        ("sourceCorridorExceeded", (F.col("max_off") > most) | (F.col("end_off") > most)),
    )
    return out.select(*keys, "max_off", "end_off", reason.alias("reason"))
