"""Accumulated points of a local map: cells of a standstill, turning, disagreement with the frame before, profiles, bounds, gaps, clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions.scalars import half_up
from tracklark.operators.sequence import ordered
from tracklark.operators.statistics import weighted_median
from tracklark.operators.temporal import nearest


def stationary_cells(rows: DataFrame, keys: list[str], e: str, n: str, weight: str, cell: float = 0.25) -> DataFrame:
    """keys, cell_e, cell_n, n, weight (median), east, north (weighted medians): one row for each cell that holds points."""
    at = [*keys, "cell_e", "cell_n"]
    rows = rows.withColumns({"cell_e": half_up(F.col(e) / cell).cast("long"), "cell_n": half_up(F.col(n) / cell).cast("long")})
    out = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.percentile(weight, 0.5).alias("weight"))
    for value, name in ((e, "east"), (n, "north")):
        out = out.join(weighted_median(rows.filter(F.col(value).isNotNull()), at, value, weight).withColumnRenamed("weighted_median", name), at, "left")
    return out


def distinct_poses(rows: DataFrame, keys: list[str], e: str, n: str, cell: float = 0.5) -> DataFrame:
    """keys, n_poses: places that differ after rounding to cells."""
    return rows.groupBy(*keys).agg(F.count_distinct(half_up(F.col(e) / cell), half_up(F.col(n) / cell)).alias("n_poses"))


def turning(rows: DataFrame, keys: list[str], time: str, tie: str, heading: str, speed: str, window: float = 4.0, slow: float = 1.0) -> DataFrame:
    """rows with dt and turn_rate (degrees a unit of time) since the last row with a heading, if that lies within the window. A row
    slower than `slow` does not turn: its rate is null, as it is without a heading."""
    known = F.when(F.col(heading).isNotNull(), F.struct(F.col(time).alias("t"), F.col(heading).alias("h")))
    rows = rows.withColumn("_p", F.last(known, True).over(ordered(keys, [time, tie]).rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("dt", F.when(F.col(time) - F.col("_p.t") <= window, F.col(time) - F.col("_p.t")))
    turn = F.pmod(F.col(heading) - F.col("_p.h") + 180, F.lit(360)) - 180
    # A half turn keeps the sign of the plain difference.
    turn = F.when((turn == -180) & (F.col(heading) > F.col("_p.h")), 180).otherwise(turn)
    moving = (F.coalesce(F.col(speed), F.lit(0)) >= slow) & (F.col("dt") >= 1e-3)
    return rows.withColumn("turn_rate", F.when(moving, turn / F.col("dt"))).drop("_p")


def disagreement(points: DataFrame, keys: list[str], frame: str, id_: str, x: str, e: str, n: str, progress: str, reach: float = 10.0) -> DataFrame:
    """points with disagreement: the distance to the point of the key's frame before whose x is nearest to x + progress (of equally near
    ones the smaller x, then the smaller id), null beyond reach, without a frame before or where progress is not positive. Both frames
    are merged by a window, not compared pairwise."""
    frames = points.select(*keys, frame).distinct()
    frames = frames.withColumn("_before", F.lag(frame).over(ordered(keys, [frame])))
    asked = points.join(frames, [*keys, frame]).filter(F.col("_before").isNotNull() & (F.col(progress) > 0))
    asked = asked.select(F.struct(*keys, F.col("_before").alias(frame)).alias("_at"), (F.col(x) + F.col(progress)).alias("_x"), F.col(id_).alias("_asks"))
    there = points.select(F.struct(*keys, frame).alias("_at"), F.col(x).alias("_x"), F.col(id_).alias("_id"))
    found = nearest(asked, there, "_at", "_x", "_id").filter(F.col("gap") <= reach).select(F.col("_asks").alias(id_), "_id")
    target = points.select(F.col(id_).alias("_id"), F.col(e).alias("_e"), F.col(n).alias("_n"))
    met = found.join(target, "_id").select(id_, "_e", "_n")
    return points.join(met, id_, "left").withColumn("disagreement", F.hypot(F.col(e) - F.col("_e"), F.col(n) - F.col("_n"))).drop("_e", "_n")


def profile(rows: DataFrame, keys: list[str], id_: str, s: str, d: str, step: float) -> DataFrame:
    """keys, s, d: from a key's least s in steps up to its greatest, each with the d of the nearest row (ties: smaller s, then id)."""
    ends = rows.groupBy(*keys).agg(F.min(s).alias("_a"), F.max(s).alias("_b"))
    grid = ends.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_b") - F.col("_a")) / step))))
    grid = grid.select(F.struct(*keys).alias("_at"), (F.col("_a") + F.col("_i") * step).alias("_s"))
    there = rows.select(F.struct(*keys).alias("_at"), F.col(s).alias("_s"), F.col(id_).alias("_id"))
    found = nearest(grid, there, "_at", "_s", "_id")
    return found.join(rows.select(F.col(id_).alias("_id"), F.col(d).alias("d")), "_id").select("_at.*", F.col("_s").alias("s"), "d")


def profile_rmse(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, rmse of d over the places s that both profiles share exactly; keys without any are left out."""
    both = a.select(*keys, "s", "d").join(b.select(*keys, "s", F.col("d").alias("_d")), [*keys, "s"])
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("d") - F.col("_d")) ** 2)).alias("rmse"))


def bounds(rows: DataFrame, keys: list[str], e: str, n: str, least: float = 5.0, share: float = 0.08) -> DataFrame:
    """keys, min_e, max_e, min_n, max_n: the box of the points and the origin, padded by a share of its size, at least `least`."""
    good = lambda c: F.when(F.col(e).isNotNull() & F.col(n).isNotNull() & ~F.isnan(F.col(e).cast("double")) & ~F.isnan(F.col(n).cast("double")), F.col(c).cast("double"))
    zero = F.lit(0.0)
    box = rows.groupBy(*keys).agg(*(f(F.coalesce(g(good(c)), zero), zero).alias(f"_{name}") for name, c, f, g in (("w", e, F.least, F.min), ("e", e, F.greatest, F.max), ("s", n, F.least, F.min), ("n", n, F.greatest, F.max))))
    wide, high = (F.greatest(F.lit(least), (F.col(b) - F.col(a)) * share) for a, b in (("_w", "_e"), ("_s", "_n")))
    return box.select(*keys, (F.col("_w") - wide).alias("min_e"), (F.col("_e") + wide).alias("max_e"), (F.col("_s") - high).alias("min_n"), (F.col("_n") + high).alias("max_n"))


def largest_gap(rows: DataFrame, keys: list[str], chunk: str, order: list[str], e: str, n: str) -> DataFrame:
    """keys, chunk, next_chunk, gap: where the way from a chunk's last row to the next one's first is longest (ties: the earliest); keys
    whose chunks all touch are left out."""
    place = F.struct(*order)
    ends = rows.groupBy(*keys, chunk).agg(*(f(F.struct(F.col(e), F.col(n)), place).alias(name) for name, f in (("_first", F.min_by), ("_last", F.max_by))))
    w = ordered(keys, [chunk])
    steps = ends.withColumns({"next_chunk": F.lead(chunk).over(w), "_next": F.lead("_first").over(w)}).filter("next_chunk is not null")
    gap = F.hypot(F.col(f"_next.{e}") - F.col(f"_last.{e}"), F.col(f"_next.{n}") - F.col(f"_last.{n}"))
    best = steps.withColumn("gap", gap).filter("gap > 0").withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("gap"), chunk)))
    return best.filter("_r = 1").select(*keys, chunk, "next_chunk", "gap")


def first_sign_change(rows: DataFrame, keys: list[str], order: list[str], s: str, value: str) -> DataFrame:
    """keys, s of the first row whose sign differs from that of the last row that had one; nulls and zeros have none."""
    sign = F.when(F.col(value) != 0, F.signum(value))
    rows = rows.withColumns({"_sign": sign, "_past": F.last(sign, True).over(ordered(keys, order).rowsBetween(W.unboundedPreceding, -1))})
    turned = rows.filter("_sign != _past")
    return turned.groupBy(*keys).agg(F.min_by(F.col(s), F.struct(*order)).alias(s))


def best_of(rows: DataFrame, keys: list[str], order: list[str | Column], limit: int = 64) -> DataFrame:
    """The first `limit` rows of each key in a total order, with their place; Spark prunes each partition to that many before it shuffles."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= limit)


def ring_area(ring: Column) -> Column:
    """The signed area of an open ring of (e, n): positive if it goes against the clock."""
    n = F.size(ring)
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(ring, i)
    cross = lambda i: at(i)["e"] * at((i + 1) % n)["n"] - at((i + 1) % n)["e"] * at(i)["n"]
    return F.aggregate(F.transform(index, cross), F.lit(0.0), lambda a, b: a + b) / 2


RING = "array<struct<e:double,n:double>>"


def clipped(ring: Column, window: Column) -> Column:
    """The part of a ring inside a convex ring that goes against the clock, both open arrays of RING: each edge of the window in turn
    keeps the points on its left and adds those where the ring crosses it. Empty where nothing is left."""
    m = F.size(window)
    edges = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(F.get(window, i).alias("a"), F.get(window, (i + 1) % m).alias("b")))

    def cut(now: Column, edge: Column) -> Column:
        a, b, n = edge["a"], edge["b"], F.size(now)
        side = lambda p: (b["e"] - a["e"]) * (p["n"] - a["n"]) - (b["n"] - a["n"]) * (p["e"] - a["e"])

        def step(p: Column, i: Column) -> Column:
            q = F.get(now, (i + 1) % n)
            share = side(p) / (side(p) - side(q))
            meets = F.struct((p["e"] + share * (q["e"] - p["e"])).alias("e"), (p["n"] + share * (q["n"] - p["n"])).alias("n"))
            own = F.when(side(p) >= 0, F.array(F.struct(p["e"].alias("e"), p["n"].alias("n")))).otherwise(F.array())
            return F.concat(own, F.when((side(p) >= 0) != (side(q) >= 0), F.array(meets)).otherwise(F.array()))

        return F.flatten(F.transform(now, step)).cast(RING)

    return F.aggregate(edges, ring.cast(RING), cut)
