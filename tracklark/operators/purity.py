"""Clusters of curves that show one line: strands by reach and heading, split where two lines stand side by side for long enough."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.operators.carried import carried
from tracklark.operators.sequence import ordered, split_by
from tracklark.operators.statistics import order_statistics, upper_median
from tracklark.sources.scratch import saved

# Reach of a strand beyond its end and its headings' tolerance; stations, what is bimodal, for how long, how tight modes are.
REACH, MOST_TURN = 8.0, 70.0
STATION, LEAST_SPREAD, LEAST_GAP, LEAST_RUN, MOST_MAD = 2.0, 8.0, 3.0, 30.0, 2.5


def strands(curves: DataFrame, keys: list[str], id_: str, s0: str, s1: str, heading: str, reach: float = REACH, most_turn: float = MOST_TURN) -> DataFrame:
    """curves with strand, the id of the strand's first curve: in the order of s0, a curve joins the first strand of its key that ends at
    most reach before it and whose first curve's heading is within most_turn (a null heading fits all), else it begins one. The state
    are the strands that can still be reached."""

    def step(g: pd.DataFrame, state: list | None):
        live, names = list(state or []), []
        for name, a, b, h in zip(g[id_].tolist(), g[s0].tolist(), g[s1].tolist(), g[heading].tolist(), strict=True):
            h = None if h is None or h != h else h
            live = [x for x in live if a <= x[1] + reach]
            found = next((x for x in live if h is None or x[2] is None or abs((h - x[2] + 180.0) % 360.0 - 180.0) <= most_turn), None)
            if found is None:
                live.append(found := [name, b, h])
            else:
                found[1] = max(found[1], b)
            names.append(found[0])
        return {"strand": np.array(names)}, live

    return carried(curves, keys, [s0, id_], step, f"strand {curves.schema[id_].dataType.simpleString()}")


def stations(samples: DataFrame, strand: str, curve: str, s: str, d: str, step: float = STATION) -> DataFrame:
    """strand, curve, k, d: each curve's d at the strand's stations, which lie step apart from half a step after its start, linear between
    the curve's samples."""
    w = ordered([strand, curve], [s])
    begin = samples.groupBy(strand).agg((F.min(s) + step / 2).alias("_b"))
    pairs = samples.select(strand, curve, F.col(s).alias("_s"), F.col(d).alias("_d"), F.lead(s).over(w).alias("_s2"), F.lead(d).over(w).alias("_d2"), F.lead(s, 2).over(w).isNull().alias("_ends")).filter("_s2 > _s").join(begin, strand)
    at = lambda c: (F.col(c) - F.col("_b")) / step
    grid = pairs.withColumn("k", F.explode(F.sequence(F.ceil(at("_s")), F.greatest(F.floor(at("_s2")), F.ceil(at("_s")))))).withColumn("_x", F.col("_b") + F.col("k") * step)
    inside = grid.filter((F.col("k") >= 0) & (F.col("_x") >= F.col("_s")) & ((F.col("_x") < F.col("_s2")) | (F.col("_ends") & (F.col("_x") == F.col("_s2")))))
    return inside.select(strand, curve, "k", (F.col("_d") + (F.col("_d2") - F.col("_d")) * (F.col("_x") - F.col("_s")) / (F.col("_s2") - F.col("_s"))).alias("d"))


def modes(placed: DataFrame, strand: str, step: float = STATION) -> DataFrame:
    """strand, k, spread, gap, middle, bimodal of the stations with two values or more; middle is that of the largest gap (the lowest)."""
    w = W.partitionBy(strand, "k").orderBy("d")
    gap = F.col("d") - F.lag("d").over(w)
    steps = placed.withColumns({"_gap": gap, "_mid": F.col("d") - gap / 2})
    top = F.struct(-F.col("_gap"), "_mid")
    found = steps.groupBy(strand, "k").agg((F.max("d") - F.min("d")).alias("spread"), F.max("_gap").alias("gap"), F.min_by("_mid", F.when(F.col("_gap").isNotNull(), top)).alias("middle")).filter("gap is not null")
    return found.withColumn("bimodal", (F.col("spread") > LEAST_SPREAD) & (F.col("gap") > LEAST_GAP))


def split(samples: DataFrame, strand: str, curve: str, s: str, d: str, step: float = STATION, least_run: float = LEAST_RUN) -> DataFrame:
    """strand, curve, part: 0 for the curves of a strand that stays whole; 1 and 2 for those below and above where it is split, 3 for
    those that do not reach the place. No curve is lost.

    A strand is split at its longest run of stations in a row that are bimodal (of equal ones the first), if that spans least_run. The
    level is the upper median of the middles there; a curve's side is that of its median there. Both sides must hold a curve, and the
    values of each must have a MAD of at most MOST_MAD. All but the last steps work on stations, none on a strand as a whole."""
    placed = saved(stations(samples, strand, curve, s, d, step))
    found = modes(placed, strand, step)
    runs = split_by(found, [strand], ["k"], ~F.col("bimodal").eqNullSafe(F.lag("bimodal").over(ordered([strand], ["k"]))), "_run").filter("bimodal")
    sizes = runs.groupBy(strand, "_run").agg(F.count(F.lit(1)).alias("_n"))
    best = sizes.groupBy(strand).agg(F.min_by("_run", F.struct(-F.col("_n"), "_run")).alias("_run"), F.max("_n").alias("_n")).filter(F.col("_n") >= max(2, round(least_run / step)))
    inside = saved(runs.join(best.select(strand, "_run"), [strand, "_run"]).select(strand, "k", "middle"))
    level = upper_median(inside, [strand], "middle").withColumnRenamed("upper_median", "_level")
    there = placed.join(inside.select(strand, "k"), [strand, "k"])
    two = {"_a": F.floor((F.col("n") - 1) / 2), "_b": F.floor(F.col("n") / 2)}
    middle = lambda rows, keys, c, name: order_statistics(rows, keys, c, two).select(*keys, F.col("n").alias(f"{name}_n"), ((F.col("_a") + F.col("_b")) / 2).alias(name))
    own = middle(there, [strand, curve], "d", "_own").join(level, strand)
    sides = saved(own.select(strand, curve, F.when(F.col("_own") < F.col("_level"), 1).otherwise(2).alias("_side")))
    values = there.join(sides, [strand, curve])
    off = values.join(middle(values, [strand, "_side"], "d", "_mid"), [strand, "_side"]).withColumn("_off", F.abs(F.col("d") - F.col("_mid")))
    tight = middle(off, [strand, "_side"], "_off", "_mad").filter((F.col("_mad") <= MOST_MAD) & (F.col("_mad_n") >= 2))
    divided = tight.groupBy(strand).agg(F.count(F.lit(1)).alias("_sides")).filter("_sides = 2").select(strand, F.lit(True).alias("_divided"))
    members = samples.select(strand, curve).distinct().join(divided, strand, "left").join(sides, [strand, curve], "left")
    return members.select(strand, curve, F.when(F.col("_divided"), F.coalesce("_side", F.lit(3))).otherwise(0).alias("part"))
