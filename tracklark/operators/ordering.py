"""Lateral order from frame to frame: inversions counted by halving ranks instead of by pairs, and episodes of them over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.operators.sequence import ordered, split_by


def transitions(rows: DataFrame, keys: list[str], frame: str, item: str, value: str) -> DataFrame:
    """keys, frame, n_common, n_pairs, n_mismatches, n_inversions, kind of each frame that has one before it: items in both frames, their
    pairs, places at which the item is another than before, pairs whose order has changed, and pairwise_inversion, support_change_only
    (places differ only because items came or went) or null. Items are ranked by falling value, then by item; an item is in a frame once.

    Two items are inverted if their ranks agree down to a bit, in which the earlier one has 1 and the later one 0. So for each bit, items
    with 0 count those with 1 before them in their group: rows times bits, and no pairs."""
    first = rows.groupBy(*keys, frame, item).agg(F.max(value).alias("_v"))
    ranks = first.withColumn("_r", F.row_number().over(W.partitionBy(*keys, frame).orderBy(F.desc("_v"), item)) - 1)
    frames = ranks.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("_n"))
    w = ordered(keys, [frame])
    frames = frames.withColumns({"_before": F.lag(frame).over(w), "_n0": F.lag("_n").over(w)}).filter("_before is not null")
    now = ranks.join(frames, [*keys, frame])
    then = ranks.select(*keys, F.col(frame).alias("_before"), item, F.col("_r").alias("_r0"))
    common = now.join(then, [*keys, "_before", item]).select(*keys, frame, item, "_r", "_r0")
    high = common.groupBy(*keys, frame).agg(F.max("_r").alias("_top"))
    bits = common.join(high, [*keys, frame]).withColumn("_bit", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("_top") + 1.0)).cast("int"))))
    bits = bits.withColumns({"_group": F.expr("shiftright(_r, _bit + 1)"), "_one": F.expr("shiftright(_r, _bit) & 1")})
    ones = F.sum("_one").over(W.partitionBy(*keys, frame, "_bit", "_group").orderBy("_r0").rowsBetween(W.unboundedPreceding, 0))
    inverted = bits.withColumn("_k", F.when(F.col("_one") == 0, ones).otherwise(0)).groupBy(*keys, frame).agg(F.sum("_k").alias("n_inversions"))
    counted = common.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("n_common"), F.count_if(F.col("_r") == F.col("_r0")).alias("_same"))
    out = frames.join(counted, [*keys, frame], "left").join(inverted, [*keys, frame], "left").na.fill(0, ["n_common", "_same", "n_inversions"])
    c = F.col("n_common")
    out = out.withColumns({"n_pairs": (c * (c - 1) / 2).cast("long"), "n_mismatches": F.least("_n", "_n0") - F.col("_same")})
    kind = F.when(F.col("n_inversions") > 0, "pairwise_inversion").when(F.col("n_mismatches") > 0, "support_change_only")
    return out.select(*keys, frame, "n_common", "n_pairs", "n_mismatches", "n_inversions", kind.alias("kind"))


def episodes(found: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """keys, episode, kind, first, last, n_transitions, n_inversions: consecutive transitions of one kind (of `transitions`)."""
    before = F.lag("kind").over(ordered(keys, [frame]))
    runs = split_by(found, keys, [frame], ~F.col("kind").eqNullSafe(before), "episode").filter("kind is not null")
    return runs.groupBy(*keys, "episode", "kind").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("n_transitions"), F.sum("n_inversions").alias("n_inversions"))


def audit(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the sums over their transitions."""
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_transitions"), F.sum("n_pairs").alias("n_pairs"), F.sum("n_mismatches").alias("n_mismatches"), F.sum("n_inversions").alias("n_inversions"), F.count_if(F.col("kind") == "support_change_only").alias("n_support_only"))
