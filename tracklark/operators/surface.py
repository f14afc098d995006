"""From boundary samples (s, d) to surfaces: pairing of runs, resampling, width checks, rings, ribbons, adjacency and lane counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.operators.intervals import overlapping
from tracklark.operators.sequence import split_by
from tracklark.operators.spatial import resample


def supported_runs(samples: DataFrame, keys: list[str], s: str, most_gap: float) -> DataFrame:
    """samples with run: a new one where the next sample lies more than most_gap ahead."""
    step = F.col(s) - F.lag(s).over(W.partitionBy(*keys).orderBy(s))
    return split_by(samples, keys, [s], step > most_gap, "run")


def run_spans(runs: DataFrame, keys: list[str], s: str, d: str) -> DataFrame:
    """keys, run, s0, s1, mean_d, n."""
    return runs.groupBy(*keys, "run").agg(F.min(s).alias("s0"), F.max(s).alias("s1"), F.avg(d).alias("mean_d"), F.count(F.lit(1)).alias("n"))


def pair_runs(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """Pairs of left and right runs (tables of run_spans) of the same keys that overlap by at least `least` metres."""
    a = left.select(*keys, F.col("run").alias("left_run"), F.col("s0").alias("_a0"), F.col("s1").alias("_a1"))
    b = right.select(*keys, F.col("run").alias("right_run"), F.col("s0").alias("_b0"), F.col("s1").alias("_b1"))
    met = overlapping(a, b, keys, "_a0", "_a1", "_b0", "_b1", least).withColumns({"s0": F.greatest("_a0", "_b0"), "s1": F.least("_a1", "_b1")})
    return met.filter("s1 > s0").select(*keys, "left_run", "right_run", "s0", "s1")


def paired_samples(left: DataFrame, right: DataFrame, keys: list[str], s: str, d: str, step: float, narrow: float, wide: float) -> DataFrame:
    """keys, s, left_d, right_d, width, valid at multiples of step where both boundaries have samples around; both sides are resampled
    to the same grid, so that they meet by an equi-join."""
    a = resample(left, keys, s, d, step).withColumnRenamed("d", "left_d")
    b = resample(right, keys, s, d, step).withColumnRenamed("d", "right_d")
    both = a.join(b, [*keys, "s"]).withColumn("width", F.col("left_d") - F.col("right_d"))
    return both.withColumn("valid", F.col("width").between(narrow, wide))


def strips(samples: DataFrame, keys: list[str], step: float, least: int = 3) -> DataFrame:
    """keys, strip, s0, s1, n, mean_width, area of the stretches of at least `least` valid samples in a row."""
    valid = samples.filter("valid")
    ahead = F.col("s") - F.lag("s").over(W.partitionBy(*keys).orderBy("s"))
    numbered = split_by(valid, keys, ["s"], ahead > 1.5 * step, "strip")
    w = W.partitionBy(*keys, "strip").orderBy("s")
    piece = (F.lead("s").over(w) - F.col("s")) * (F.col("width") + F.lead("width").over(w)) / 2
    out = numbered.withColumn("_a", F.coalesce(piece, F.lit(0.0)))
    found = out.groupBy(*keys, "strip").agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.count(F.lit(1)).alias("n"), F.avg("width").alias("mean_width"), F.sum("_a").alias("area"))
    return found.filter(F.col("n") >= least)


def rings(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring: the left boundary forwards and the right one backwards, as an array of (s, d); one ring per key, which is one strip."""
    left = F.sort_array(F.collect_list(F.struct("s", F.col("left_d").alias("d"))))
    right = F.sort_array(F.collect_list(F.struct("s", F.col("right_d").alias("d"))), asc=False)
    return samples.groupBy(*keys).agg(F.concat(left, right).alias("ring"))


def ribbon(path: DataFrame, keys: list[str], half_width: float) -> DataFrame:
    """Path segments (path_segments) with the corners of a strip of half_width on each side: left_a, left_b, right_b, right_a."""
    length = F.hypot(F.col("be") - F.col("ae"), F.col("bn") - F.col("an"))
    e, n = -(F.col("bn") - F.col("an")) / length * half_width, (F.col("be") - F.col("ae")) / length * half_width
    corner = lambda p, sign: F.struct((F.col(f"{p}e") + sign * e).alias("e"), (F.col(f"{p}n") + sign * n).alias("n"))
    return path.filter(length > 0).select(*keys, "segment", corner("a", 1).alias("left_a"), corner("b", 1).alias("left_b"), corner("b", -1).alias("right_b"), corner("a", -1).alias("right_a"))


def right_neighbours(runs: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, run, right_run: the run with the next lower mean d among those that overlap by at least `least`; none lies between, as it
    would be the nearer one."""
    b = runs.select(*keys, F.col("run").alias("right_run"), F.col("s0").alias("_s0"), F.col("s1").alias("_s1"), F.col("mean_d").alias("_d"))
    a = runs.select(*keys, "run", "s0", "s1", "mean_d")
    near = overlapping(a, b, keys, "s0", "s1", "_s0", "_s1", least).filter("_d < mean_d")
    best = near.groupBy(*keys, "run").agg(F.max(F.struct("_d", (-F.col("right_run")).alias("_r"))).alias("_x"))
    return best.select(*keys, "run", (-F.col("_x._r")).alias("right_run"))


def lane_counts(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, s0, s1, lanes: how many spans cover each stretch between borders; stretches without any are left out."""
    borders = spans.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("by")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("by")))).alias("x"))
    steps = borders.groupBy(*keys, F.col("x.at").alias("s0")).agg(F.sum("x.by").alias("_by"))
    w = W.partitionBy(*keys).orderBy("s0")
    out = steps.withColumns({"lanes": F.sum("_by").over(w.rowsBetween(W.unboundedPreceding, 0)), "s1": F.lead("s0").over(w)})
    return out.filter("lanes > 0 and s1 > s0").select(*keys, "s0", "s1", "lanes")
