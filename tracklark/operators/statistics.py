"""Exact and robust statistics as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.operators.sequence import ranked

def order_statistics(rows: DataFrame, keys: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """keys, n, min, max, mean and, by name, the value at each position (from 0; a column of n) of the sorted values that are not null.

    Values are counted first; the counts' running sum goes over ranges of (keys, value), so neither a hot key nor its many values meet in
    one task or one aggregate's state."""
    return of_counts(rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), keys, value, positions)


def of_counts(counts: DataFrame, keys: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """order_statistics of a table that counts each value once (keys, value, _n)."""
    placed = ranked(counts, [*keys, value], "_at", "_n")
    totals = placed.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min("_at").alias("_from"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(F.col(value) * F.col("_n")).alias("_sum"))
    totals = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "n", "_from", "min", "max", (F.col("_sum") / F.col("n")).alias("mean"))
    both = placed.join(totals, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] or F.lit(True))
    first = F.col("_at") - F.col("_from")
    picks = [F.max(F.when((first <= p) & (first + F.col("_n") > p), F.col(value))).alias(name) for name, p in positions.items()]
    return both.groupBy(*keys, "n", "min", "max", "mean").agg(*picks)


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, upper_median: the upper of the two middle values."""
    return order_statistics(rows, keys, value, {"upper_median": F.floor(F.col("n") / 2)}).select(*keys, "upper_median")


def with_mad(rows: DataFrame, keys: list[str], value: str, scale: float = 1.0, floor: float = 0.0) -> DataFrame:
    """rows with median, mad (of the key; scaled, at least floor) and deviation."""
    middle = rows.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))
    off = rows.join(middle, keys).withColumn("deviation", F.abs(F.col(value) - F.col("median")))
    spread = off.groupBy(*keys).agg(F.greatest(F.percentile("deviation", 0.5) * scale, F.lit(floor)).alias("mad"))
    return off.join(spread, keys)


def with_median(rows: DataFrame, keys: list[str], value: str, name: str, count: str | None = None) -> DataFrame:
    """rows with name: the median of the key's values that are not null, as F.percentile gives it; with count, each row stands for that many.
    A window, so a key's rows are sorted in one task, and spill; it pays where several such steps share one dealing by key."""
    w = W.partitionBy(*keys)
    by = w.orderBy(F.asc_nulls_last(value))
    if count is None:
        at, n = F.row_number().over(by), F.count(value).over(w)
    else:
        of = F.when(F.col(value).isNotNull(), F.col(count))
        at, n = F.sum(of).over(by.rowsBetween(W.unboundedPreceding, 0)), F.coalesce(F.sum(of).over(w), F.lit(0))
    placed = rows.withColumns({"_at": at, "_n_all": n})
    v, before = F.col(value).cast("double"), F.col("_at") - (F.lit(1) if count is None else F.col(count))
    low, high = F.floor((F.col("_n_all") + 1) / 2), F.floor(F.col("_n_all") / 2) + 1
    pick = lambda p: F.max(F.when((before < p) & (p <= F.col("_at")) & (F.col("_n_all") > 0), v)).over(w)
    ends = placed.withColumns({"_low": pick(low), "_high": pick(high)})
    middle = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(0.5 * F.col("_low") + 0.5 * F.col("_high"))
    return ends.withColumn(name, middle).drop("_at", "_n_all", "_low", "_high")


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, weighted_median: the first value at which the running weight reaches half of the total (the lower one)."""
    by_value = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))  # combined before the shuffle
    w = W.partitionBy(*keys)
    run = by_value.withColumns({"_run": F.sum("_w").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_w").over(w)})
    return run.filter("2 * _run >= _all").groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n: half-open bins, the last closed; what lies outside goes to the last bin."""
    v = F.col(value)
    width = (high - low) / bins
    inside = (v >= low) & (v < high)
    return rows.filter(v.isNotNull()).groupBy(F.when(inside, F.floor((v - low) / width)).otherwise(bins - 1).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


SHARES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def summary(rows: DataFrame, keys: list[str], value: str, places: int = 4) -> DataFrame:
    """keys, n, min, max, mean and percentiles (interpolated on (n - 1) p) of the finite values."""
    counts = finite(rows, value).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return summary_of_counts(counts, keys, value, places)


def finite(rows: DataFrame, value: str) -> DataFrame:
    return rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(value) != float("inf")))


def summary_of_counts(counts: DataFrame, keys: list[str], value: str, places: int = 4) -> DataFrame:
    """summary of a table that counts each finite value once (keys, value, _n)."""
    at = {k: (F.col("n") - 1) * p for k, p in SHARES.items()}
    picks = {f"_{k}{side}": f(x) for k, x in at.items() for side, f in (("l", F.floor), ("h", F.ceil))}
    found = of_counts(counts, keys, value, picks)
    parts = [F.round(F.col(f"_{k}l") + (F.col(f"_{k}h") - F.col(f"_{k}l")) * (x - F.floor(x)), places).alias(k) for k, x in at.items()]
    return found.select(*keys, "n", "min", "max", F.round("mean", places).alias("mean"), *parts)


def robust_bins(rows: DataFrame, keys: list[str], bin_: Column, value: str, weight: str, k: float = 3.0, floor: float = 0.3, least: int = 3) -> DataFrame:
    """Per key and bin: rows, inliers (within k MADs, the MAD at least floor) and their weighted median; bins of fewer rows are rejected
    with a reason. All steps are aggregations by (key, bin) on one partitioning."""
    at = [*keys, "bin"]
    binned = with_mad(rows.withColumn("bin", bin_.cast("long")), at, value, floor=floor)
    inliers = binned.filter(F.col("deviation") <= k * F.col("mad"))
    counts = binned.groupBy(*at).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("deviation") <= k * F.col("mad")).alias("n_inliers"))
    fused = counts.join(weighted_median(inliers, at, value, weight), at, "left")
    ok = F.col("n_inliers") >= least
    return fused.select(*at, "n_rows", "n_inliers", F.when(ok, F.col("weighted_median")).alias("fused"), F.when(~ok, "tooFewInliers").alias("reject"))


def gap_clusters(rows: DataFrame, keys: list[str], value: str, tie: str, gap: float) -> DataFrame:
    """One-dimensional clusters: a new one where the sorted values are more than gap apart."""
    w = W.partitionBy(*keys).orderBy(value, tie)
    new = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_new")


def floor_index_percentile(rows: DataFrame, keys: list[str], value: str, tie: str, share: float, low: float, high: float) -> DataFrame:
    """The value at index floor(n * share) of the sorted ones (the last at most), clamped to [low, high]."""
    w = W.partitionBy(*keys)
    ranked = rows.withColumns({"_i": F.row_number().over(w.orderBy(value, tie)) - 1, "_n": F.count(F.lit(1)).over(w)})
    pick = ranked.filter(F.col("_i") == F.least(F.floor(F.col("_n") * share), F.col("_n") - 1))
    return pick.select(*keys, F.greatest(F.lit(low), F.least(F.lit(high), F.col(value))).alias("value"))
