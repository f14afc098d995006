"""Decisions against labels: confusion, metrics in two conventions, sweeps of parameters, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.operators.sequence import ranked

def confusion(rows: DataFrame, keys: list[str], said: Column, true: Column) -> DataFrame:
    """tp, fp, fn, tn per key; rows without a label are left out."""
    rows = rows.withColumns({"_s": said, "_t": true}).filter("_t is not null and _s is not null")
    counts = [F.count_if(c).alias(n) for n, c in (("tp", F.col("_s") & F.col("_t")), ("fp", F.col("_s") & ~F.col("_t")), ("fn", ~F.col("_s") & F.col("_t")), ("tn", ~F.col("_s") & ~F.col("_t")))]
    return rows.groupBy(*keys).agg(*counts)


def metrics(rows: DataFrame, zero: float | None = None, places: int = 4) -> DataFrame:
    """rows (tp, fp, fn, tn) with precision, recall, f1, accuracy, balanced_accuracy and macro_f1; over 0 a rate is `zero` (null or 0)."""
    share = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(zero))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall, special = share(tp, tp + fp), share(tp, tp + fn), share(tn, tn + fp)
    values = {"precision": precision, "recall": recall, "f1": share(2 * tp, 2 * tp + fp + fn), "accuracy": share(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (recall + special) / 2, "macro_f1": (share(2 * tp, 2 * tp + fp + fn) + share(2 * tn, 2 * tn + fp + fn)) / 2}
    return rows.withColumns({k: F.round(v, places) for k, v in values.items()})


def sweep(rows: DataFrame, name: str, values: list[float], decide: Column, true: Column) -> DataFrame:
    """Metrics for each value of a parameter, which decide reads as the column `name`. The values are a literal array in each row, so
    the data is scanned and shuffled once for all of them."""
    each = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return metrics(confusion(each, [name], decide, true))


def stride_sample(rows: DataFrame, strata: list[str], order: list[str], n: int) -> DataFrame:
    """About n rows of each stratum at equal strides (every ceil(rows / n)-th), not at random."""
    w = W.partitionBy(*strata)
    ranked = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return ranked.filter(F.col("_i") % F.ceil(F.col("_n") / n) == 0).drop("_i", "_n")


def hash_split(rows: DataFrame, key: str, seed: str, percent: int) -> DataFrame:
    """rows with split: calibration for about percent of the keys by their seeded SHA-256, validation for the others. No shuffle."""
    digest = F.sha2(F.concat(F.lit(f"{seed}::"), F.col(key).cast("string")), 256)
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("split", F.when(share < percent, "calibration").otherwise("validation"))


def folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """rows with fold: the groups' dense rank modulo k. Only the distinct groups are ranked, in ranges."""
    groups = ranked(rows.select(group).distinct(), [group], "fold").withColumn("fold", F.col("fold") % k)
    return rows.join(groups, group)


def batches(rows: DataFrame, keys: list[str], order: list[str], size: int, least: int) -> DataFrame:
    """rows with batch: size rows each by order; a last batch of fewer than least rows joins the one before."""
    w = W.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w)
    full = F.floor(n / size)
    last = F.when(n % size >= least, full).otherwise(F.greatest(full - 1, F.lit(0)))
    return rows.withColumn("batch", F.least(F.floor(i / size), last).cast("long"))


def decision_change(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """Counts of the four ways from one decision to the other."""
    name = F.when(before & after, "keptYes").when(before, "lost").when(after, "gained").otherwise("keptNo")
    return rows.groupBy(name.alias("change")).agg(F.count(F.lit(1)).alias("n"))
