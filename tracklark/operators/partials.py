"""Summaries that new rows update without reading the old ones again: a table of counts for each value, which adds up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.operators.statistics import summary_of_counts

PART = ["metric", "value", "n"]


def partial(rows: DataFrame, keys: list[str], values: dict[str, Column], flags: dict[str, Column], places: int = 6) -> DataFrame:
    """keys, metric, value, n: how often each metric takes each value, rounded to places; for a flag, value is null and n the number of
    rows for which it holds. Values that are null or not finite do not count. The table is bounded by the values' range over their
    precision, not by the rows."""
    entry = lambda name, value, n: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), n.cast("long").alias("n"))
    counts = [entry(k, F.round(v.cast("double"), places), F.when(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")), 1).otherwise(0)) for k, v in values.items()]
    held = [entry(k, F.lit(None), F.when(v, 1).otherwise(0)) for k, v in flags.items()]
    each = rows.select(*keys, F.inline(F.array(*counts, *held)))
    # Flags keep their zeros, so that a key where none holds is known.
    return each.filter(F.col("metric").isin(*flags) | (F.col("n") > 0)).groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """One table of counts from several with the same keys; the order and the number of merges do not matter."""
    keys = [c for c in parts[0].columns if c not in PART]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))


def summaries(part: DataFrame, places: int = 4) -> DataFrame:
    """keys, metric, n, min, max, mean and percentiles of each metric that is not a flag."""
    keys = [c for c in part.columns if c not in PART]
    return summary_of_counts(part.filter("value is not null").withColumnRenamed("n", "_n"), [*keys, "metric"], "value", places)


def totals(part: DataFrame) -> DataFrame:
    """keys, metric, n of the flags."""
    keys = [c for c in part.columns if c not in PART]
    return part.filter("value is null").groupBy(*keys, "metric").agg(F.sum("n").alias("n"))


def histogram(part: DataFrame, metric: str, low: float, high: float, bins: int) -> DataFrame:
    """keys, bin, n: half-open bins, the last closed; what lies outside goes to the last bin."""
    keys = [c for c in part.columns if c not in PART]
    v, width = F.col("value"), (high - low) / bins
    at = F.when((v >= low) & (v < high), F.floor((v - low) / width)).otherwise(bins - 1).cast("long")
    return part.filter((F.col("metric") == metric) & v.isNotNull()).groupBy(*keys, at.alias("bin")).agg(F.sum("n").alias("n"))


def save_part(part: DataFrame, path: str, batch: str | int) -> None:
    """Adds the counts of one batch of files to a stored table; a batch that is saved again takes its own place, so a retry counts once."""
    part.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all batches saved below path."""
    return merged(spark.read.option("basePath", path).parquet(path).drop("batch"))


def keep_up(stream: DataFrame, path: str, checkpoint: str, keys: list[str], values: dict[str, Column], flags: dict[str, Column]):
    """Starts a query that saves the counts of every micro-batch of a stream under the batch's number."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: save_part(partial(rows, keys, values, flags), path, batch)).start()
