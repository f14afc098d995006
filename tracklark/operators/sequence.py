"""Sequences: sessions by gaps or compound rules, islands, running lengths, rank changes; all as windows over a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.sources.scratch import saved

def ordered(keys: list[str], order: list[str]) -> W:
    return W.partitionBy(*keys).orderBy(*order)


def split_by(rows: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """Numbers the runs of a key's rows from 0; a row where starts holds begins a new one (null: no)."""
    run = F.sum(F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)).over(ordered(keys, order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, run.cast("long"))


def sessionize(rows: DataFrame, keys: list[str], time: str, tie: str, gap: int, name: str = "session") -> DataFrame:
    """A new session where the time since the row before is more than gap."""
    before = F.lag(time).over(ordered(keys, [time, tie]))
    return split_by(rows, keys, [time, tie], F.col(time) - before > gap, name)


def sessionize_compound(rows: DataFrame, keys: list[str], time: str, tie: str, reason: Column, minor: str) -> DataFrame:
    """chunk advances at every reason, session at every reason but the minor one."""
    rows = rows.withColumn("reason", reason)
    rows = split_by(rows, keys, [time, tie], F.col("reason").isNotNull(), "chunk")
    return split_by(rows, keys, [time, tie], F.col("reason").isNotNull() & (F.col("reason") != minor), "session")


def longest_island(rows: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """The rows of each key's longest run; of equal ones the earliest."""
    numbered = split_by(rows, keys, order, starts, "island")
    sizes = numbered.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("island_rows"))
    best = sizes.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("island_rows"), "island"))).filter("_r = 1").drop("_r")
    return numbered.join(best, [*keys, "island"])


def running_length(rows: DataFrame, keys: list[str], order: list[str], step: Column, name: str = "s") -> DataFrame:
    """Arc length up to each row; step is the length from the row before (null at the first)."""
    return rows.withColumn(name, F.sum(F.coalesce(step, F.lit(0))).over(ordered(keys, order).rowsBetween(W.unboundedPreceding, 0)))


def above_running_max(rows: DataFrame, keys: list[str], order: list[str], value: str, slack: float = 0.0) -> DataFrame:
    """Rows whose value is at least the largest kept so far less slack. A row that is left out lies below the largest kept one, so the
    running maximum of all rows is that of the kept ones, whatever the slack."""
    top = F.max(value).over(ordered(keys, order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_top", top).filter(F.col("_top").isNull() | (F.col(value) >= F.col("_top") - slack)).drop("_top")


def rank_changes(rows: DataFrame, frame: list[str], item: str, value: str, order: list[str]) -> DataFrame:
    """Per item: in how many frames its rank by value (largest first) differs from that in its frame before."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*frame).orderBy(F.desc(value), item)))
    before = F.lag("rank").over(W.partitionBy(item).orderBy(*order))
    return ranked.withColumn("_b", before).groupBy(item).agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("rank") != F.col("_b")).alias("n_changes"))


def centred_average(rows: DataFrame, keys: list[str], order: list[str], value: str, reach: int, most_shift: float, name: str) -> DataFrame:
    """Moving average over reach rows on each side; the first and last reach rows stay, and no value moves by more than most_shift."""
    w = ordered(keys, order)
    around = w.rowsBetween(-reach, reach)
    full = F.count(F.lit(1)).over(around) == 2 * reach + 1
    shift = F.avg(value).over(around) - F.col(value)
    return rows.withColumn(name, F.when(full, F.col(value) + F.greatest(F.lit(-most_shift), F.least(F.lit(most_shift), shift))).otherwise(F.col(value)))


def consecutive_pairs(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the named columns of the next one as next_<column>; the last row of a key is in no pair."""
    w = ordered(keys, order)
    out = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).withColumn("_more", F.lead(F.lit(1)).over(w))
    return out.filter("_more = 1").drop("_more")


def ranked(rows: DataFrame, order: list[str], name: str = "_rank", weight: str | None = None) -> DataFrame:
    """rows with their place in the order (from 0) over the whole table, or with the sum of the weight of the rows before: ranges of the
    order are added up each, and the ranges' totals, one row for each partition, are put on top."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # Written once, so that both uses see the same ranges.
    parts = saved(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    each = F.lit(1) if weight is None else F.col(weight)
    counts = parts.groupBy("_part").agg(F.sum(each).alias("_n"))
    before = counts.withColumn("_upto", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    own = parts.withColumn(name, F.sum(each).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - each)
    return own.join(F.broadcast(before.select("_part", "_upto")), "_part").withColumn(name, F.col(name) + F.col("_upto")).drop("_part", "_upto")
