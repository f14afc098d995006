"""What is visible at a moment: causal prefixes, the current frame, positions on a timed path, appended sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklark.operators.temporal import asof_interpolate


def causal(rows: DataFrame, index: str, now: int | Column) -> DataFrame:
    """Rows up to the moment."""
    return rows.filter(F.col(index) <= now)


def current_rows(rows: DataFrame, queries: DataFrame, query: str, frame: str, index: str, time: str) -> DataFrame:
    """The rows of the frame that each query shows (query, frame, index, time): that of its frame id, else of its index, else of the latest
    time before it. Frames are few against rows, so they are told first and joined back."""
    frames = rows.select(F.col(frame).alias("_f"), F.col(index).alias("_i"), F.col(time).alias("_t")).distinct()
    by_id = queries.join(frames, F.col(frame) == F.col("_f")).select(query, F.struct(F.lit(0).alias("r"), F.lit(0).cast("long").alias("o"), "_f", "_i", "_t").alias("x"))
    by_index = queries.join(frames, F.col(index) == F.col("_i")).select(query, F.struct(F.lit(1).alias("r"), F.lit(0).cast("long").alias("o"), "_f", "_i", "_t").alias("x"))
    latest = queries.select(query, F.col(time).alias("_q")).join(frames.select("_t").distinct(), F.col("_t") <= F.col("_q")).groupBy(query).agg(F.max("_t").alias("_t"))
    by_time = latest.join(frames, "_t").select(query, F.struct(F.lit(2).alias("r"), F.lit(0).cast("long").alias("o"), "_f", "_i", "_t").alias("x"))
    best = by_id.union(by_index).union(by_time).groupBy(query).agg(F.min("x").alias("x")).select(query, F.col("x._f").alias("_f"), F.col("x._i").alias("_i"))
    return best.join(rows, (F.col(frame) == F.col("_f")) & (F.col(index) == F.col("_i"))).drop("_f", "_i")


def positions_at(queries: DataFrame, path: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """queries with the columns of a timed path interpolated at their time; before and after it the ends hold."""
    out = queries
    for c in columns:
        out = asof_interpolate(out, path.groupBy(key, time).agg(F.max(c).alias(c)), key, time, c, 1 << 62)
    return out


def visible(rows: DataFrame, source: str, shown: DataFrame) -> DataFrame:
    """Rows of the sources that are shown (a column of the same name)."""
    return rows.join(shown.select(source).distinct(), source, "left_semi")


def leaks(rows: DataFrame, source: str, shown: DataFrame) -> DataFrame:
    """source, n_rows of sources that are in the rows but not shown; must be empty."""
    return rows.join(shown.select(source).distinct(), source, "left_anti").groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"))


def append_decision(revealed: Column, following: Column, prepared: Column) -> Column:
    """What becomes of an append: commit, rollback, or commitWithoutLookahead if the next source exists but could not be prepared."""
    return F.when(~F.coalesce(revealed, F.lit(False)), "rollback").when(following.isNotNull() & ~F.coalesce(prepared, F.lit(False)), "commitWithoutLookahead").otherwise("commit")


def appended(frozen: DataFrame, fresh: DataFrame, source: str, new: DataFrame) -> DataFrame:
    """The frozen rows as they are and the fresh ones of new sources only, so that nothing shown before can change."""
    return frozen.unionByName(fresh.join(new.select(source).distinct(), source, "left_semi").join(frozen.select(source).distinct(), source, "left_anti"))
