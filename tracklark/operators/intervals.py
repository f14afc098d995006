"""Interval algebra per key: union, intersection, difference, overlaps. Intervals are closed numbers [start, end]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged(spans: DataFrame, keys: list[str], start: str, end: str, slack: float = 0) -> DataFrame:
    """keys, start, end of the union; spans at most slack apart become one."""
    w = W.partitionBy(*keys).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    numbered = spans.withColumn("_new", F.when(top.isNull() | (F.col(start) > top + slack), 1).otherwise(0))
    numbered = numbered.withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def union_length(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    out = merged(spans, keys, start, end)
    return out.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("length"), F.count(F.lit(1)).alias("n_parts"))


def coverage(layers: DataFrame, keys: list[str], layer: str, names: list[str], start: str, end: str) -> DataFrame:
    """keys, start, end, layers (those of names, in order): elementary stretches between borders and the layers that cover them.

    One sweep over border events per key answers intersection (size = n), difference and overlap alike, with no pairs of intervals.
    """
    borders = merged(layers, [*keys, layer], start, end)
    events = borders.select(*keys, layer, F.col(start).alias("at"), F.lit(1).alias("d")).union(borders.select(*keys, layer, F.col(end).alias("at"), F.lit(-1).alias("d")))
    w = W.partitionBy(*keys).orderBy("at")
    counts = events.groupBy(*keys, "at").agg(*(F.sum(F.when(F.col(layer) == n, F.col("d")).otherwise(0)).alias(f"_{i}") for i, n in enumerate(names)))
    live = counts.withColumns({f"_{i}": F.sum(f"_{i}").over(w.rowsBetween(W.unboundedPreceding, 0)) for i in range(len(names))}).withColumn("_to", F.lead("at").over(w))
    covering = F.array_compact(F.array(*(F.when(F.col(f"_{i}") > 0, F.lit(n)) for i, n in enumerate(names))))
    return live.filter("_to > at").select(*keys, F.col("at").alias(start), F.col("_to").alias(end), covering.alias("layers"))


def intersect(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    both = a.select(*keys, start, end).withColumn("_l", F.lit("a")).union(b.select(*keys, start, end).withColumn("_l", F.lit("b")))
    return merged(coverage(both, keys, "_l", ["a", "b"], start, end).filter(F.size("layers") == 2), keys, start, end)


def subtract(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The part of a outside b (b open at its ends); parts of no length are left out."""
    both = a.select(*keys, start, end).withColumn("_l", F.lit("a")).union(b.select(*keys, start, end).withColumn("_l", F.lit("b")))
    return merged(coverage(both, keys, "_l", ["a", "b"], start, end).filter((F.size("layers") == 1) & (F.get("layers", F.lit(0)) == "a")), keys, start, end)


#: The finest class of lengths is 2 ** FINEST; shorter spans, and points, are of that class too.
FINEST = -10


def touching(a: DataFrame, b: DataFrame, keys: list[str], a0: str, a1: str, b0: str, b1: str) -> DataFrame:
    """Pairs of rows of a and b of the same keys whose spans [a0, a1] and [b0, b1] share a point, each pair once; spans that have a border
    null or NaN or end before they start meet none. Columns beside keys have different names in a and b.

    A span's class is its length rounded up to a power of two, so it lies in at most two cells of that width. The shorter of two spans is
    looked up in the cells of the longer one's class, by an equi-join, so spans that are far apart never meet and a key with very many
    spans is spread over its cells. Only classes that are there are looked up: some tens at most, whatever the data. Each side is read for the
    classes and for both directions, so what is costly to work out is better written first.
    """
    size = lambda lo, hi: F.greatest(F.ceil(F.log2((F.col(hi) - F.col(lo)).cast("double"))), F.lit(FINEST).cast("long"))
    cell = lambda x: F.floor(x.cast("double") / F.pow(F.lit(2.0), F.col("_class")))
    cells = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi))))

    whole = lambda df, lo, hi: df.filter((F.col(hi) >= F.col(lo)) & ~F.isnan((F.col(hi) - F.col(lo)).cast("double")))

    def met(short: DataFrame, s0: str, s1: str, long_: DataFrame, l0: str, l1: str, equal: bool) -> DataFrame:
        short, long_ = whole(short, s0, s1), whole(long_, l0, l1).withColumn("_class", size(l0, l1))
        classes = long_.agg(F.collect_set("_class")).scalar()
        up = short.withColumn("_own", size(s0, s1)).withColumn("_class", F.explode(classes))
        up = up.filter(F.col("_class") >= F.col("_own") if equal else F.col("_class") > F.col("_own")).drop("_own").withColumn("_cell", cells(s0, s1))
        both = up.join(long_.withColumn("_cell", cells(l0, l1)), [*keys, "_class", "_cell"])
        # Where both begin together they are in one cell only, so no pair comes out twice.
        shared = (F.col(s0) <= F.col(l1)) & (F.col(l0) <= F.col(s1)) & (F.col("_cell") == cell(F.greatest(s0, l0)))
        return both.filter(shared).drop("_class", "_cell")

    return met(a, a0, a1, b, b0, b1, True).unionByName(met(b, b0, b1, a, a0, a1, False))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a0: str, a1: str, b0: str, b1: str, least: float) -> DataFrame:
    """touching, with the length shared, which is at least `least`; below zero: spans at most that far apart."""
    reach = max(-least, 0)
    pairs = touching(a.withColumn("_far", F.col(a1) + reach) if reach else a, b.withColumn("_to", F.col(b1) + reach) if reach else b, keys, a0, "_far" if reach else a1, b0, "_to" if reach else b1)
    return pairs.withColumn("shared", F.least(a1, b1) - F.greatest(a0, b0)).filter(F.col("shared") >= least).drop("_far", "_to")


def overlap_pairs(spans: DataFrame, keys: list[str], id_: str, start: str, end: str, least: float = 0) -> DataFrame:
    """Pairs of a key's spans (id_a < id_b) that share at least `least`, with the length shared."""
    a = spans.select(*keys, *(F.col(c).alias(f"{c}_a") for c in (id_, start, end)))
    b = spans.select(*keys, *(F.col(c).alias(f"{c}_b") for c in (id_, start, end)))
    pairs = overlapping(a, b, keys, f"{start}_a", f"{end}_a", f"{start}_b", f"{end}_b", least)
    return pairs.filter(F.col(f"{id_}_a") < F.col(f"{id_}_b")).select(*keys, f"{id_}_a", f"{id_}_b", "shared")
