"""Bins of many rows are fused from counts of their values, with what fused_bins and cluster_bins give row by row."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklark.operators import fusion, pass_fusion
from tracklark.operators.carried import by_key

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(11)
    values = [0.0, -0.0, 0.2, 0.4, 0.4, 1.0, 4.0, 4.2, 9.0, None, NAN, INF, -INF]
    rows = [(rng.choice(["a", "b", None]), 2.0 * rng.randrange(14) + rng.choice([0.0, 0.1, 0.3, 0.5]), rng.choice(values[: rng.choice([4, 8, 9, 13])]), rng.choice([1.0, 2.0, 0.5, 4.0, None]), rng.choice([None, 1, 2, 3]), i) for i in range(900)]
    rows += [("c", 4.0 * i, NAN, 1.0, 1, 1000 + 2 * i + j) for i in range(3) for j in range(2)] + [("c", None, 1.0, 1.0, 1, 2000), ("c", 41.0, 2.0, None, None, 2001)]
    return spark.createDataFrame(rows, "k string, s double, d double, w double, f long, id long").repartition(5).cache()


def same(got, want):
    of = lambda df: sorted(re.sub(r"-0\.0\b", "0.0", repr(r)) for r in df.collect())  # noqa: E731  a count of -0.0 and 0.0 is one of 0.0
    assert of(got) == of(want) and got.dtypes == want.dtypes


@pytest.mark.parametrize("how", [{}, {"relax": False}, {"chosen": True}, {"spread_floor": 0.05}])
def test_bins_from_counts(odd, how):
    want = fusion.fused_bins(odd, ["k"], "s", "d", "w", "f", **how)
    got = fusion.counted_bins(odd, ["k"], "s", "d", "w", "f", **how)
    same(got.select(want.columns), want)
    placed = odd.filter("k is not null and s is not null").withColumn("bin", F.floor(F.col("s") / 2 + 0.5))
    middles = placed.groupBy("k", "bin").agg(F.percentile("d", 0.5).alias("median"), F.percentile("s", 0.5).alias("centre"))
    same(got.select("k", "bin", "median", "centre"), middles)


def test_clusters_from_counts(odd):
    of = ["k"], "s", "d", "w", "f", "id"
    want, got = fusion.cluster_bins(odd, *of), fusion.cluster_bins(odd, *of, counted=True)
    same(got, want)
    assert got.filter("size(clusters) > 1").count() > 5 and got.filter("clusters is null").count() > 0
    same(fusion.cluster_bins(odd.limit(0), *of, counted=True), want.limit(0))


def shuffled(spark) -> dict[int, int]:
    """Rows that each stage so far has written for a shuffle."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_a_pass_shuffles_counts(spark):
    """Until round 3 all observations were shuffled, three times for the lines, and sorted six times in tasks that grew with the input."""
    n = 60000
    rows = spark.range(n).selectExpr("'a' AS k", "id % 40 / 2 AS s", "id % 7 AS frame", "1.0D AS weight", "id AS tie", "id % 2 AS track", "IF(id % 2 = 0, 'left', 'right') AS side", "IF(id % 2 = 0, 5.0D, -5.0D) + id % 3 / 10 AS d")
    before = set(shuffled(spark))
    out = pass_fusion.fuse_pass(rows, rows, spark.createDataFrame([("a", 20.0)], "k string, total double"), ["k"], "track", "weight", "frame", "tie")
    assert sum(r for i, r in shuffled(spark).items() if i not in before) < n / 4
    assert [(r["left"], r["right"], r["paired"], r["surface"]) for r in out.coverage.collect()] == [(19.0, 19.0, 19.0, 16.0)]


def test_light_folds_need_few_tasks(spark):
    """Until round 3 the folds over bins started a Python task for each shuffle partition, three times for a pass, however few the bins."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    bins = spark.range(600).selectExpr("id % 60 AS k", "2.0D * floor(id / 60) AS s", "0.0D AS d")
    try:
        spark.conf.set(name, "64")
        got = fusion.fragments(bins, ["k"], light=True).collect()
        few, many = (by_key(bins, ["k"], ["s"], ["s"], lambda s: [[len(s)] * len(s)], T.StructType([T.StructField("n", T.LongType())]), light).withColumn("_p", F.spark_partition_id()).collect() for light in (True, False))
    finally:
        spark.conf.set(name, before)
    assert len(got) == 600 and {r["fragment"] for r in got} == {0}
    assert all(r["n"] == 10 for r in few + many) and len({r["_p"] for r in few}) <= 4 < len({r["_p"] for r in many})
