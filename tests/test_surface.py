import math

from pyspark.sql import functions as F

from tracklark.operators import chains, motion, surface
from tracklark.operators.spatial import path_segments


def test_strip_between_two_boundaries(spark):
    left = spark.createDataFrame([("k", 0.0, 4.0), ("k", 20.0, 4.0)], "k string, s double, d double")
    right = spark.createDataFrame([("k", 4.0, 0.0), ("k", 30.0, 0.0)], "k string, s double, d double")
    samples = surface.paired_samples(left, right, ["k"], "s", "d", 2.0, 2.0, 6.0)
    strip = surface.strips(samples, ["k"], 2.0).first()
    assert (strip["s0"], strip["s1"], strip["mean_width"], strip["area"]) == (4.0, 18.0, 4.0, 56.0)
    ring = surface.rings(samples, ["k"]).first()["ring"]
    assert (ring[0]["s"], ring[0]["d"]) == (4.0, 4.0) and (ring[-1]["s"], ring[-1]["d"]) == (4.0, 0.0)


def test_pairs_and_neighbours(spark):
    runs = spark.createDataFrame([("k", 0, 0.0, 50.0, 5.0), ("k", 1, 0.0, 50.0, 1.0), ("k", 2, 48.0, 90.0, 3.0), ("k", 3, 0.0, 50.0, -3.0)], "k string, run long, s0 double, s1 double, mean_d double")
    got = {(r["run"], r["right_run"]) for r in surface.right_neighbours(runs, ["k"], 5.0).collect()}
    assert got == {(0, 1), (1, 3)}
    pairs = {(r["left_run"], r["right_run"]) for r in surface.pair_runs(runs.filter("run = 0"), runs.filter("run != 0"), ["k"], 5.0).collect()}
    assert pairs == {(0, 1), (0, 3)}


def test_ribbon_corners(spark):
    path = spark.createDataFrame([("p", 0, 0.0, 0.0), ("p", 1, 0.0, 10.0)], "k string, i int, e double, n double")
    r = surface.ribbon(path_segments(path, ["k"], "i", "e", "n"), ["k"], 2.0).first()
    assert (r["left_a"]["e"], r["right_b"]["e"], r["right_b"]["n"]) == (-2.0, 2.0, 10.0)


def test_passes_and_sections(spark):
    there = [(0, float(i), 10.0 * i, 0.0) for i in range(10)]
    back = [(0, 10.0 + i, 90.0 - 10.0 * i, 1.0) for i in range(10)]
    rows = spark.createDataFrame([(k, i, t, e, n) for i, (k, t, e, n) in enumerate(there + back)], "k int, i int, t double, e double, n double")
    got = [r["pass_id"] for r in motion.passes(rows, ["k"], "t", "i", "e", "n", 5.0, 60.0).orderBy("i").collect()]
    assert got[:10] == [0] * 10 and got[-1] >= 1
    jump = rows.withColumn("e", F.when(F.col("i") >= 5, F.col("e") + 500).otherwise(F.col("e")))
    found = motion.pose_sections(jump.filter("i < 10"), ["k"], "t", "i", "e", "n", 3.0, 100.0, 5.0).orderBy("i").collect()
    assert [r["section"] for r in found] == [0] * 5 + [1] * 5 and found[5]["reason"] == "speed"


def test_bridge_meets_its_ends(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 10.0, 10.0, 90.0)], "ae double, an double, heading_a double, be double, bn double, heading_b double")
    got = chains.hermite_bridge(rows, 4).orderBy("i").collect()
    assert (got[0]["east"], got[0]["north"]) == (0.0, 0.0) and math.isclose(got[4]["east"], 10.0) and math.isclose(got[4]["north"], 10.0)


def test_best_chain_skips_the_odd_one(spark):
    rows = spark.createDataFrame([("k", i, float(i), float(v), 1.0) for i, v in enumerate([0, 1, 50, 2, 3])], "k string, i int, s double, v double, w double")
    assert {r["i"] for r in chains.best_chain(rows, ["k"], "s", "i", "v", "w", 10.0, 5.0).collect()} == {0, 1, 3, 4}


def test_frozen_prefix(spark):
    a = spark.createDataFrame([("k", 0, 1.0), ("k", 1, 2.0)], "k string, i int, x double")
    b = spark.createDataFrame([("k", 0, 1.0), ("k", 1, 2.5), ("k", 2, 3.0)], "k string, i int, x double")
    assert [tuple(r) for r in chains.frozen_prefix(a, b, ["k"], "i", ["x"]).collect()] == [("k", 1)]
    assert chains.frozen_prefix(a, a.union(b.filter("i = 2")), ["k"], "i", ["x"]).count() == 0
