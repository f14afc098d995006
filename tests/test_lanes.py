import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklark.operators import lanes
from tracklark.plans import lane_queries

RNG = np.random.default_rng(11)


def test_headings_wrap_at_north(spark):
    df = spark.createDataFrame([("a", 1, 357.0), ("a", 2, 4.0), ("b", 1, 350.0), ("b", 2, 5.0), ("c", 1, 0.0), ("c", 1, 90.0), ("d", 1, None), ("e", 1, 7.0), ("f", 1, -3.0), ("f", 2, 362.0)], "k string, unit long, h double")
    got = {r["k"]: (r["arc"], r["conflict"]) for r in lanes.heading_conflicts(df, ["k"], "unit", "h").collect()}
    assert got == {"a": (7.0, False), "b": (15.0, True), "c": (90.0, False), "e": (0.0, False), "f": (5.0, False)}


def test_conflicts_equal_all_pairs(spark):
    rows = [(k, int(u), float(h)) for k in range(40) for u, h in zip(RNG.integers(0, 4, 2 + k % 5), (RNG.integers(0, 360) + RNG.integers(0, 16, 2 + k % 5)) % 360, strict=True)]
    got = {r["k"]: r["conflict"] for r in lanes.heading_conflicts(spark.createDataFrame(rows, "k long, unit long, h double"), ["k"], "unit", "h").collect()}
    for k in range(40):
        own = [(u, h) for a, u, h in rows if a == k]
        apart = any(min(abs(a - b), 360 - abs(a - b)) > 10 for _, a in own for _, b in own)
        assert got[k] == (apart and len({u for u, _ in own}) >= 2)


def test_partners_with_nulls(spark):
    df = spark.createDataFrame([(1, "x", 1, 1), (2, "x", 2, 1), (3, "x", 2, 2), (4, None, 3, 3), (5, "x", None, 3), (6, "y", 1, 1)], "i long, same string, parent long, pass long")
    got = {r["i"]: r["n_partners"] for r in lanes.partners(df, ["same"], ["parent", "pass"]).collect()}
    assert got[4] == got[5] == got[6] == 0
    assert (got[1], got[2], got[3]) == (1, 0, 1)


def test_stations_of_curves(spark):
    rows = [("a", c, float(s), c + s / 100) for c in range(3) for s in (0, 7, 30, 40)] + [("b", 0, 0.0, 1.0), ("b", 1, 0.0, 1.0), ("b", 1, 5.0, 2.0)]
    got = {(r["k"], r["station"]): (r["n"], r["d"], r["reason"]) for r in lanes.stations(spark.createDataFrame(rows, "k string, c long, s double, d double"), ["k"], "c", "s", "d", 10.0, 2).collect()}
    assert got[("a", 5.0)] == (3, pytest.approx(1.05), None)
    assert got[("b", 5.0)] == (1, None, "support")
    assert sorted(s for k, s in got if k == "a") == [5.0, 15.0, 25.0, 35.0]
    far = spark.createDataFrame([("a", c, s, d) for c, d in enumerate((0.0, 0.2, 4.0)) for s in (0.0, 10.0)], "k string, c long, s double, d double")
    assert [r["reason"] for r in lanes.stations(far, ["k"], "c", "s", "d", 10.0, 2).collect()] == ["bimodal"]


def test_no_rows_give_no_rows(spark):
    small = "/root/testdata/sf0.001"
    p = lane_queries.points(spark, small).filter("event_id < 0")
    assert lanes.stations(p, ["user_id"], "day", "h", "cents", 24, 3).count() == 0
    assert lanes.partners(p, ["user_id"], ["day"]).count() == 0
    assert lanes.pass_summaries(p, ["user_id"], ["t"], "h", "x", "y", "cents").count() == 0
    runs = p.select("user_id", F.col("h").alias("s0"), F.col("h").alias("s1"), F.col("cents").alias("width"))
    assert lanes.count_status(runs, runs, runs, ["user_id"], 10).count() == 0
