import math
import random

from tracklark.operators import intervals, joining, joins, spatial, temporal
from tracklark.sinks.publish import current, insert_new, line_features, pointers, publish, quarantine


def test_projection_and_back(spark):
    path = spark.createDataFrame([("p", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)])], "k string, i int, e double, n double")
    seg = spatial.path_segments(path, ["k"], "i", "e", "n")
    points = spark.createDataFrame([("p", 1, 4.0, 2.0), ("p", 2, 9.0, 7.0), ("p", 3, 300.0, 0.0)], "k string, id int, e double, n double")
    got = {r["id"]: (r["s"], r["d"]) for r in spatial.project(points, seg, ["k"], "id", "e", "n", 5.0).collect()}
    assert got == {1: (4.0, 2.0), 2: (17.0, 1.0)}
    back = spatial.at_route(spark.createDataFrame([("p", 4.0, 2.0), ("p", 17.0, 1.0), ("p", 99.0, 5.0)], "k string, s double, d double"), seg, ["k"], "s", "d")
    assert {(round(r["east"], 6), round(r["north"], 6)) for r in back.collect()} == {(4.0, 2.0), (9.0, 7.0), (10.0, 10.0)}


def test_area_inside_and_crossings(spark):
    ring = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)])], "k string, i int, e double, n double")
    assert spatial.area(ring, ["k"], "i", "e", "n").first()["area"] == 12.0
    corners = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
    edges = spark.createDataFrame([("a", *p, *q) for p, q in zip(corners, corners[1:], strict=False)], "k string, ae double, an double, be double, bn double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 1.0)], "id int, e double, n double")
    assert [r["id"] for r in spatial.inside(points, "id", edges, "k").collect()] == [1]
    near = spatial.inside(points, "id", edges, "k", cell=1.0)
    assert [r["id"] for r in near.collect()] == [1] and "CartesianProduct" not in near._jdf.queryExecution().executedPlan().toString()
    loop = spark.createDataFrame([("p", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)])], "k string, i int, e double, n double")
    assert spatial.self_crossings(spatial.path_segments(loop, ["k"], "i", "e", "n"), ["k"], 3.0).first()["n_crossings"] == 1


def test_resample_is_linear(spark):
    rows = spark.createDataFrame([("p", 0.0, 0.0), ("p", 10.0, 5.0)], "k string, s double, d double")
    got = {(r["s"], r["d"]) for r in spatial.resample(rows, ["k"], "s", "d", 2.0).collect()}
    assert got == {(0.0, 0.0), (2.0, 1.0), (4.0, 2.0), (6.0, 3.0), (8.0, 4.0)}


def test_merge_with_slack(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 6, 8), (1, 20, 21), (2, 0, 1)], "k int, a int, b int")
    assert sorted(map(tuple, intervals.merged(rows, ["k"], "a", "b", 1).collect())) == [(1, 0, 8), (1, 20, 21), (2, 0, 1)]


def test_features(spark):
    rows = spark.createDataFrame([("a", 2, 1.0, 2.0), ("a", 1, 3.0, 4.0), ("b", 1, 0.0, 0.0), ("c", 1, math.nan, 0.0)], "k string, i int, lon double, lat double")
    got = line_features(rows, ["k"], "i", "lon", "lat").collect()
    assert [r["k"] for r in got] == ["a"] and '"coordinates":[[3.0,4.0],[1.0,2.0]]' in got[0]["feature"]


def test_publication(spark, tmp_path):
    root = f"file://{tmp_path}/pub"
    publish({"t": spark.range(3)}, root, "r1")
    publish({"t": spark.range(5)}, root, "r2")
    assert current(spark, root, "t").count() == 5
    quarantine(spark, root, "r2")
    assert current(spark, root, "t").count() == 3 and (tmp_path / "pub/quarantine/r2").exists()
    quarantine(spark, root, "r1")
    assert pointers(spark, root) == []


def test_insert_never_updates(spark):
    from pyspark.sql import functions as F

    old = spark.createDataFrame([(1, "x")], "id int, v string")
    kept, out = insert_new(old, spark.createDataFrame([(1, "y"), (2, "z"), (2, "zz"), (2, None), (3, None)], "id int, v string"), ["id"], F.col("v").isNotNull())
    assert sorted(map(tuple, kept.collect())) == [(1, "x"), (2, "z")] and sorted((r["id"], r["code"]) for r in out.collect()) == [(1, "duplicate"), (2, "duplicate"), (2, "invalid"), (3, "invalid")]


def test_spans_meet_those_they_touch(spark):
    """Pairs against all pairs: lengths from points to the whole range, repeated spans, touching ends, borders that are null or infinite."""
    rng = random.Random(3)
    spans = []
    for i in range(160):
        lo = rng.choice([rng.uniform(-40, 40), float(rng.randrange(-40, 40))])
        spans.append((i % 3, i, lo, lo + rng.choice([0.0, 0.3, 1.0, rng.random() * 4, 8.0, 64.0])))
    spans += [(0, 160 + i, *spans[0][2:]) for i in range(2)]
    odd = [(0, 170, None, 3.0), (0, 171, 5.0, 1.0), (0, 172, 2.0, math.inf), (0, 173, float("nan"), 2.0), (None, 174, 0.0, 1.0)]
    df = spark.createDataFrame(spans + odd, "k int, id int, a double, b double")
    sound = [x for x in spans + odd if x[0] is not None and x[2] is not None and x[2] <= x[3]]
    for least in (0, 1, -2):
        want = {(x[0], x[1], y[1]) for x in sound for y in sound if x[0] == y[0] and x[1] < y[1] and min(x[3], y[3]) - max(x[2], y[2]) >= least}
        got = [tuple(r)[:3] for r in intervals.overlap_pairs(df, ["k"], "id", "a", "b", least).collect()]
        assert len(got) == len(set(got)) and set(got) == want, least
    assert intervals.overlap_pairs(df.limit(0), ["k"], "id", "a", "b").count() == 0


def test_first_span_that_holds_a_time(spark):
    spans = [("a", 0.0, 10.0, 1), ("a", 2.0, 3.0, 2), ("a", 0.0, 4.0, 0), ("b", 0.0, 1.0, 7)]
    rows = [("a", t, n) for t in (-1.0, 0.0, 2.5, 2.5, 7.0, 10.0, 10.5) for n in (1, 1)] + [("b", 1.0, 0), ("c", 0.0, 0), (None, 0.0, 0), ("a", None, 0)]
    got = temporal.in_spans(spark.createDataFrame(rows, "k string, t double, n int"), spark.createDataFrame(spans, "k string, a double, b double, id int"), "k", "t", "a", "b", "id")

    def first(k, t):
        hits = [(a, i) for key, a, b, i in spans if key == k and t is not None and a <= t <= b]
        return min(hits)[1] if hits else None

    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, t, n, first(k, t)) for k, t, n in rows), key=repr)


def test_points_near_others_are_not_broadcast(spark):
    rng = random.Random(5)
    points = [(i, rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(80)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    near = joins.within_radius(df, df, "x", "y", 4.0)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["id_b"]) for r in near.collect()} == {(a[0], b[0]) for a in points for b in points if math.dist(a[1:], b[1:]) <= 4}


def test_rows_of_a_place_are_met_as_one(spark):
    """Until round 4 each row was sent to nine cells and compared with each row there."""
    rng = random.Random(8)
    odd = [float("nan"), float("inf"), -float("inf"), None]
    points = [(i, rng.choice([None, "u", "v"]), float(rng.randrange(-9, 9)), float(rng.randrange(-9, 9))) for i in range(150)]
    points += [(i, "w", 3.0, 4.0) for i in range(200, 200 + joins.TOGETHER + 20)] + [(900 + i, "x", v, 0.0) for i, v in enumerate(odd)] + [(910 + i, "x", 0.0, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(points, "id long, s string, x double, y double")
    near = joins.within_radius(df, df, "x", "y", 3.0, 1)
    assert near.columns == ["id", "s", "x", "y", "id_b", "s_b", "x_b", "y_b", "distance"]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Generate posexplode") < plan.find("Join Inner")
    good = [p for p in points if None not in p[2:] and all(map(math.isfinite, p[2:]))]
    want = sorted((repr(a), repr(b), round(math.dist(a[2:], b[2:]), 1)) for a in good for b in good if math.dist(a[2:], b[2:]) <= 3)
    assert sorted((repr(tuple(r)[:4]), repr(tuple(r)[4:8]), r["distance"]) for r in near.collect()) == want
    bare = df.select("x", "y")
    assert joins.within_radius(bare, df, "x", "y", 3.0).count() == len(want)


def test_nearest_pairs_give_what_all_pairs_give(spark):
    rng = random.Random(6)
    value = lambda: rng.choice([None, float("nan"), 1.5, 2.5, 2.5, round(rng.uniform(-9, 9), 1), round(rng.uniform(-9, 9), 1)])
    left = spark.createDataFrame([(rng.choice(["x", "y", None]), i, value()) for i in range(60)], "k string, a long, v double")
    right = spark.createDataFrame([(rng.choice(["x", "y", "z"]), i, value()) for i in range(60)], "k string, b long, v double")
    every = left.join(right.withColumnRenamed("v", "w"), "k").selectExpr("k", "a", "b", "1 - abs(v - w) / 20 as score").filter("not isnan(score)")
    found = joins.nearest_pairs(left, right, ["k"], "a", "b", "v")
    n = left.join(right, "k").count()
    assert found.count() <= 4 * 120 < n
    few = found.selectExpr("k", "a", "b", "1 - abs(a_value - b_value) / 20 as score")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(joins.mutual_best(few, ["k"], "a", "b", "score")) == plain(joins.mutual_best(every, ["k"], "a", "b", "score"))
    for least in (0.01, 0.0):
        chosen = [joining.selected(x, ["k"], "a", "b", margin=least).select("k", "a", "b", "score", "second_score", "margin") for x in (few, every)]
        assert plain(chosen[0]) == plain(chosen[1]) != []
