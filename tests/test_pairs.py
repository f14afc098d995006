import math

from tracklark.operators import lanes, pairing, pass_fusion

PAIRS = "k string, left long, right long, left_d double, right_d double, s0 double, s1 double, same_section boolean, same_chunk boolean"


def outcomes(spark, rows, pairs, gaps=()):
    samples = spark.createDataFrame([(k, run, float(2 * i), float(d)) for k, run, ds in rows for i, d in enumerate(ds) if d is not None], "k string, run long, s double, d double")
    table = spark.createDataFrame([(k, a, b, float(x), float(y), 0.0, float(e), sec, chunk) for k, a, b, x, y, e, sec, chunk in pairs], PAIRS)
    holes = spark.createDataFrame([(k, r, float(a), float(b)) for k, r, a, b in gaps], "k string, run long, s0 double, s1 double")
    return {r["k"]: r for r in pairing.pair_outcomes(table, samples, holes, ["k"], "run", "s", "d").collect()}


def test_each_objection(spark):
    flat = [3.5] * 6
    rows, pairs = [], []
    cases = {
        "accepted": (flat, [0] * 6), "section": (flat, [0] * 6), "chunk": (flat, [0] * 6), "unknown": (flat, [0] * 6), "order": ([0] * 6, flat), "short": (flat, [0] * 6), "gap": (flat, [0] * 6), "touch": (flat, [0] * 6),
        "apart": ([3.5, None, 3.5, None], [None, 0, None, 0]), "hidden": (flat, [0] * 6), "partial": ([3.5] * 10, [0] * 10), "pieces": ([3.5] * 6, [0] * 6), "cross": ([3, 3, 3, 3, 0, -2, -2], [0] * 7),
        "touching": ([3, 3, 3, 3, 0, 3, 3], [0] * 7), "wide": ([5.5, 5.5, 5.502, 5.5], [0] * 4), "edge": ([5.5, 5.5009, 5.5, 5.5], [0] * 4), "narrow": ([1.9, 2.5, 2.5, 2.5], [0] * 4), "range": ([3, 3, 4.3, 3], [0] * 4), "still": ([3, 3, 4, 3], [0] * 4),
    }
    for k, (a, b) in cases.items():
        rows += [(k, 1, a), (k, 2, b)]
        means = [sum(x for x in y if x is not None) / len(y) for y in (a, b)]
        pairs.append((k, 1, 2, *means, 4 if k == "short" else 2 * len(a) - 2, None if k == "unknown" else k != "section", k != "chunk"))
    rows += [("hidden", 3, [1.7] * 6), ("partial", 3, [1.7, None, None, None, None, 1.7]), ("pieces", 3, [None, 1.7, None, 1.7, None, 1.7]), ("accepted", 3, [5.0] * 6), ("accepted", 4, [3.4] * 6)]
    pairs.append(("nothing", 1, 2, 3.5, 0.0, 10.0, True, True))
    got = outcomes(spark, rows, pairs, [("gap", 2, 4, 6), ("touch", 1, 10, 14), ("accepted", 9, 0, 9)])
    assert {k: r["outcome"] for k, r in got.items()} == {
        "accepted": "accepted", "section": "sectionMismatch", "unknown": "sectionMismatch", "chunk": "chunkMismatch", "order": "meanOrder", "short": "shortOverlap", "gap": "trackGap", "touch": "accepted",
        "apart": "notAdjacent", "nothing": "notAdjacent", "hidden": "interveningRun", "partial": "accepted", "pieces": "noLongStretch", "cross": "crossing", "touching": "accepted",
        "wide": "widthOutlier", "edge": "accepted", "narrow": "widthOutlier", "range": "unstableWidth", "still": "accepted",
    }
    p = got["partial"]
    assert (p["adjacency"], p["n"], p["n_adjacent"], p["n_between"], p["low"], p["high"], p["n_widths"], p["notes"], p["status"]) == ("partial", 10, 8, 2, 2.0, 8.0, 4, ["partialSpan"], "plausible")
    assert got["cross"]["notes"] == ["partialSpan", "crossingCandidate"] and got["cross"]["status"] == "crossingOrInvalidOrder"
    assert got["hidden"]["low"] is None and got["order"]["status"] == "crossingOrInvalidOrder" and got["gap"]["status"] == "insufficientSupport"
    assert math.isclose(got["still"]["std_width"], math.sqrt(3 * 0.25**2 + 0.75**2) / 2) and got["still"]["mean_width"] == 3.25


def test_runs_in_between_come_from_frames_that_grow(spark):
    samples = spark.createDataFrame([(k, run, 0, float(run * run % 17)) for k in "ab" for run in range(20)], "k string, run long, s long, d double")
    pairs = spark.createDataFrame([(k, i, j) for k in "ab" for i in range(20) for j in range(20)], "k string, left long, right long")
    found = lanes.between(samples, pairs, ["k"], "run", "s", "d", 2.0)
    assert "unboundedfollowing" not in found._jdf.queryExecution().analyzed().toString().lower()
    d = [run * run % 17 for run in range(20)]
    want = {(k, i, j): int(any(min(d[i], d[j]) + 2 < x < max(d[i], d[j]) - 2 for x in d)) for k in "ab" for i in range(20) for j in range(20)}
    assert {(r["k"], r["left"], r["right"]): r["n_between"] for r in found.collect()} == want


def test_no_pairs(spark):
    assert outcomes(spark, [], []) == {}


def test_ends_of_gaps(spark):
    def reasons(points, side="outer", chosen=False):
        df = spark.createDataFrame([("a", float(s), float(d)) for s, d in points], "k string, s double, d double")
        gaps = lanes.end_headings(df, ["k"], "s", "d").selectExpr("*", f"'{side}' as side", f"{chosen} as chosen")
        obs = spark.createDataFrame([("a", float(s), s % 5) for s in range(100)], "k string, s double, frame long")
        return [(r["s0"], r["s1"], r["h0"], r["h1"], r["reason"]) for r in lanes.bridge_reasons(gaps, obs, ["k"], "s", "frame").orderBy("s0").collect()]

    assert reasons([(0, 0), (2, 0), (16, 0.5), (18, 0.5)]) == [(2.0, 16.0, 0.0, 0.0, None)]
    assert [r[4] for r in reasons([(0, 0), (2, 0), (16, 1.0), (18, 1.0)])] == ["lateralMismatch"]
    assert [r[4] for r in reasons([(0, 0), (2, 0), (16, 1.0), (18, 1.0)], chosen=True)] == [None]
    assert [r[4] for r in reasons([(0, 0), (2, 0), (16, 2.6), (18, 2.6)], chosen=True)] == ["lateralMismatch"]
    assert [r[4] for r in reasons([(0, 0), (2, 0), (16, 0.5), (18, 2.5)])] == ["headingMismatch"]
    # A point alone has no heading, and what is unknown is no objection.
    assert reasons([(0, 0), (14, 0.5), (16, 2.5)]) == [(0.0, 14.0, None, 45.0, None)]
    assert [r[3:] for r in reasons([(0, 0), (2, 0), (16, 0.5)])] == [(None, None)]
    assert [r[4] for r in reasons([(0, 0), (2, 0), (29, 0), (31, 0)])] == [None]
    assert [r[4] for r in reasons([(0, 0), (2, 0), (30.5, 0), (33, 0)])] == ["exceedsMaxGap"]


def road(spark, edges, lines, lengths):
    e = spark.createDataFrame([(k, side, float(s), float(d), 1.0, f) for k, side, s, d in edges for f in (0, 1)], "k string, side string, s double, d double, w double, frame long")
    x = spark.createDataFrame([(k, t, float(s), float(d), 1.0, f, 2 * i + f) for i, (k, t, s, d) in enumerate(lines) for f in (0, 1)], "k string, track long, s double, d double, w double, frame long, tie long")
    total = spark.createDataFrame(lengths, "k string, total double")
    return pass_fusion.fuse_pass(e, x, total, ["k"], "track", "w", "frame", "tie")


def test_road_of_a_pass(spark):
    """Pass a: edges over 80 m; b: edges over 20 m and tracks over 80 m with a gap that the tracks' own steps prove safe; c: edges over 60 m of 700
    without tracks; d: nothing."""
    side = lambda k, to, lo=-4, hi=4: [(k, name, s + 0.5, d) for s in range(0, to, 2) for name, d in (("left", hi), ("right", lo))]
    tracks = [("b", t, s + 0.5, d) for t, d in ((7, 3.0), (9, -3.0)) for s in range(0, 82, 2) if not 40 < s < 48]
    out = road(spark, side("a", 82) + side("b", 22) + side("c", 62), tracks + [("b", 8, 0.5 + s, 0.5) for s in range(0, 8, 2)], [("a", 100.0), ("b", 100.0), ("c", 700.0), ("d", 50.0)])
    cover = {r["k"]: (r["left"], r["right"], r["paired"], r["surface"], r["source"]) for r in out.coverage.collect()}
    assert cover == {"a": (80.0, 80.0, 80.0, 78.0, "edges"), "b": (20.0, 20.0, 20.0, 78.0, "laneTracks"), "c": (60.0, 60.0, 60.0, 58.0, "edges"), "d": (0.0, 0.0, 0.0, 0.0, None)}
    found = {(r["k"], r["surface"]): (r["left"], r["right"], r["s0"], r["s1"], r["n_spans"], r["area"]) for r in out.surfaces.collect()}
    assert found == {("a", 0): (None, None, 2.0, 80.0, 1, 624.0), ("b", 0): (7, 9, 2.0, 80.0, 1, 468.0), ("c", 0): (None, None, 2.0, 60.0, 1, 464.0)}
    assert {r["track"] for r in out.lanes.select("track").distinct().collect()} == {7, 8, 9}
    assert {(r["k"], r["side"]) for r in out.boundaries.select("k", "side").distinct().collect()} == {(k, s) for k in "abc" for s in ("left", "right")}
    percent = {r["k"]: r["percent"] for r in out.coverage.collect()}
    assert percent["a"] == 78.0 and percent["d"] == 0.0


def test_edges_that_cross_or_widen_are_no_road(spark):
    """Widths of 1 and 31 metres and a right edge on the left end a surface; two spans of three places stay."""
    width = [8] * 6 + [1] * 3 + [8] * 6 + [31] * 3 + [-8] * 3
    edges = [("a", name, 2 * i + 0.5, d) for i, w in enumerate(width) for name, d in (("left", w / 2), ("right", -w / 2))]
    out = road(spark, edges, [], [("a", 1000.0)])
    assert out.surfaces.filter("area <= 0 or s1 - s0 < 4").count() == 0 and out.surfaces.filter("s1 > 30").count() == 0 and out.surfaces.count() >= 1


def test_empty_road(spark):
    out = road(spark, [], [], [])
    assert [t.count() for t in (out.boundaries, out.lanes, out.surfaces, out.coverage)] == [0, 0, 0, 0]


def test_bridges_of_surfaces(spark):
    """Steps of 2 m allow bridges of 6 m, steps of 9 m one of 10; another width or a wider gap ends a surface."""
    spans = [("a", 0, 10, 6), ("a", 15, 20, 6), ("a", 26, 30, 7), ("a", 32, 40, 9), ("a", 47, 50, 9), ("b", 0, 10, 6), ("b", 20, 30, 6)]
    df = spark.createDataFrame([(k, float(a), float(b), (b - a) * float(w), w / 2, -w / 2, w / 2, -w / 2) for k, a, b, w in spans], "k string, s0 double, s1 double, area double, left0 double, right0 double, left1 double, right1 double")
    points = spark.createDataFrame([(k, side, float(s)) for k, step in (("a", 2), ("b", 9)) for side in ("left", "right") for s in range(0, 60, step)], "k string, side string, s double")
    got = [(r["k"], r["s0"], r["s1"], r["n_spans"], r["area"]) for r in pass_fusion.bridged_surfaces(df, points, ["k"]).orderBy("k", "s0").collect()]
    assert got == [("a", 0.0, 30.0, 3, 60.0 + 30.0 + 30.0 + 39.0 + 28.0), ("a", 32.0, 40.0, 1, 72.0), ("a", 47.0, 50.0, 1, 27.0), ("b", 0.0, 30.0, 2, 180.0)]
