"""Joining, projection, fusion, canonical text and playback against small fixtures and plain versions."""

import hashlib
import json
import math
import random
from statistics import NormalDist, median

import numpy as np
from pyspark.sql import functions as F

from tracklark.functions import canonical
from tracklark.operators import fusion, graph, joining, observations, playback


def line(fragment, start, heading, t, n=6, track=1, at=None):
    rad = math.radians(heading)
    e0, n0 = at or (0.0, start)
    return [(1, track, fragment, i, float(start + 2 * i), e0 + 2 * i * math.sin(rad), n0 + 2 * i * math.cos(rad), t + 0.1 * i) for i in range(n)]


POINTS = "road long, track long, fragment long, i long, s double, east double, north double, t double"


def joined(spark, rows, evidence):
    points = spark.createDataFrame(rows, POINTS)
    seen = spark.createDataFrame(evidence, "road long, track long, s double, support long")
    paths, judged = joining.join_fragments(points, seen, ["road"], ["track"])
    return {r["fragment"]: r["path"] for r in paths.collect()}, {(r["a_fragment"], r["b_fragment"]): r for r in judged.collect()}


def test_fragments_join_into_paths_and_singletons_stay(spark):
    rows = line(1, 0, 0, 0.0) + line(2, 16, 0, 2.0) + line(3, 32, 0, 4.0) + line(4, 200, 0, 9.0)
    paths, judged = joined(spark, rows, [])
    assert paths == {1: 1, 2: 1, 3: 1, 4: 4}
    r = judged[1, 2]
    assert r["reason"] is None and r["gap"] == 6 and r["margin"] is not None and r["corridor"] == "occludedOrMissing"
    # gap 6 of 40, no turn, no offset, 1.5 s of 30, little evidence
    assert abs(r["score"] - (0.25 * 0.85 + 0.25 + 0.2 + 0.1 + 0.05 * 0.95 + 0.1 * 0.4 + 0.05)) < 2e-4


def test_gates(spark):
    rows = line(1, 0, 0, 0.0) + line(2, 16, 40, 2.0, at=(0.0, 16.0)) + line(3, 18, 0, 2.0, at=(8.0, 18.0)) + line(4, 20, 0, 99.0) + line(5, 36, 0, 1.0, at=(0.0, 36.0))
    _, judged = joined(spark, rows, [])
    assert judged[1, 2]["reason"] == "tangentIncompatible"
    assert judged[1, 3]["reason"] == "lateralMisalignment"
    assert judged[1, 4]["reason"] == "temporalGap"
    assert judged[1, 5]["reason"] == "unsupportedGap"
    _, judged = joined(spark, rows, [(1, 1, 20.0, 1), (1, 1, 25.0, 1)])
    assert judged[1, 5]["reason"] == "largeGapInsufficientEvidence" and judged[1, 5]["corridor"] == "weaklySupported"
    _, judged = joined(spark, rows, [(1, 1, 20.0, 2), (1, 1, 25.0, 3), (1, 2, 26.0, 3)])
    assert judged[1, 5]["reason"] is None and judged[1, 5]["supported"] == 2


def test_a_connector_must_not_cross_another_boundary(spark):
    across = [(1, 2, 9, i, float(i), -3.0 + 2 * i, 13.0, 0.0) for i in range(4)]
    rows = line(1, 0, 0, 0.0) + line(2, 16, 0, 2.0)
    assert joined(spark, rows + across, [])[1][1, 2]["reason"] == "crossesOtherBoundary"
    assert joined(spark, rows, [])[1][1, 2]["crosses"] is False


def test_close_rivals_stay_unjoined(spark):
    rows = line(1, 0, 0, 0.0) + line(2, 16, 0, 2.0) + line(3, 16, 0, 2.0, at=(0.3, 16.0))
    paths, judged = joined(spark, rows, [])
    assert judged[1, 2]["reason"] is None and judged[1, 3]["reason"] is None and paths == {1: 1, 2: 2, 3: 3}


def test_connector_begins_and_ends_at_the_fragments(spark):
    rows = line(1, 0, 0, 0.0) + line(2, 16, 0, 2.0, at=(1.0, 16.0))
    e = joining.ends(spark.createDataFrame(rows, POINTS), ["road", "track"])
    c = joining.connectors(joining.candidates(e, ["road", "track"]), ["road", "track"]).orderBy("i").collect()
    assert len(c) == 7 and (c[0]["east"], c[0]["north"], c[0]["s"]) == (0.0, 10.0, 10.0)
    assert abs(c[-1]["east"] - 1) < 1e-9 and abs(c[-1]["north"] - 16) < 1e-9 and abs(c[3]["east"] - 0.5) < 1e-9


def test_seed_groups_compare_with_the_seed_only(spark):
    stats = spark.createDataFrame([(1, 1, 3.0, 0.0, 50.0), (1, 2, 3.7, 10.0, 60.0), (1, 3, 4.6, 20.0, 70.0), (1, 4, -3.0, 0.0, 50.0), (1, 5, 4.2, 300.0, 400.0)], "k long, id long, mean_d double, s0 double, s1 double")
    got = {r["id"]: r["seed"] for r in graph.seed_groups(stats, ["k"], "id").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}


def test_components_of_an_empty_table(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def path(spark, points):
    rows, s = [], 0.0
    for i, ((ta, ae, an), (tb, be, bn)) in enumerate(zip(points, points[1:], strict=False)):
        length = math.hypot(be - ae, bn - an)
        rows.append((1, i, ae, an, be, bn, s, s + length, ta, tb))
        s += length
    return rows, spark.createDataFrame(rows, "k long, segment long, ae double, an double, be double, bn double, s0 double, s1 double, ta double, tb double")


def plain_projection(segments, points, t, e, n):
    vertices = [p[0] for p in points]
    at = min(range(len(vertices)), key=lambda i: (abs(vertices[i] - t), i))
    best, torn = None, False
    for _, i, ae, an, be, bn, s0, s1, ta, tb in segments[max(0, at - 4) : at + 4]:
        if abs(t - (ta + tb) / 2) > 4:
            continue
        size = math.hypot(be - ae, bn - an)
        f = min(1, max(0, ((e - ae) * (be - ae) + (n - an) * (bn - an)) / size**2))
        off, s = math.hypot(e - ae - f * (be - ae), n - an - f * (bn - an)), s0 + f * (s1 - s0)
        if best is None or off < best[1]:
            torn |= best is not None and best[1] - off < 1 and abs(s - best[0]) > 10
            best = (s, off, i)
    return best, torn


def test_projection_in_time(spark):
    rng = random.Random(3)
    points = [(0.8 * i, 12 * math.sin(i / 2), 12 * math.cos(i / 2.3)) for i in range(30)]
    segments, table = path(spark, points)
    queries = [(1, i, rng.uniform(-9, 33), rng.uniform(-15, 15), rng.uniform(-15, 15)) for i in range(300)]
    out = observations.project_temporal(spark.createDataFrame(queries, "k long, id long, t double, e double, n double"), table, "k", "id", "t", "e", "n")
    got = {r["id"]: r for r in out.collect()}
    seen = set()
    for _, i, t, e, n in queries:
        best, torn = plain_projection(segments, points, t, e, n)
        r = got[i]
        assert r["valid"] == (best is not None)
        if best:
            assert abs(r["s"] - best[0]) < 1e-9 and abs(r["off"] - best[1]) < 1e-9 and r["segment"] == best[2] and r["ambiguous"] == torn
        seen.add((best is not None, torn))
    assert seen == {(True, True), (True, False), (False, False)}
    rows = observations.gated(out.withColumn("own", F.lit(0.0)), "own").groupBy("reason").count().collect()
    assert {"outsideTemporalWindow", "projectionAmbiguous", None} <= {r["reason"] for r in rows}


def test_lines(spark):
    nan = float("nan")
    rows = [
        (1, [0.0, 10.0, 20.0], [1.0, 2.0, 3.0], 0.9, 0.3),
        (2, [0.0, 10.0], [1.0], 0.9, 0.3),
        (3, [], [], 0.9, 0.3),
        (4, [nan, nan], [1.0, nan], 0.9, 0.3),
        (5, [4.0, 6.0, 12.0, 40.0], [-1.0, -0.5, 0.5, 2.0], 0.9, 0.3),
        (6, [-5.0, -5.01, 120.0, 120.01], [-1.0, -1.0, -2.0, -2.0], 0.5, 0.3),
        (7, [0.0, 20.0], [-3.0, -3.0], None, 0.3),
        (8, [0.0, 130.0], [0.0, 0.0], 0.9, 9.0),
        (9, [0.0, 20.0], [3.0, 3.0], 0.9, 2.0),
        (10, None, None, 0.9, 0.3),
    ]
    lines = spark.createDataFrame(rows, "line long, x array<double>, y array<double>, prob double, std double")
    got = {r["line"]: r for r in observations.assessed(lines).collect()}
    assert [got[i]["reason"] for i in range(1, 11)] == [None, "malformed", "malformed", "malformed", "crossing", None, "confidenceBelowThreshold", "noSide", "uncertaintyExcessive", "malformed"]
    assert (got[1]["lateral"], got[1]["side"], got[6]["side"]) == (2.0, "left", "right")
    ego = {r["side"]: (r["line"], r["reason"]) for r in observations.ego_candidates(observations.assessed(lines), [], "line").collect()}
    assert ego == {"left": (1, None), "right": (6, None)}
    points = observations.line_points(lines, ["line"]).collect()
    outcome = lambda i: [r["outcome"] for r in sorted((r for r in points if r["line"] == i), key=lambda r: r["i"])]
    assert outcome(1) == ["kept"] * 3 and outcome(2) == [] and outcome(4) == ["nonFinite"] * 2
    assert outcome(6) == ["kept", "outsideWindow", "kept", "outsideWindow"] and outcome(7) == ["lowConfidence"] * 2 and outcome(8) == ["tooFewPoints", "outsideWindow"]
    pose = observations.placed(spark.createDataFrame([(10.0, 2.0, 100.0, 50.0, 90.0)], "model_x double, model_y double, e double, n double, h double"), "e", "n", "h").first()
    assert [round(pose[c], 9) for c in ("point_east", "point_north", "mirrored_east", "mirrored_north")] == [110.0, 52.0, 110.0, 48.0]


def test_position_reasons_in_order(spark):
    rows = [(float("nan"), 1.0, 1, 5.0, 1), (91.0, 1.0, 1, 5.0, 1), (1.0, 181.0, 1, 5.0, 1), (0.0, 0.0, 1, 5.0, 1), (1.3, 103.9, 0, 5.0, 1), (1.3, 103.9, 1, 51.0, 1), (1.3, 103.9, 1, 5.0, None), (1.3, 103.9, 1, 5.0, 1), (91.0, 181.0, 0, 99.0, None), (1.3, 103.9, 1, float("nan"), 1), (1.3, 103.9, 1, float("inf"), 1), (1.3, 103.9, 1, -3.0, 1), (1.3, 103.9, 1, None, 1), (1.3, 103.9, 1, 5.0, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, lat double, lon double, flags long, acc double, t long")
    got = [r["r"] for r in df.select("i", observations.position_reason("lat", "lon", "flags", "acc", "t").alias("r")).orderBy("i").collect()]
    assert got == ["invalidNumber", "latOutOfRange", "lonOutOfRange", "nearZero", "noFix", "accuracyTooHigh", "missingTimestamp", None, "latOutOfRange", None, None, None, None, "missingTimestamp"]


def test_jumps_count_from_the_last_accepted_row(spark):
    rows = [("a", 0, 0.0, None), ("a", 1, 500.0, None), ("a", 2, 150.0, None), ("a", 3, 340.0, "noFix"), ("a", 4, 340.0, None), ("b", 0, 900.0, None)]
    df = spark.createDataFrame([(k, i, e, 0.0, r) for k, i, e, r in rows], "k string, i long, e double, n double, reason string")
    got = {(r["k"], r["i"]): r["reason"] for r in observations.with_jumps(df, ["k"], ["i"], "e", "n").collect()}
    assert got == {("a", 0): None, ("a", 1): "positionJump", ("a", 2): None, ("a", 3): "noFix", ("a", 4): None, ("b", 0): None}


def lower_weighted(pairs):
    total, run = sum(w for _, w in pairs), 0
    for v, w in sorted(pairs):
        run += w
        if 2 * run >= total:
            return v


def fuse(rows, chosen=False):
    """(s, d) of a bin's rows (s, d, weight, frame), or None."""
    need = 1 if chosen else 2
    if not chosen and (len(rows) < 2 or len({r[3] for r in rows}) < 2):
        return None
    middle = median(r[1] for r in rows)
    spread = median(abs(r[1] - middle) for r in rows)
    inl = [r for r in rows if abs(r[1] - middle) <= 3 * max(spread, 0.3)]
    again = median(r[1] for r in inl)
    frames = 1 if (chosen or len(inl) < len(rows)) and median(abs(r[1] - again) for r in inl) <= 0.5 else 2
    if len(inl) < need or len({r[3] for r in inl}) < frames:
        return None
    return lower_weighted([(r[0], r[2]) for r in inl]), lower_weighted([(r[1], r[2]) for r in inl])


def test_bins_choose_the_cluster_of_their_neighbours(spark):
    rng = random.Random(9)
    rows = []
    for b in range(40):
        for _ in range(rng.randrange(1, 7)):
            shift = rng.choice([0, 0, 0, 8, -8]) if b % 3 == 0 else 0
            rows.append((1, len(rows), 2 * b + rng.uniform(-0.9, 0.9), 0.1 * b + shift + rng.uniform(-0.4, 0.4), float(rng.randrange(1, 5)), rng.randrange(4)))
    df = spark.createDataFrame(rows, "k long, id long, s double, d double, w double, f long")
    got = {r["bin"]: (r["s"], r["d"], r["chosen"]) for r in fusion.chosen_bins(fusion.cluster_bins(df, ["k"], "s", "d", "w", "f", "id"), ["k"]).collect()}
    bins = {}
    for _, _, s, d, w, f in rows:
        bins.setdefault(math.floor(s / 2 + 0.5), []).append((s, d, w, f))
    whole, want, last = {b: fuse(r) for b, r in bins.items()}, {}, None
    for b in sorted(bins):
        before = last or next((whole[x] for x in sorted(bins, reverse=True) if x < b and whole[x]), None)
        after = next((whole[x] for x in sorted(bins) if x > b and whole[x]), None)
        clusters = []
        for r in sorted(bins[b], key=lambda r: r[1]):
            if clusters and r[1] - clusters[-1][-1][1] <= 2.5:
                clusters[-1].append(r)
            else:
                clusters.append([r])
        pick = None
        if len(bins[b]) >= 2 and len(clusters) > 1 and (before or after):
            centre = median(r[0] for r in bins[b])
            expected = before[1] + (centre - before[0]) / (after[0] - before[0]) * (after[1] - before[1]) if before and after else (before or after)[1]
            off, best = min(((abs(median(r[1] for r in c) - expected), c) for c in clusters), key=lambda x: x[0])
            pick = best if off <= 4 else None
        out = fuse(pick, True) if pick else whole[b]
        if out:
            want[b], last = (*out, pick is not None), out
    assert set(got) == set(want) and any(c for _, _, c in got.values())
    assert all(np.allclose(got[b][:2], want[b][:2]) and got[b][2] == want[b][2] for b in want)


def test_outer_pairs_and_fallback(spark):
    tracks = spark.createDataFrame([(1, 1, 4.0, 0.0, 100.0), (1, 2, 0.0, 0.0, 100.0), (1, 3, -4.0, 10.0, 60.0), (1, 4, 1.0, 0.0, 90.0)], "k long, track long, mean_d double, s0 double, s1 double")
    got = {(r["left"], r["right"]) for r in fusion.outer_pairs(tracks, ["k"], "track").collect()}
    assert got == {(1, 2), (2, 3)}  # the others share a side with these where they overlap
    a = spark.createDataFrame([(1, 0.0, 60.0), (2, 0.0, 20.0), (3, 0.0, 60.0)], "k long, s0 double, s1 double")
    b = spark.createDataFrame([(1, 0.0, 99.0), (2, 0.0, 99.0)], "k long, s0 double, s1 double")
    total = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 9000.0)], "k long, total double")
    assert {(r["k"], r["source"]) for r in fusion.with_fallback(a, b, total, ["k"]).collect()} == {(1, "edges"), (2, "laneTracks"), (3, "edges")}


def test_canonical_text():
    value = {"b": [1.0, -0.0, 1e21, 1e-7, 0.000001, 123.456, True, None], "a": "é<~", "t": {"x": 1, "at": 2}}
    assert canonical.canonical_text(value) == '{"a":"\\u00e9<~","b":[1,0,1e+21,1e-7,0.000001,123.456,true,null],"t":{"at":2,"x":1}}'
    assert json.loads(canonical.canonical_text(value)) == json.loads(json.dumps(value))
    assert canonical.without({"at": 1, "t": {"at": 2, "x": 3}, "l": [{"at": 4}]}, ["at", "t.at"]) == {"t": {"x": 3}, "l": [{"at": 4}]}
    assert canonical.content_digest({"x": 1, "at": 5}, ["at"]) == hashlib.sha256(b'{"x":1}').hexdigest()
    assert canonical.cache_key("v1", {"a": 1}, ["z", "b"]) == f"v1::{hashlib.sha256(b'{\"a\":1}').hexdigest()[:16]}::b,z"
    assert canonical.pretty_text({"b": 1, "a": [2]}) == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n'


def test_numeric_functions(spark):
    ps = [0.0001, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.999]
    rows = [(p, [[2.0, 1.0], [1.0, 2.0]], [1.0, 3.0], "7:2:123:1") for p in ps] + [(0.0, None, None, "7:2")]
    got = spark.createDataFrame(rows, "p double, m array<array<double>>, v array<double>, id string").select("p", canonical.normal_quantile(F.col("p")).alias("q"), canonical.quadratic_form("m", "v").alias("f"), canonical.eigenvalues("m").alias("e"), canonical.endpoint("id").alias("x")).collect()
    for r in got[:-1]:
        assert abs(r["q"] - NormalDist().inv_cdf(r["p"])) < 1e-6 and r["f"] == 26 and np.allclose(r["e"], [1, 3]) and tuple(r["x"]) == (7, 2, 123, 1)
    assert got[-1]["q"] is None and got[-1]["e"] is None and got[-1]["x"] is None


def test_playback(spark):
    rows = spark.createDataFrame([(10, 0, 100, "a"), (10, 0, 100, "b"), (11, 1, 200, "c"), (12, 2, 300, "d")], "frame long, idx long, t long, what string")
    queries = spark.createDataFrame([(1, 11, 0, 0), (2, 99, 2, 0), (3, 99, 99, 250), (4, 99, 99, 50)], "q long, frame long, idx long, t long")
    named = queries.select("q", F.col("frame").alias("qf"), F.col("idx").alias("qi"), F.col("t").alias("qt"))
    got = playback.current_rows(rows, named.withColumnsRenamed({"qf": "frame", "qi": "idx", "qt": "t"}), "q", "frame", "idx", "t")
    assert sorted((r["q"], r["what"]) for r in got.collect()) == [(1, "c"), (2, "d"), (3, "c")]
    assert playback.causal(rows, "idx", 1).count() == 3
    decide = spark.createDataFrame([(True, "x", True), (True, "x", False), (True, None, None), (False, "x", True)], "a boolean, b string, c boolean")
    assert [r[0] for r in decide.select(playback.append_decision(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["commit", "commitWithoutLookahead", "commit", "rollback"]
    fresh = rows.withColumn("what", F.upper("what"))
    out = playback.appended(rows.filter("frame < 12"), fresh, "frame", rows.select("frame"))
    assert sorted(r["what"] for r in out.collect()) == ["D", "a", "b", "c"]


def test_polygon_checks(spark):
    from tracklark.operators import runs

    def strip(k, width, step=5.0, n=6, twist=False):
        rows = [(k, i, 0.0, step * i, width, step * i) for i in range(n)]
        if twist:
            rows[3] = (k, 3, width + 1.0, step * 3, -1.0, step * 3)
        return rows

    rows = strip(1, 6.0) + strip(2, 1.0) + strip(3, 40.0) + strip(4, 6.0, step=20.0) + strip(5, 6.0, twist=True) + strip(6, 70.0) + strip(7, 6.0, n=1)
    df = spark.createDataFrame(rows, "k long, i long, le double, ln double, re double, rn double")
    got = {r["k"]: r for r in runs.polygon_checks(df, ["k"]).collect()}
    assert got[1]["reasons"] == [] and (got[1]["area"], got[1]["length"], got[1]["median_width"], got[1]["max_jump"]) == (150.0, 25.0, 6.0, 6.0)
    assert got[2]["reasons"] == ["widthBelowMin"] and got[4]["reasons"] == ["vertexJumpTooLarge"] and got[7]["reasons"] == ["tooFewPoints"]
    assert got[3]["reasons"] == ["widthAboveMax", "vertexJumpTooLarge"] and "selfIntersecting" in got[5]["reasons"]
    assert got[6]["reasons"] == ["widthAboveMax", "vertexJumpTooLarge", "areaImplausible", "boundaryMismatch"]
