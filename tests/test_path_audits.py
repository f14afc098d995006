"""Paths near themselves, corridors, lateral order, summaries that add up, robust curves and publishers' tokens against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklark.operators import covers, fits, ordering, partials, revisits
from tracklark.operators.folds import smoothing_spline
from tracklark.operators.statistics import summary
from tracklark.sinks import publish


def test_least_apart(spark):
    rng = random.Random(1)
    rows, want = [], {}
    shapes = {
        "walk": lambda i: (i * 1.0, rng.uniform(0, 3)),
        "still": lambda i: (5.0, 5.0),
        "dense": lambda i: (rng.gauss(0, 1e-7), rng.gauss(0, 1e-7)),
        "wide": lambda i: (rng.uniform(-1e6, 1e6), rng.uniform(-1e6, 1e6)),
        "line": lambda i: (3.0 * i, 0.0),
    }
    for k, f in shapes.items():
        pts = [f(i) for i in range(60)]
        rows += [(k, i, *p) for i, p in enumerate(pts)]
        want[k] = min(math.dist(a, b) for (i, a), (j, b) in itertools.combinations(enumerate(pts), 2) if j - i >= 3)
    rows += [("few", 0, 0.0, 0.0), ("few", 1, 0.0, 0.0), ("few", 2, 1.0, None), ("near", 0, 0.0, 0.0), ("near", 1, 0.0, 1.0), ("near", 2, 0.0, 2.0), ("near", 3, 0.0, 0.5)]
    want |= {"few": 0.0, "near": 0.5}
    df = spark.createDataFrame(rows, "k string, i long, e double, n double").repartition(5)
    got = {r["k"]: r["distance"] for r in revisits.least_apart(df, ["k"], ["i"], "e", "n").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-15) for k in want)
    assert revisits.least_apart(df.limit(0), ["k"], ["i"], "e", "n").count() == 0


def test_crossings_tell_loops_from_chords(spark):
    """A figure of eight crosses; a curve whose sparse chord cuts an earlier stretch at a flat angle does not."""
    eight = [(0, 0), (50, 50), (100, 0), (100, 50), (50, 0), (0, 50)]
    flat = [(0, 0), (60, 0), (120, 2), (60, 8), (0, 6), (-10, 3), (30, 2), (80, -3)]
    rows = [("eight", i, float(e), float(n), None) for i, (e, n) in enumerate(eight)] + [("flat", i, float(e), float(n), 90.0) for i, (e, n) in enumerate(flat)]
    df = spark.createDataFrame(rows, "k string, i long, e double, n double, h double")
    got = {(r["k"], r["a"], r["b"]): r for r in revisits.crossings(df, ["k"], ["i"], "e", "n", "h").collect()}
    assert got[("eight", 0, 4)]["verdict"] == "genuineCrossing" and got[("eight", 0, 4)]["angle"] > 45
    assert {r["verdict"] for (k, *_), r in got.items() if k == "flat"} == {"curveChordArtifact"}


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ((5.0, 100.0, 60.0, 180.0, 10.0, 10.0, 170.0), ("genuineRevisit", "oppositeDirection")),
        ((0.5, 300.0, 60.0, 70.0, 95.0, 10.0, 20.0), ("genuineRevisit", "sameRoad")),
        ((5.0, 100.0, 60.0, 50.0, 10.0, 10.0, 20.0), ("genuineRevisit", "compactLoop")),
        ((5.0, 100.0, 900.0, 65.0, 10.0, 10.0, 20.0), ("genuineRevisit", "moderateRatio")),
        ((0.5, 100.0, 60.0, 5.0, 10.0, 10.0, 350.0), ("genuineRevisit", "loopClosure")),
        ((1.0, 100.0, 60.0, 20.0, 10.0, 10.0, 20.0), ("curveArtifact", None)),
        ((5.0, 100.0, 60.0, 20.0, 10.0, 10.0, 20.0), ("ambiguous", None)),
    ],
)
def test_revisit_verdicts(spark, values, want):
    assert tuple(spark.range(1).select(*revisits.revisit_verdict(*map(F.lit, values))).first()) == want


def test_corridor(spark):
    source = [("a", i, 10.0 * i, 0.0) for i in range(10)] + [("b", 0, 0.0, 0.0), ("b", 1, 1.0, 0.0), ("c", 0, 5.0, 5.0), ("e", 0, 0.0, 0.0), ("e", 1, 9.0, 0.0)]
    fitted = [("a", i, 9.0 * i, 1.5) for i in range(11)] + [("b", i, 3e5 + i, 0.0) for i in range(3)] + [("c", i, 5.0, 5.0 + i) for i in range(3)] + [("d", 0, 1.0, 1.0), ("e", 0, 0.0, 1.0), ("e", 1, 4.0, 700.0), ("e", 2, 9.0, 0.0)]
    table = lambda rows: spark.createDataFrame(rows, "k string, i long, e double, n double")
    got = {r["k"]: (r["max_off"] and round(r["max_off"], 9), r["reason"]) for r in revisits.corridor(table(fitted), table(source), ["k"], "i", "i", 3.0).collect()}
    assert got == {"a": (1.5, None), "b": (300001.0, "globalConsumedAsLocal"), "c": (2.0, None), "d": (None, "missingSourceGeometry"), "e": (700.0, "sourceCorridorExceeded")}


def test_order_changes_without_pairs(spark):
    rng = random.Random(2)
    rows, frames = [], {}
    for f in range(12):
        names = rng.sample(range(25), rng.choice([0, 1, 2, 9, 25]))
        d = {t: rng.choice([1.0, 2.0, 3.0, rng.uniform(0, 9)]) for t in names}
        rows += [("g", f, t, v) for t, v in d.items()]
        if d:
            frames[f] = sorted(d, key=lambda t: (-d[t], t))
    want = {}
    for a, b in itertools.pairwise(sorted(frames)):
        was, now = frames[a], frames[b]
        both = [t for t in now if t in was]
        inv = sum((was.index(x) < was.index(y)) != (now.index(x) < now.index(y)) for x, y in itertools.combinations(both, 2))
        off = sum(x != y for x, y in zip(was, now, strict=False))
        want[b] = (len(both), len(both) * (len(both) - 1) // 2, off, inv, "pairwise_inversion" if inv else "support_change_only" if off else None)
    df = spark.createDataFrame(rows, "k string, f long, t long, d double")
    found = ordering.transitions(df, ["k"], "f", "t", "d")
    assert {r["f"]: tuple(r)[2:] for r in found.select("k", "f", "n_common", "n_pairs", "n_mismatches", "n_inversions", "kind").collect()} == want
    total = ordering.audit(found, ["k"]).first()
    assert total["n_inversions"] == sum(w[3] for w in want.values())
    runs = ordering.episodes(found, ["k"], "f").collect()
    assert sum(r["n_transitions"] for r in runs) == sum(w[4] is not None for w in want.values())


def test_parts_add_up(spark, tmp_path):
    rows = [(i % 3, i % 7 / 2.0 if i % 11 else None, i) for i in range(200)] + [(0, float("nan"), 1), (1, float("inf"), 2)]
    df = spark.createDataFrame(rows, "k long, v double, i long")
    make = lambda d: partials.partial(d, ["k"], {"v": F.col("v")}, {"odd": F.col("i") % 2 == 1, "never": F.col("i") < 0})
    whole, parts = make(df), [make(df.filter(f"i % 4 = {j}")) for j in range(4)]
    key = lambda d: sorted(map(tuple, d.select("k", "metric", "value", "n").collect()), key=repr)
    assert key(partials.merged(partials.merged(*parts[:2]), *parts[2:])) == key(whole)
    got = {r["k"]: tuple(r)[2:] for r in partials.summaries(whole).collect()}
    assert got == {r["k"]: tuple(r)[1:] for r in summary(df, ["k"], "v").collect()}
    assert {(r["k"], r["metric"]): r["n"] for r in partials.totals(whole).collect()}[(0, "never")] == 0
    # A batch that is saved twice counts once.
    for j, part in [*enumerate(parts), (2, parts[2])]:
        partials.save_part(part, str(tmp_path / "t"), j)
    assert key(partials.stored(spark, str(tmp_path / "t"))) == key(whole)
    assert sum(r["n"] for r in partials.histogram(whole, "v", 0.0, 2.0, 4).collect()) == sum(1 for i in range(200) if i % 11)


def test_a_stream_keeps_a_summary(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, float(i % 5)) for i in range(50)], "k long, v double").repartition(5)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = partials.keep_up(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["k"], {"v": F.col("v")}, {})
    running.processAllAvailable()
    running.stop()
    assert {r["k"]: tuple(r)[2:] for r in partials.summaries(partials.stored(spark, str(tmp_path / "out"))).collect()} == {r["k"]: tuple(r)[1:] for r in summary(df, ["k"], "v").collect()}


def test_robust_curves_equal_the_spline(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k, n in (("a", 80), ("b", 30), ("few", 3), ("flat", 12)):
        x = np.sort(rng.uniform(0, 20, n))
        y = np.zeros(n) if k == "flat" else np.sin(x / 3) + 0.05 * rng.standard_normal(n)
        if k == "a":
            y[::9] += 5
        rows += [(k, float(a), float(b)) for a, b in zip(x, y, strict=True)]
        want |= {(k, float(a)): float(f) for a, f in zip(x, smoothing_spline(x, y) if n >= 4 else y, strict=True)}
    got = fits.robust_curves(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()
    assert len(got) == len(want) and max(abs(r["fit"] - want[(r["k"], r["x"])]) for r in got) < 1e-6


def test_a_stalled_publisher_cannot_point(spark, tmp_path):
    root, df = str(tmp_path / "root"), spark.range(3)
    first, second = publish.fencing_token(spark, root), publish.fencing_token(spark, root)
    assert (first, second) == (1, 2)
    run = publish.publish({"t": df}, root, token=second)
    with pytest.raises(publish.StaleToken):
        publish.publish({"t": df.limit(1)}, root, token=first)
    assert [p.rpartition("-")[2] for p in publish.pointers(spark, root)] == [run] or run in publish.pointers(spark, root)[-1]


def test_vanishing_forms_have_the_sign_of_the_sum_as_written(spark):
    v, m = -0.1, 0.1
    cases = [(i, n / 100.0) for i, n in enumerate(range(400))]
    written = {i: a * a * v + 2 * m * a * a + a * a * v for i, a in cases}
    assert any(f < 0 for f in written.values())
    rows = spark.createDataFrame([(i, [[v, m], [m, v]], [a, a]) for i, a in cases] + [(-1, [[1.0], [1.0, 1.0]], [1.0, 1.0]), (-2, [[1.0, 0.5], [0.25, 4.0]], [2.0, 1.0]), (-3, [], [])], "i long, m array<array<double>>, c array<double>")
    value, reason = covers.branch_uncertainty(F.array(F.lit(1.0)), F.lit(True), F.col("m"), F.col("c"), F.lit("other"), F.lit(True), F.lit(True))
    got = {r["i"]: (r["value"], r["reason"]) for r in rows.select("i", value.alias("value"), reason.alias("reason")).collect()}
    assert (got.pop(-1), got.pop(-2), got.pop(-3)) == ((None, "covariance"), (math.sqrt(9.5), None), (0.0, None))
    assert got == {i: (math.sqrt(f), None) if f >= 0 else (None, "covariance") for i, f in written.items()}


def test_cells_of_lines_are_not_broadcast(spark):
    points = spark.createDataFrame([("a", i, float(i), 0.5) for i in range(50)], "k string, id long, e double, n double")
    lines = spark.createDataFrame([("a", 0.0, 0.0, 1e3, 0.0)], "k string, ae double, an double, be double, bn double")
    near = revisits.near_pieces(points, lines, ["k"], 4.0)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.select("id").distinct().count() == 50


def test_systems_of_many_keys_are_solved_at_once(spark):
    names = [*(f"a{i}{j}" for i, j in fits.PAIRS), *(f"b{i}" for i in range(4))]
    rng = np.random.default_rng(3)
    rows = [(k, c, *map(float, rng.uniform(0, 1, 14))) for k in range(5) for c in range(k, 5)]
    df = spark.createDataFrame(rows, "k long, _cell int, " + ", ".join(f"{x} double" for x in names))
    schema = df.select("k", F.array("a00").alias("coefficients")).schema
    found = fits._curves(df, ["k"], schema, 6, 1.0)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    bend = np.diff(np.eye(8), 2, axis=0)
    for r in found.collect():
        a, b = bend.T @ bend + 1e-9 * np.eye(8), np.zeros(8)
        for _, c, *x in (y for y in rows if y[0] == r["k"]):
            v = dict(zip(names, x, strict=True))
            for i, j in itertools.product(range(4), repeat=2):
                a[c + i, c + j] += v[f"a{min(i, j)}{max(i, j)}"]
            b[c : c + 4] += [v[f"b{i}"] for i in range(4)]
        assert np.allclose(r["coefficients"], np.linalg.solve(a, b))
