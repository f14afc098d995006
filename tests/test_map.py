import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklark.operators import accumulate, fits
from tracklark.operators.folds import hysteresis, hysteresis_states

RNG = np.random.default_rng(7)


def basis(x, low, high, knots):
    """All weights of all rows, by the recursion over the degree."""
    h = (high - low) / (knots - 1) if high > low else 1.0
    t = low + h * np.arange(-3, knots + 3)
    cell = np.minimum(np.floor((x - low) / h), knots - 2).astype(int)
    out = np.zeros((len(x), len(t) - 1))
    out[np.arange(len(x)), cell + 3] = 1
    for k in (1, 2, 3):
        out = (x[:, None] - t[: -k - 1]) / (k * h) * out[:, :-1] + (t[k + 1 :] - x[:, None]) / (k * h) * out[:, 1:]
    return out


def plain_fit(x, y, fold, knots, strengths):
    b = basis(x, x.min(), x.max(), knots)
    bend = np.diff(np.eye(knots + 2), 2, axis=0)
    solve = lambda m, s: np.linalg.solve(b[m].T @ b[m] + s * bend.T @ bend + 1e-9 * np.eye(knots + 2), b[m].T @ (y[m] - y.mean()))
    errors = {s: sum((((y - y.mean())[fold == f] - b[fold == f] @ solve(fold != f, s)) ** 2).sum() for f in set(fold)) for s in strengths}
    best = min(strengths, key=lambda s: (errors[s], -s))
    return best, np.sqrt(errors[best] / len(x)), y.mean() + b @ solve(np.ones(len(x), bool), best)


def test_selected_fit_equals_the_plain_one(spark):
    rows, want = [], {}
    for k in range(3):
        x = np.sort(RNG.uniform(0, 100, 80 + 40 * k))
        y = 50 * k + 3 * np.sin(x / (6 + 10 * k)) + RNG.normal(0, 0.3 + k, len(x))
        fold = (np.arange(len(x)) // 4) % 5
        want[k] = plain_fit(x, y, fold, 12, fits.STRENGTHS)
        rows += [(k, i, float(a), float(b), int(f)) for i, (a, b, f) in enumerate(zip(x, y, fold, strict=True))]
    df = spark.createDataFrame([*rows, (0, 900, None, 1.0, 0), (1, 901, 5.0, None, 0)], "k long, i long, x double, y double, f long")
    found = fits.selected_fits(df, ["k"], "x", "y", F.col("f"))
    got = {r["k"]: r for r in found.collect()}
    curve = {(r["k"], r["i"]): r["fit"] for r in fits.evaluated(df, found, ["k"], "x").collect()}
    assert curve[0, 900] is None and len(curve) == len(rows) + 2
    for k, (strength, held_out, fit) in want.items():
        assert got[k]["strength"] == strength
        assert got[k]["held_out"] == pytest.approx(held_out, rel=1e-6)
        assert [curve[k, i] for i in range(len(fit))] == pytest.approx(fit.tolist(), abs=1e-6)


def test_selected_fit_of_few_rows(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0, 0), (2, 1.0, 1.0, 0), (2, 1.0, 3.0, 1)], "k long, x double, y double, f long")
    found = fits.selected_fits(df, ["k"], "x", "y", F.col("f"))
    got = {r["k"]: r for r in found.collect()}
    assert got[1]["held_out"] is None and got[1]["rmse"] == pytest.approx(0, abs=1e-6)
    assert [r["fit"] for r in fits.evaluated(df, found, ["k"], "x").orderBy("k").collect()] == pytest.approx([5.0, 2.0, 2.0], abs=1e-3)
    assert fits.selected_fits(df.filter("k > 5"), ["k"], "x", "y", F.col("f")).count() == 0


def test_a_triangle_is_clipped_and_a_far_ring_is_gone(spark):
    sql = "select array(struct(0.0D e, 0.0D n), struct(4.0D e, 0.0D n), struct(0.0D e, 4.0D n)) ring, array(struct({0}D e, 0.0D n), struct({0}D + 2 e, 0.0D n), struct({0}D + 2 e, 2.0D n), struct({0}D e, 2.0D n)) box"
    area = accumulate.ring_area(accumulate.clipped(F.col("ring"), F.col("box"))).alias("a")
    assert [spark.sql(sql.format(at)).select(area).first()["a"] for at in ("0.0", "1.0", "2.0", "9.0")] == pytest.approx([4.0, 3.5, 2.0, 0.0])


def test_a_half_turn_keeps_its_sign(spark):
    df = spark.createDataFrame([(1, 0.0, 0, 0.0, 9.0), (1, 1.0, 1, 180.0, 9.0), (1, 2.0, 2, 0.0, 9.0), (1, 3.0, 3, None, 9.0), (1, 4.0, 4, 350.0, 9.0), (1, 5.0, 5, 10.0, 0.5), (1, 60.0, 6, 20.0, 9.0)], "k long, t double, i long, h double, v double")
    got = accumulate.turning(df, ["k"], "t", "i", "h", "v").orderBy("i").collect()
    assert [r["turn_rate"] for r in got] == [None, 180.0, -180.0, None, -5.0, None, None]
    assert [r["dt"] for r in got] == [None, 1.0, 1.0, 1.0, 2.0, 1.0, None]


def test_hysteresis_by_windows_equals_the_loop(spark):
    need = {"m": 2, "s": 3}
    rows = [(k, i, [None, "m", "s", "c"][v]) for k in range(6) for i, v in enumerate(RNG.choice(4, 60, p=[0.1, 0.4, 0.3, 0.2]).repeat(1 + k % 3).tolist())]
    got = hysteresis_states(spark.createDataFrame(rows, "k long, i long, v string"), ["k"], ["i"], "v", need).orderBy("k", "i").collect()
    want = [s for k in range(6) for s in hysteresis([v for a, _, v in rows if a == k], need)]
    assert [r["state"] for r in got] == want
