import itertools

import numpy as np

from tracklark.operators.folds import assign, hysteresis, smoothing_spline, track


def test_hysteresis_needs_a_streak():
    got = hysteresis(np.array(list("ammmaasss")), {"m": 2, "s": 3})
    assert "".join(got) == "aammmaaas"


def test_assignment_is_the_best_one():
    rng = np.random.default_rng(5)
    for n, m in ((3, 3), (4, 3), (3, 5), (1, 4), (5, 5)):
        cost = rng.random((n, m)) * 10
        got = assign(cost)
        total = sum(cost[i, j] for i, j in enumerate(got) if j >= 0)
        big, small = (cost, m) if n >= m else (cost.T, n)
        best = min(sum(big[i, k] for k, i in enumerate(p)) for p in itertools.permutations(range(big.shape[0]), small))
        assert abs(total - best) < 1e-9


def test_forbidden_pairs_stay_apart():
    assert assign(np.array([[1.0, 9.0], [9.0, 9.0]]), 5.0) == [0, -1]


def test_spline_ignores_an_outlier():
    x = np.linspace(0, 10, 60)
    y = np.sin(x)
    bad = y.copy()
    bad[30] += 20
    assert np.abs(smoothing_spline(x, bad, strength=1e-4) - y).max() < 0.1


def test_sparse_assignment_has_most_pairs_at_least_cost():
    rng = np.random.default_rng(7)
    for _ in range(150):
        n, m = rng.integers(1, 6, 2)
        cost = np.round(rng.random((n, m)) * 10, 3)
        got = assign(cost, 4.0)
        made = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert len({j for _, j in made}) == len(made) and all(cost[i, j] < 4 for i, j in made)
        best = (0, 0.0)
        for p in itertools.product(range(-1, m), repeat=n):
            used = [j for j in p if j >= 0]
            if len(set(used)) == len(used) and all(cost[i, j] < 4 for i, j in enumerate(p) if j >= 0):
                best = max(best, (len(used), -sum(cost[i, j] for i, j in enumerate(p) if j >= 0)))
        assert len(made) == best[0] and abs(sum(cost[i, j] for i, j in made) + best[1]) < 1e-9


def test_tracks(spark):
    """Two lanes keep their ids over a missed frame; an item between two tracks starts one; a track unseen too long ends."""
    rows = [(1, f, v) for f in range(3) for v in (0.0, 10.0)] + [(1, 4, 0.5), (1, 4, 10.5), (1, 5, 5.5), (1, 20, 0.0)]
    rows += [(1, f, 100.0) for f in range(6, 12)]
    df = spark.createDataFrame([(k, f, i, v) for i, (k, f, v) in enumerate(rows)], "k long, f long, i long, v double")
    got = {(r["f"], r["v"]): r["track"] for r in track(df, ["k"], "f", "i", "v", 7.0).collect()}
    low, high = got[0, 0.0], got[0, 10.0]
    assert [got[f, 0.0] for f in (1, 2)] == [low] * 2 and [got[f, 10.0] for f in (1, 2)] == [high] * 2 and (got[4, 0.5], got[4, 10.5]) == (low, high)
    assert got[5, 5.5] not in (low, high) and got[20, 0.0] not in (low, high, got[5, 5.5]) and len({got[f, 100.0] for f in range(6, 12)}) == 1
