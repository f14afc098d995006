"""Folds over ranges against plain loops: hot keys, many ranges, ties; partitions and chains against every way."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklark.operators import carried, covers, folds


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    rows, i = [], 0
    for k, n in (("hot", 400), ("a", 60), ("b", 60), ("c", 1), (None, 20)):
        t = 0.0
        for _ in range(n):
            t += rng.choice([0.0, 0.5, 1.0, 1.0, 1.5, 9.0])
            rows.append((k, i, t, rng.choice([0.1, 0.4, 1.0, 1.5, 2.0, 5.0]), rng.uniform(0, 4)))
            i += 1
    return rows


@pytest.fixture(scope="module")
def table(spark, made):
    return spark.createDataFrame(made, "k string, i long, t double, v double, d double").repartition(7)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(params=["4", "37"])
def ranges(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_fold_over_ranges_is_the_fold_over_the_key(table, made, ranges):
    """A running sum never forgets: the worst case, right all the same."""

    def step(g, state):
        run = np.cumsum(g["v"].to_numpy()) + (state[0] if state else 0.0)
        return {"run": run}, [float(run[-1])]

    got = {r["i"]: r["run"] for r in carried.carried(table, ["k"], ["t", "i"], step, "run double").collect()}
    for rows in by_key(made).values():
        for r, want in zip(rows, np.cumsum([r[3] for r in rows]), strict=True):
            assert abs(got[r[1]] - want) < 1e-9


def test_rows_are_streamed_once_but_for_keys_that_cross_a_border(spark, tmp_path):
    """Until round 4 every range was streamed for its last state, then for its rows, and these anew wherever the result was used."""
    seen = tmp_path / "seen"

    def step(g, state):
        with open(seen, "a") as out:
            out.write(f"{len(g)}\n")
        return {"before": [state[0] if state and i == 0 else None if i == 0 else int(g["t"].iloc[i - 1]) for i in range(len(g))]}, [int(g["t"].iloc[-1])]

    rows = spark.range(800).selectExpr("id % 40 as k", "id div 40 as t")
    found = carried.carried(rows, ["k"], ["t"], step, "before long", ranges=4)
    got = found.collect()
    assert found.count() == len(got) == 800 and all(r["before"] == (r["t"] - 1 if r["t"] else None) for r in got)
    assert 800 <= sum(map(int, seen.read_text().split())) <= 800 + 2 * 3 * 20


def test_filters(table, made, ranges):
    got = {r["i"] for r in folds.keep_against_last(table, ["k"], ["t", "i"], "v", 1.0).collect()}
    thinned = {r["i"] for r in folds.thin(table.filter("k is not null"), ["k"], ["t", "i"], "t", 4.0).collect()}
    boxed = {r["i"] for r in folds.dedupe_box(table, ["k"], "t", "d", "i", "v", 2.0).collect()}
    want, want_thin, want_box = set(), set(), set()
    for k, rows in by_key(made).items():
        last = at = None
        for n, r in enumerate(rows):
            if last is None or abs(r[3] - last) <= 1.0:
                want.add(r[1])
                last = r[3]
            if k is not None and (at is None or r[2] - at >= 4.0 or n == len(rows) - 1):
                want_thin.add(r[1])
                at = r[2]
        out = []
        for r in sorted(rows, key=lambda r: (r[2], r[4], r[1])):
            if out and abs(r[2] - out[-1][2]) <= 2.0 and abs(r[4] - out[-1][4]) <= 2.0:
                if r[3] > out[-1][3]:
                    out[-1] = r
            else:
                out.append(r)
        want_box |= {r[1] for r in out}
    assert (got, thinned, boxed) == (want, want_thin, want_box)


def plain_lock(t, speed, stop=1.0, go=2.0, dwell=3.0):
    locked, state, since = [False] * len(t), "moving", None
    for i, (now, v) in enumerate(zip(t, speed, strict=True)):
        slow = state in ("stopped", "starting")
        locked[i] = slow
        if (v >= go) if slow else (v <= stop):
            since = i if state in ("moving", "stopped") else since
            state = "starting" if slow else "stopping"
            if now - t[since] >= dwell:
                locked[since : i + 1] = [not slow] * (i + 1 - since)
                state, since = ("moving" if slow else "stopped"), None
        else:
            state, since = ("stopped" if slow else "moving"), None
    return locked


def test_lock(table, made, ranges):
    got = {r["i"]: r["locked"] for r in folds.stationary_lock(table.filter("k is not null"), ["k"], "t", "i", "v").collect()}
    for k, rows in by_key(made).items():
        if k is not None:
            assert [got[r[1]] for r in rows] == plain_lock([r[2] for r in rows], [r[3] for r in rows])
    # Back to the first slow row; a short stop is none.
    assert plain_lock(range(10), [5, 5, 0.5, 0.5, 0.5, 0.5, 5, 5, 5, 5]) == [False, False, True, True, True, True, False, False, False, False]


def test_pieces(table, made, ranges):
    got = {r["i"]: r["piece"] for r in carried.pieces(table, ["k"], ["t", "i"], "t", 2.0).collect()}
    assert len(got) == len(made)
    for rows in by_key(made).values():
        start = before = None
        for r in rows:
            start = r[2] if before is None or r[2] - before > 2.0 else start
            before = r[2]
            assert got[r[1]] == start


def every_cover(s, d, h, gap, step):
    """(paths, cost) of the best partition, over all."""
    best = (len(s) + 1, 0.0)
    for took in itertools.product(*[range(-1, i) for i in range(len(s))]):
        used = [a for a in took if a >= 0]
        if len(used) != len(set(used)):
            continue
        cost, ways, right = 0.0, {}, True
        for i, a in enumerate(took):
            ways[i] = (0, False)
            if a < 0:
                continue
            aside, turned = d[i] - d[a], covers.turn(h[a], h[i])
            way = covers.onward((a, *ways[a]), (aside > 0) - (aside < 0))
            if not 0 < s[i] - s[a] <= gap or abs(aside) > step or turned > 30 or way is None:
                right = False
                break
            ways[i] = way
            cost += abs(aside) + 0.05 * turned + (s[i] - s[a] > 0)
        if right:
            best = min(best, (len(s) - len(used), round(cost, 9)))
    return best


def test_cover_is_the_best_of_all():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randrange(1, 7)
        s = sorted(rng.choice([0.0, 1.0, 2.0, 3.0, 4.0]) for _ in range(n))
        d, h = [rng.choice([0.0, 1.0, 2.0, 3.0]) for _ in range(n)], [rng.choice([0.0, 10.0, 350.0, 25.0]) for _ in range(n)]
        path, cost, outcome = covers.cover(s, d, h, 2.0, 2.0)
        assert outcome == "covered" and (len(set(path)), round(cost, 9)) == every_cover(s, d, h, 2.0, 2.0)


def test_cover_of_a_table(spark, made, table, ranges):
    """Pieces are covered apart; the paths are valid; too many states are an outcome, not a partial cover."""
    rows = table.filter("k is not null").withColumn("h", F.lit(0.0))
    got = covers.path_cover(rows, ["k"], "i", "t", "d", "h", 2.0, 1.5).collect()
    assert len(got) == rows.count()
    paths = {}
    for r in sorted(got, key=lambda r: (r["t"], r["i"])):
        paths.setdefault((r["k"], r["path"]), []).append(r)
    for (_, first), members in paths.items():
        if first is not None:
            assert members[0]["i"] == first and len({m["piece"] for m in members}) == 1
            assert all(0 < b["t"] - a["t"] <= 2.0 and abs(b["d"] - a["d"]) <= 1.5 for a, b in zip(members, members[1:]))
    few = covers.path_cover(rows, ["k"], "i", "t", "d", "h", 2.0, 1.5, most_states=1).collect()
    assert {(r["path"] is None, r["cost"] is None) for r in few if r["outcome"] == "overflow"} == {(True, True)}


def test_longest_chains_and_their_rows(spark):
    rng = random.Random(9)
    rows = [(i % 3, i, float(rng.randrange(12)), rng.randrange(4)) for i in range(45)]
    df = spark.createDataFrame([*rows, (7, 900, 1.0, 1)], "k long, i long, s double, d long")
    links = covers.steps(df, ["k"], "i", "s", 3.0, F.abs(F.col("a_d") - F.col("b_d")) <= 1, ["d"])
    want = {}
    for k in range(3):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        best = {}
        for r in own:
            best[r[1]] = max([(0.0, 1)] + [(best[q[1]][0] + r[2] - q[2], best[q[1]][1] + 1) for q in own if 0 < r[2] - q[2] <= 3 and abs(r[3] - q[3]) <= 1])
        end = min(best, key=lambda i: (-best[i][0], -best[i][1], i))
        want[k] = (end, *best[end])
    assert {r["k"]: (r["end"], r["length"], r["n_rows"]) for r in covers.longest_chains(df, links, ["k"], "i").collect()} == want
    members, s = {}, {r[1]: r for r in rows}
    for r in covers.chain_members(df, links, ["k"], "i").orderBy("back").collect():
        members.setdefault(r["k"], []).append(r["id"])
    for k, chain in members.items():
        end, length, n = want[k]
        assert chain[0] == end and len(chain) == n and s[end][2] - s[chain[-1]][2] == length
        assert all(0 < s[a][2] - s[b][2] <= 3 and abs(s[a][3] - s[b][3]) <= 1 for a, b in zip(chain, chain[1:]))
    assert covers.longest_chains(df.limit(0), links, ["k"], "i").count() == 0
