"""Strands and their split against plain versions."""

import random

import pytest

from tracklark.operators import purity


@pytest.mark.parametrize("partitions", ["2", "9"])
def test_strands_are_first_fit(spark, partitions):
    rng = random.Random(4)
    rows = [(k, 100 * k + i, a, a + rng.uniform(1, 30), rng.choice([None, 0.0, 50.0, 100.0, 350.0])) for k in (1, 2) for i, a in enumerate(sorted(rng.uniform(0, 400) for _ in range(60)))]
    want = {}
    for k in (1, 2):
        made = []
        for r in (r for r in rows if r[0] == k):
            for x in made:
                if r[2] <= x[1] + 8 and (r[4] is None or x[2] is None or abs((r[4] - x[2] + 180) % 360 - 180) <= 70):
                    x[1] = max(x[1], r[3])
                    want[r[1]] = x[0]
                    break
            else:
                made.append([r[1], r[3], r[4]])
                want[r[1]] = r[1]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "k long, id long, a double, b double, h double")
        assert {r["id"]: r["strand"] for r in purity.strands(df, ["k"], "id", "a", "b", "h").collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_split_where_two_lines_stand_side_by_side(spark):
    """pure: one line; two: two lines for 60 m, one curve elsewhere; short: two lines for 10 m only; loose: no tight modes."""
    rows = []

    def curve(strand, name, a, b, d):
        rows.extend((strand, name, float(s), float(d(s))) for s in range(a, b + 1, 5))

    for i in range(4):
        curve("pure", i, 0, 60, lambda s, i=i: 1 + i / 10)
        curve("two", i, 0, 60, lambda s, i=i: (12 if i % 2 else 1) + i / 10)
        curve("short", i, 0, 10, lambda s, i=i: (12 if i % 2 else 1) + i / 10)
        curve("loose", i, 0, 60, lambda s, i=i: (30 if i % 2 else 1) + s / 4 * (-1) ** (i // 2))
    curve("two", 9, 70, 90, lambda s: 1.0)
    curve("alone", 0, 0, 60, lambda s: 0.0)
    df = spark.createDataFrame(rows, "strand string, curve long, s double, d double")
    got = {(r["strand"], r["curve"]): r["part"] for r in purity.split(df, "strand", "curve", "s", "d").collect()}
    assert got == {("two", 0): 1, ("two", 1): 2, ("two", 2): 1, ("two", 3): 2, ("two", 9): 3, ("alone", 0): 0} | {(x, i): 0 for x in ("pure", "short", "loose") for i in range(4)}
    assert purity.split(df.limit(0), "strand", "curve", "s", "d").count() == 0
