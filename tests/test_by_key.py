"""Steps that take whole keys: keys are streamed in batches, whatever these are cut at, and no group is started for each."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklark.operators import covers, fusion
from tracklark.operators.carried import by_key
from tracklark.operators.statistics import with_median


def plan(df) -> str:
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


@pytest.fixture(params=["1", "3", "10000"])
def batches(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def test_keys_meet_whole_and_in_order(spark, batches):
    rng = random.Random(4)
    rows = [(rng.choice([None, 0.0, 1.0, float("nan"), 2.5]), i, rng.choice([None, 1, 2])) for i in range(200)]
    df = spark.createDataFrame(rows, "k double, i long, v int").repartition(5)
    f = lambda i, v: [[len(i)] * len(i), list(range(len(i))), [None if x is None else x + 1 for x in v]]
    more = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "at", "w")])
    got = by_key(df, ["k"], ["v", "i"], ["i", "v"], f, more).collect()
    of = {}
    for k, i, v in rows:
        of.setdefault(repr(k), []).append((v is None, v, i))
    want = {i: (len(x), at, None if none else v + 1) for x in of.values() for at, (none, v, i) in enumerate(sorted(x, key=lambda r: (r[0], r[1] or 0, r[2])))}
    assert {r["i"]: (r["n"], r["at"], r["w"]) for r in got} == want and len(got) == len(rows)
    assert by_key(df.limit(0), ["k"], ["i"], ["i", "v"], f, more).count() == 0


def test_pieces_are_covered_in_streams(spark, batches):
    """Each piece gets what cover() gives; until round 3 a group was started for each piece, which took more than the covers."""
    rng = random.Random(6)
    rows = [(k, 100 * k + i, float(10 * (i // 4) + i % 4), float(rng.randrange(3)), rng.choice([0.0, 20.0, None])) for k in range(5) for i in range(18)]
    df = spark.createDataFrame(rows, "k long, i long, s double, d double, h double")
    out = covers.path_cover(df, ["k"], "i", "s", "d", "h", 2.0, 1.0)
    assert "FlatMapGroupsInPandas" not in plan(out)
    got, pieces = {r["i"]: r for r in out.collect()}, {}
    for r in rows:
        pieces.setdefault((r[0], r[2] // 10), []).append(r)
    for piece in pieces.values():
        h = [float("nan") if r[4] is None else r[4] for r in piece]
        path, cost, outcome = covers.cover([r[2] for r in piece], [r[3] for r in piece], h, 2.0, 1.0)
        assert [(got[r[1]]["path"], got[r[1]]["cost"], got[r[1]]["outcome"]) for r in piece] == [(piece[p][1], cost, outcome) for p in path]
    assert out.filter(F.col("piece") != F.floor(F.col("s") / 10) * 10).count() == 0


def test_medians_of_windows_are_percentiles(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice([None, float(rng.randrange(9)), rng.uniform(-1, 1)])) for k in range(12) for _ in range(k)] + [(99, None)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(3)
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()}
    got = with_median(df, ["k"], "v", "m").collect()
    assert len(got) == len(rows) and all(r["m"] == want[r["k"]] for r in got)


def test_bins_are_fused_on_one_dealing(spark):
    """Until round 3 each statistic of a bin was an aggregation of its own, joined to the rest, and each key of bins a group of its own."""
    rows = [(k, 2.0 * b + i / 10, b / 10 + i % 2, 1.0, i % 3) for k in (1, 2, None) for b in range(6) for i in range(5)] + [(1, None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "k long, s double, d double, w double, f long").repartition(4)
    bins = fusion.fused_bins(df, ["k"], "s", "d", "w", "f")
    assert plan(bins).count("Exchange hashpartitioning") == 1 and "Join" not in plan(bins)
    assert {(r["k"], r["bin"]): r["n_rows"] for r in bins.collect()} == {(k, b): 5 for k in (1, 2) for b in range(6)}
    out = fusion.fragments(bins.filter("reason is null").select("k", "bin", "s", "d"), ["k"])
    assert "FlatMapGroupsInPandas" not in plan(out) and {(r["k"], r["fragment"]) for r in out.collect()} == {(1, 0), (2, 0)}
