"""Smoothing curves whose strength is chosen on held-out folds, from sums over the rows.

A uniform cubic B-spline has four weights at any place, so all that a fit needs of the rows in one knot interval are 16 sums. Rows are
added up by (key, fold, interval) before the shuffle; the systems are solved from those sums, at most folds * (knots - 1) rows a key,
however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklark.operators.carried import alike
from tracklark.operators.statistics import order_statistics
from tracklark.sources.scratch import saved

PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
STRENGTHS = (0.01, 0.1, 1.0, 10.0, 100.0)


def weights(t: Column) -> list[Column]:
    """The four weights at the share t of an interval."""
    return [(1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6]


def placed(rows: DataFrame, ranges: DataFrame, keys: list[str], x: str, knots: int) -> DataFrame:
    """rows with _cell and _w0 to _w3; ranges: keys, _low, _high."""
    u = (F.col(x) - F.col("_low")) * (knots - 1) / F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1)
    rows = rows.join(ranges, keys).withColumn("_cell", F.least(F.floor(u), F.lit(knots - 2)).cast("int")).withColumn("_t", u - F.col("_cell"))
    return rows.withColumns({f"_w{i}": w for i, w in enumerate(weights(F.col("_t")))}).drop("_t", "_low", "_high")


def solved(sums: pd.DataFrame, knots: int, strengths: tuple[float, ...]) -> tuple[float, list[float], float | None, float]:
    """The strength with the least squared error on the folds left out (ties, or one fold only: the largest), its coefficients on all
    rows, that error's root mean and that of the fit."""
    n, folds = knots + 2, sorted(sums["_fold"].unique())
    a, b = np.zeros((len(folds), n, n)), np.zeros((len(folds), n))
    squares, rows = np.zeros(len(folds)), np.zeros(len(folds))
    f, c = np.searchsorted(folds, sums["_fold"].to_numpy()), sums["_cell"].to_numpy()  # a fold has one row for a cell
    for i, j in PAIRS:
        a[f, c + i, c + j] += sums[f"a{i}{j}"].to_numpy()
        if i != j:
            a[f, c + j, c + i] += sums[f"a{i}{j}"].to_numpy()
    for i in range(4):
        b[f, c + i] += sums[f"b{i}"].to_numpy()
    np.add.at(squares, f, sums["yy"].to_numpy())
    np.add.at(rows, f, sums["n"].to_numpy())
    bend = np.diff(np.eye(n), 2, axis=0)
    bend = bend.T @ bend
    fit = lambda left, right, strength: np.linalg.solve(left + strength * bend + 1e-9 * np.eye(n), right[..., None])[..., 0]
    best, least = max(strengths), None
    if len(folds) > 1:
        for strength in sorted(strengths, reverse=True):
            of_fold = fit(a.sum(0) - a, b.sum(0) - b, strength)
            off = squares - 2 * np.einsum("fi,fi->f", of_fold, b) + np.einsum("fi,fij,fj->f", of_fold, a, of_fold)
            error = float(np.maximum(off, 0.0).sum())
            if least is None or error < least:
                best, least = strength, error
    c = fit(a.sum(0), b.sum(0), best)
    whole = max(float(squares.sum() - 2 * c @ b.sum(0) + c @ a.sum(0) @ c), 0.0)
    return best, c.tolist(), None if least is None else float(np.sqrt(least / rows.sum())), float(np.sqrt(whole / rows.sum()))


def selected_fits(rows: DataFrame, keys: list[str], x: str, y: str, fold: Column, knots: int = 12, strengths: tuple[float, ...] = STRENGTHS) -> DataFrame:
    """keys, low, high, strength, coefficients, n, held_out, rmse. Rows with a null x or y take no part. `fold` must keep rows that belong
    together (a frame's) in one fold. y is taken less its key's mean before the sums, which keeps their digits; level is that mean."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({x: F.col(x).cast("double"), y: F.col(y).cast("double"), "_fold": fold.cast("long")})
    ranges = known.groupBy(*keys).agg(F.min(x).alias("_low"), F.max(x).alias("_high"), F.avg(y).alias("_level"))
    at = placed(known, ranges, keys, x, knots).withColumn(y, F.col(y) - F.col("_level"))
    w = [F.col(f"_w{i}") for i in range(4)]
    sums = at.groupBy(*keys, "_fold", "_cell").agg(*(F.sum(w[i] * w[j]).alias(f"a{i}{j}") for i, j in PAIRS), *(F.sum(w[i] * F.col(y)).alias(f"b{i}") for i in range(4)), F.sum(F.col(y) ** 2).alias("yy"), F.count(F.lit(1)).alias("n"))
    schema = T.StructType([*(rows.schema[k] for k in keys), *T._parse_datatype_string("strength double, coefficients array<double>, n long, held_out double, rmse double").fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_fold", "_cell"])
        strength, c, held_out, rmse = solved(pdf, knots, strengths)
        return pd.DataFrame([{**pdf.iloc[0][keys].to_dict(), "strength": strength, "coefficients": c, "n": int(pdf["n"].sum()), "held_out": held_out, "rmse": rmse}], columns=schema.fieldNames())

    found = sums.groupBy(*keys).applyInPandas(run, schema)
    return found.join(ranges.select(*keys, F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("_level").alias("level")), keys)


def evaluated(rows: DataFrame, fits: DataFrame, keys: list[str], x: str) -> DataFrame:
    """rows with fit, the selected curve at x; beyond the fitted range and without a curve it is null."""
    knots = F.size("_c") - 2
    curves = fits.select(*keys, F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("level").alias("_level"), F.col("coefficients").alias("_c"))
    u = (F.col(x) - F.col("_low")) * (knots - 1) / F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1)
    both = rows.join(curves, keys, "left").withColumn("_u", u).withColumn("_cell", F.least(F.floor("_u"), knots - 2).cast("int"))
    terms = [w * F.get("_c", F.col("_cell") + i) for i, w in enumerate(weights(F.col("_u") - F.col("_cell")))]
    inside = F.col(x).between(F.col("_low"), F.col("_high"))
    return both.withColumn("fit", F.when(inside, F.col("_level") + terms[0] + terms[1] + terms[2] + terms[3])).select(*rows.columns, "fit")


def robust_fits(rows: DataFrame, keys: list[str], x: str, y: str, knots: int = 12, strength: float = 1.0, rounds: int = 8, cut: float = 4.685) -> DataFrame:
    """keys, low, high, coefficients, scale, n_rounds: penalised curves reweighted by Tukey's biweight of the residuals over their scale
    (1.4826 times the median of their sizes); a key whose scale vanishes keeps the curve that it has.

    A round is two aggregations over the rows: 14 weighted sums for each knot interval, and the residuals' median from counts over ranges.
    A row's weight follows from its key's last curve and scale, so only those, one row for each key, pass from round to round."""
    known = saved(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")))
    ranges = known.groupBy(*keys).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    at = saved(_cells(alike(known, ranges, keys), knots).select(*keys, "_x", "_y", "_cell", "_t", "_low", "_high"))
    w = weights(F.col("_t"))
    on = sum((w[i] * F.get("coefficients", F.col("_cell") + i) for i in range(4)), F.lit(0.0))
    off = F.abs(F.col("_y") - on)
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])
    now, done = None, None
    for turn in range(1, rounds + 1):
        weight = F.lit(1.0)
        weighted = at
        if now is not None:
            weighted = alike(at, now.select(*keys, "coefficients", "scale"), keys).filter("coefficients is not null")
            r = off / (cut * F.col("scale"))
            weight = F.when(r < 1, (1 - r * r) * (1 - r * r)).otherwise(0.0) + 1e-6
        weighted = weighted.withColumn("_w", weight)
        sums = weighted.groupBy(*keys, "_cell").agg(*(F.sum(F.col("_w") * w[i] * w[j]).alias(f"a{i}{j}") for i, j in PAIRS), *(F.sum(F.col("_w") * w[i] * F.col("_y")).alias(f"b{i}") for i in range(4)))

        curves = saved(_curves(sums, keys, schema, knots, strength))
        left = alike(at, curves, keys).filter("coefficients is not null").select(*keys, off.alias("_off"))
        middle = {"_a": F.floor((F.col("n") - 1) / 2), "_b": F.floor(F.col("n") / 2)}
        spread = order_statistics(left, keys, "_off", middle).select(*keys, (1.4826 * (F.col("_a") + F.col("_b")) / 2).alias("scale"))
        both = saved(alike(curves, spread, keys).withColumn("n_rounds", F.lit(turn)))
        over = both if turn == rounds else both.filter("scale < 1e-12")
        done = over if done is None else done.union(over)
        now = both.filter("scale >= 1e-12")
        if turn < rounds and not now.take(1):
            break
    return alike(done, ranges.select(*keys, F.col("_low").alias("low"), F.col("_high").alias("high")), keys)


def _curves(sums: DataFrame, keys: list[str], schema: T.StructType, knots: int, strength: float) -> DataFrame:
    """keys, coefficients from the sums of each key's knot intervals, which are packed into one row: many keys' systems are solved at once."""
    names = [*(f"a{i}{j}" for i, j in PAIRS), *(f"b{i}" for i in range(4))]
    packed = sums.groupBy(*keys).agg(F.collect_list(F.struct("_cell", *names)).alias("_s"))
    n = knots + 2
    bend = np.diff(np.eye(n), 2, axis=0)
    fixed = strength * bend.T @ bend + 1e-9 * np.eye(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            owner, cells = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten()
            c = cells.field("_cell").to_numpy()
            value = lambda x, cells=cells: cells.field(x).to_numpy(zero_copy_only=False)
            a, b = np.zeros((len(lists), n, n)), np.zeros((len(lists), n))
            for i, j in PAIRS:
                a[owner, c + i, c + j] += value(f"a{i}{j}")
                if i != j:
                    a[owner, c + j, c + i] += value(f"a{i}{j}")
            for i in range(4):
                b[owner, c + i] += value(f"b{i}")
            found = np.linalg.solve(a + fixed, b[..., None])[..., 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.ListArray.from_arrays(np.arange(0, found.size + 1, n, dtype=np.int32), found.ravel())], names=schema.fieldNames())

    return packed.mapInArrow(run, schema)


def _cells(rows: DataFrame, knots: int) -> DataFrame:
    u = (F.col("_x") - F.col("_low")) * (knots - 1) / F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1)
    rows = rows.withColumn("_u", u).withColumn("_cell", F.least(F.floor("_u"), F.lit(knots - 2)).cast("int"))
    return rows.withColumn("_t", F.col("_u") - F.col("_cell")).drop("_u")


def robust_curves(rows: DataFrame, keys: list[str], x: str, y: str, **how) -> DataFrame:
    """rows with fit, the robust curve at x (null without x); keys with fewer than four rows keep y."""
    fits = robust_fits(rows, keys, x, y, **how)
    few = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    curves = alike(fits, few, keys).filter("_n >= 4").select(*keys, F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("coefficients").alias("_c"), "_n")
    both = _cells(alike(rows, curves, keys).withColumn("_x", F.col(x).cast("double")), how.get("knots", 12))
    fit = sum((w * F.get("_c", F.col("_cell") + i) for i, w in enumerate(weights(F.col("_t")))), F.lit(0.0))
    return both.withColumn("fit", F.when(F.col("_n").isNull(), F.col(y).cast("double")).otherwise(fit)).select(*rows.columns, "fit")
