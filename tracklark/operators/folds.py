"""Steps that depend on what was kept before: filters, thinning, box dedupe and the stationary lock as carried folds, which split a hot key;
hysteresis as windows; assignment, tracker and smoothing spline as grouped pandas functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklark.operators.carried import alike, carried
from tracklark.sources.scratch import saved


def grouped(rows: DataFrame, keys: list[str], order: list[str], f, more: str) -> DataFrame:
    """f(sorted group) -> group with the columns `more` added, for each key."""
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(more).fields])
    names = schema.fieldNames()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf.sort_values(order, kind="stable").reset_index(drop=True))[names]

    return rows.groupBy(*keys).applyInPandas(run, schema)


def hysteresis(values: np.ndarray, need: dict[str, int], default: int = 2) -> list[str]:
    """A state only changes after as many equal values in a row as it needs; the first value is the first state."""
    out, state, streak, last = [], None, 0, None
    for v in values:
        streak = streak + 1 if v == last else 1
        last = v
        if not out or streak >= need.get(v, default):
            state = v
        out.append(state)
    return out


def hysteresis_states(rows: DataFrame, keys: list[str], order: list[str], instant: str, need: dict[str, int], default: int = 2) -> DataFrame:
    """rows with state: `hysteresis` as windows. The state is the last value that stood in as many rows in a row as it needs, as one that
    is the state already changes nothing; nulls are a value of their own."""
    w = W.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_i", F.row_number().over(w))
    rows = rows.withColumn("_from", F.when((F.col("_i") == 1) | ~F.col(instant).eqNullSafe(F.lag(instant).over(w)), F.col("_i")))
    streak = F.col("_i") - F.last("_from", True).over(upto) + 1
    least = F.lit(default)
    for value, n in need.items():
        least = F.when(F.col(instant) == value, n).otherwise(least)
    rows = rows.withColumn("_held", F.when((F.col("_i") == 1) | (streak >= least), F.struct(F.col(instant).alias("v"))))
    return rows.withColumn("state", F.last("_held", True).over(upto)["v"]).drop("_i", "_from", "_held")


def stationary_lock(rows: DataFrame, keys: list[str], time: str, tie: str, speed: str, stop: float = 1.0, go: float = 2.0, dwell: float = 3.0) -> DataFrame:
    """rows with locked: at most stop fast for at least dwell, until at least go for that long; both count from the first row of the stretch.

    A fold over rows names the stretch that a row is in and that may yet turn, by its first row; a stretch turns where it lasts."""

    def step(g: pd.DataFrame, state: list | None):
        held, since, name = state or ["moving", None, None]
        base, stretch, turns = np.zeros(len(g), bool), [None] * len(g), np.zeros(len(g), bool)
        for i, (now, own, x) in enumerate(zip(g[time].tolist(), g[tie].tolist(), g[speed].tolist(), strict=True)):
            base[i] = was_locked = held in ("stopped", "starting")
            if (x >= go) if was_locked else (x <= stop):
                if held in ("moving", "stopped"):
                    since, name = now, f"{now} {own}"
                stretch[i], held = name, "starting" if was_locked else "stopping"
                if now - since >= dwell:
                    turns[i] = True
                    held, since, name = ("moving" if was_locked else "stopped"), None, None
            else:
                held, since, name = ("stopped" if was_locked else "moving"), None, None
        return {"_base": base, "_stretch": stretch, "_turns": turns}, [held, since, name]

    marked = carried(rows, keys, [time, tie], step, "_base boolean, _stretch string, _turns boolean")
    turned = marked.filter("_turns").select(*keys, "_stretch").distinct().withColumn("_t", F.lit(True))
    return alike(marked, turned, [*keys, "_stretch"]).withColumn("locked", F.col("_base") != F.coalesce("_t", F.lit(False))).select(*rows.columns, "locked")


def keep_against_last(rows: DataFrame, keys: list[str], order: list[str], value: str, most_step: float) -> DataFrame:
    """Rows whose value is at most most_step from the last kept one's; the first is kept."""

    def step(g: pd.DataFrame, state: list | None):
        keep, last = np.zeros(len(g), bool), state and state[0]
        for i, v in enumerate(g[value].to_numpy().tolist()):
            if last is None or abs(v - last) <= most_step:
                keep[i], last = True, v
        return {"_keep": keep}, [last]

    return carried(rows, keys, order, step, "_keep boolean").filter("_keep").drop("_keep")


def thin(rows: DataFrame, keys: list[str], order: list[str], s: str, spacing: float) -> DataFrame:
    """Rows at least spacing after the last kept one; the first and the last are kept. order begins with s."""

    def step(g: pd.DataFrame, state: list | None):
        x, keep = g[s].to_numpy(), np.zeros(len(g), bool)
        i = 0 if state is None else int(np.searchsorted(x, state[0] + spacing))
        last = state and state[0]
        while i < len(x):
            keep[i], last = True, x[i].item()
            i = max(i + 1, int(np.searchsorted(x, last + spacing)))
        return {"_keep": keep}, [last]

    kept = carried(rows, keys, order, step, "_keep boolean")
    kept = saved(kept)  # read twice
    ends = kept.groupBy(*keys).agg(F.max_by(F.struct(*kept.columns), F.struct(*order)).alias("_end")).select("_end.*")
    return kept.filter("_keep").union(ends.filter("not _keep")).drop("_keep")


def dedupe_box(rows: DataFrame, keys: list[str], s: str, d: str, tie: str, score: str, box: float) -> DataFrame:
    """By (s, d): a row within the box of the last one put out takes its place if its score is higher, else goes.

    A fold over rows gives each row that takes a place the place's name, by the row that opened it; of the rows of one place the last
    stays."""

    def step(g: pd.DataFrame, state: list | None):
        x, y, p, own = (g[c].tolist() for c in (s, d, score, tie))
        place, before = [None] * len(g), state
        for i in range(len(g)):
            if before is None or abs(x[i] - before[0]) > box or abs(y[i] - before[1]) > box:
                before = [x[i], y[i], p[i], f"{x[i]} {y[i]} {own[i]}"]
            elif p[i] > before[2]:
                before = [x[i], y[i], p[i], before[3]]
            else:
                continue
            place[i] = before[3]
        return {"_place": place}, before

    placed = carried(rows, keys, [s, d, tie], step, "_place string").filter("_place is not null")
    return placed.groupBy(*keys, "_place").agg(F.max_by(F.struct(*rows.columns), F.struct(s, d, tie)).alias("_top")).select("_top.*")


def blocks(allowed: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Rows and columns of each connected part of the allowed pairs that has any."""
    left, out = set(np.flatnonzero(allowed.any(1)).tolist()), []
    while left:
        rows, columns, new = set(), set(), {min(left)}
        while new:
            rows |= new
            columns |= set(np.flatnonzero(allowed[sorted(new)].any(0)).tolist())
            new = set(np.flatnonzero(allowed[:, sorted(columns)].any(1)).tolist()) - rows
        left -= rows
        out.append((sorted(rows), sorted(columns)))
    return out


def matched(cost: np.ndarray) -> list[int]:
    """Row -> column (or -1): as many pairs as can be made (inf: none), of least total cost. The pairs grow one at a time, by the cheapest
    chain of swaps from a free row to a free column."""
    n, m = cost.shape
    if n == 1:
        return [int(cost[0].argmin())]
    if m == 1:
        best = int(cost[:, 0].argmin())
        return [0 if i == best else -1 for i in range(n)]
    of_row = [-1] * n
    while True:
        owner = {c: r for r, c in enumerate(of_row) if c >= 0}
        free = [r for r, c in enumerate(of_row) if c < 0]
        if not free:
            return of_row
        reach, via = cost[free].min(0), [free[k] for k in cost[free].argmin(0)]
        changed = True
        while changed:
            changed = False
            for c, r in owner.items():
                through = reach[c] - cost[r, c] + cost[r]
                for k in np.flatnonzero(through < reach - 1e-12):
                    reach[k], via[k], changed = through[k], r, True
        open_ = [c for c in range(m) if c not in owner and np.isfinite(reach[c])]
        if not open_:
            return of_row
        at = min(open_, key=lambda c: reach[c])
        while at >= 0:
            row = via[at]
            of_row[row], at = at, of_row[row]


def assign(cost: np.ndarray, most: float = np.inf) -> list[int]:
    """Row -> column (or -1) of least total cost among the assignments with most pairs; pairs at or above `most` are forbidden. Only
    connected parts of the allowed pairs are solved."""
    allowed = cost < most
    open_, out = np.where(allowed, cost, np.inf), [-1] * len(cost)
    # Where the nearest columns of the rows that have any differ, they are the best there is.
    own = [int(c) if ok else -1 for c, ok in zip(open_.argmin(1), allowed.any(1), strict=True)] if cost.shape[1] else out
    taken = [c for c in own if c >= 0]
    if len(set(taken)) == len(taken):
        return own
    for rows, columns in blocks(allowed):
        for r, c in zip(rows, matched(open_[np.ix_(rows, columns)]), strict=True):
            out[r] = columns[c] if c >= 0 else -1
    return out


def track(rows: DataFrame, keys: list[str], frame: str, item: str, value: str, gate: float, coast: int = 4, ratio: float = 1.2) -> DataFrame:
    """rows with track: per frame the items are assigned to the live tracks by least total distance of value, within gate. An item
    whose second-best track costs less than ratio times its best starts a new track; a track unseen for more than coast frames ends."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        live: dict[int, tuple[float, int]] = {}
        values, ids, nxt = g[value].to_numpy(float), np.zeros(len(g), np.int64), 0
        starts = np.flatnonzero(np.append(True, g[frame].to_numpy()[1:] != g[frame].to_numpy()[:-1])) if len(g) else []
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(g)], strict=True)):
            live = {t: x for t, x in live.items() if k - x[1] - 1 <= coast}
            names, got = sorted(live), [-1] * (b - a)
            if b - a == 1 and names:
                # One item, as in most frames: its nearest and second-nearest track, without a matrix.
                v = float(values[a])
                off, t = min((abs(v - live[t][0]), t) for t in names)
                second = min((abs(v - live[u][0]) for u in names if u != t), default=np.inf)
                if not off < gate or second < gate and second < ratio * max(off, 1e-9):
                    t, nxt = nxt, nxt + 1
                ids[a], live[t] = t, (v, k)
                continue
            if names:
                cost = np.abs(values[a:b, None] - np.array([live[t][0] for t in names])[None, :])
                got = assign(cost, gate)
            for r, j in enumerate(got):
                clear = j >= 0
                if clear and len(names) > 1:
                    other = np.partition(cost[r], 1)[:2] if cost[r, j] <= cost[r].min() else cost[r][[cost[r].argmin()] * 2]
                    clear = not (other[1] < gate and other[1] < ratio * max(cost[r, j], 1e-9))
                t = names[j] if clear else nxt
                nxt += not clear
                ids[a + r], live[t] = t, (values[a + r], k)
        return g.assign(track=ids)

    return grouped(rows, keys, [frame, value, item], run, "track long")


def smoothing_spline(x: np.ndarray, y: np.ndarray, knots: int = 12, strength: float = 1.0, rounds: int = 8, cut: float = 4.685) -> np.ndarray:
    """Fitted y: a penalised cubic spline (second differences of its coefficients), reweighted by Tukey's biweight."""
    span = max(float(x[-1] - x[0]), 1e-9)
    inner = np.linspace(x[0], x[-1], knots)
    h = span / (knots - 1)
    t = np.concatenate([inner[0] - h * np.arange(3, 0, -1), inner, inner[-1] + h * np.arange(1, 4)])
    basis = np.zeros((len(x), len(t) - 1))
    spot = np.clip(np.searchsorted(t, x, "right") - 1, 3, len(t) - 5)
    basis[np.arange(len(x)), spot] = 1
    for degree in (1, 2, 3):
        left = (x[:, None] - t[None, : -degree - 1]) / (t[degree:-1] - t[: -degree - 1])[None, :]
        right = (t[None, degree + 1 :] - x[:, None]) / (t[degree + 1 :] - t[1:-degree])[None, :]
        basis = left * basis[:, : len(t) - degree - 1] + right * basis[:, 1 : len(t) - degree]
    bend = np.diff(np.eye(basis.shape[1]), 2, axis=0)
    weight, fit = np.ones(len(x)), y
    for _ in range(rounds):
        a = basis.T @ (weight[:, None] * basis) + strength * bend.T @ bend + 1e-9 * np.eye(basis.shape[1])
        fit = basis @ np.linalg.solve(a, basis.T @ (weight * y))
        off = np.abs(y - fit)
        scale = 1.4826 * np.median(off)
        if scale < 1e-12:
            break
        r = off / (cut * scale)
        weight = np.where(r < 1, (1 - r**2) ** 2, 0.0) + 1e-6
    return fit
