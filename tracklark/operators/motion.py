"""Moving positions: headings, speeds, transition checks, pose sections and passes."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.functions.scalars import bearing_of
from tracklark.operators.folds import grouped


def with_motion(rows: DataFrame, keys: list[str], time: str, tie: str, east: str, north: str) -> DataFrame:
    """rows with step (metres), dt, implied speed (null over no time) and motion_heading from the row before to the one after (at
    the ends: to or from the row itself)."""
    w = W.partitionBy(*keys).orderBy(time, tie)
    before = lambda c: F.lag(c).over(w)
    after = lambda c: F.lead(c).over(w)
    step = F.hypot(F.col(east) - before(east), F.col(north) - before(north))
    dt = F.col(time) - before(time)
    turn = bearing_of(F.coalesce(after(east), F.col(east)) - F.coalesce(before(east), F.col(east)), F.coalesce(after(north), F.col(north)) - F.coalesce(before(north), F.col(north)))
    return rows.withColumns({"step": step, "dt": dt, "speed": F.when(dt > 0, step / dt), "motion_heading": turn})


def choose_heading(rows: DataFrame, keys: list[str], time: str, tie: str, reported: str, speed: str, least_speed: float) -> DataFrame:
    """heading and heading_source: the reported one at speed, else that of the motion, else the last one chosen before."""
    own = F.when(F.col(reported).isNotNull() & (F.col(speed) >= least_speed), F.struct(F.col(reported).cast("double").alias("h"), F.lit("reported").alias("s")))
    moved = F.when(F.col("motion_heading").isNotNull(), F.struct(F.col("motion_heading").alias("h"), F.lit("motion").alias("s")))
    rows = rows.withColumn("_own", F.coalesce(own, moved))
    last = F.last("_own", True).over(W.partitionBy(*keys).orderBy(time, tie).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_last", last).withColumns({"heading": F.coalesce("_own.h", "_last.h"), "heading_source": F.coalesce(F.col("_own.s"), F.when(F.col("_last").isNotNull(), "fallback"))}).drop("_own", "_last")


def pose_sections(rows: DataFrame, keys: list[str], time: str, tie: str, east: str, north: str, most_gap: float, most_speed: float, factor: float) -> DataFrame:
    """rows with section and reason: a new section where the time gap, the speed, or the step against the median of the last five
    accepted speeds is too large; the history restarts there."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t, e, n = (g[c].to_numpy(float) for c in (time, east, north))
        section, reasons, now = np.zeros(len(g), np.int64), [None] * len(g), 0
        history: deque[float] = deque(maxlen=5)
        for i in range(1, len(g)):
            dt = t[i] - t[i - 1]
            speed = np.hypot(e[i] - e[i - 1], n[i] - n[i - 1]) / max(dt, 1e-6)
            usual = float(np.median(history)) if history else None
            reason = "timeGap" if dt > most_gap else "speed" if speed > most_speed else "jump" if usual is not None and speed > factor * max(usual, 1.0) else None
            if reason:
                now, reasons[i] = now + 1, reason
                history.clear()
            else:
                history.append(speed)
            section[i] = now
        return g.assign(section=section, reason=reasons)

    return grouped(rows, keys, [time, tie], run, "section long, reason string")


def passes(rows: DataFrame, keys: list[str], time: str, order: str, east: str, north: str, radius: float, least_gap: float, sharp: float = 120.0) -> DataFrame:
    """rows, in the order of `order`, with pass_id and reason: a new pass at a sharp turn, a step back in time, or a return within radius of a point of this pass
    that lies at least least_gap metres back along it. The look-back uses a grid, so it costs the points near by, not all before."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t, e, n = (g[c].to_numpy(float) for c in (time, east, north))
        out, reasons, now, s, heading = np.zeros(len(g), np.int64), [None] * len(g), 0, 0.0, None
        grid: dict[tuple[int, int], list[tuple[float, float, float]]] = {}
        for i in range(len(g)):
            reason = None
            if i:
                de, dn = e[i] - e[i - 1], n[i] - n[i - 1]
                length = float(np.hypot(de, dn))
                turn = np.degrees(np.arctan2(de, dn)) if length > 1e-6 else heading
                if t[i] < t[i - 1]:
                    reason = "backwardTime"
                elif heading is not None and turn is not None and abs((turn - heading + 180) % 360 - 180) > sharp:
                    reason = "sharpTurn"
                else:
                    x, y = int(e[i] // radius), int(n[i] // radius)
                    near = (p for a in (x - 1, x, x + 1) for b in (y - 1, y, y + 1) for p in grid.get((a, b), ()))
                    if any(s + length - q >= least_gap and np.hypot(e[i] - u, n[i] - v) <= radius for u, v, q in near):
                        reason = "revisit"
                s, heading = s + length, turn
            if reason:
                now, s, heading, reasons[i] = now + 1, 0.0, None, reason
                grid = {}
            grid.setdefault((int(e[i] // radius), int(n[i] // radius)), []).append((e[i], n[i], s))
            out[i] = now
        return g.assign(pass_id=out, reason=reasons)

    return grouped(rows, keys, [order], run, "pass_id long, reason string")
