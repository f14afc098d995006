"""Streaming forms of the sessionizer and the hysteresis: state per key, closed by watermark timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSIONS = "user_id long, first_t long, last_t long, n_events long, cents long"


def stream_sessions(rows: DataFrame, gap: int, lateness: str) -> DataFrame:
    """SESSIONS of a stream of (user_id, ts, t, cents): gaps of more than `gap` microseconds end a session. A session is put out once
    the watermark has passed its last row by more than gap; rows behind the watermark are dropped by Spark."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = [tuple(x) for x in state.get[0]] if state.exists else []
        for pdf in parts:
            open_ += [(t, t, 1, c) for t, c in zip(pdf["t"].tolist(), pdf["cents"].tolist(), strict=True)]
        merged: list[tuple] = []
        for a, b, n, c in sorted(open_):
            if merged and a - merged[-1][1] <= gap:
                x = merged[-1]
                merged[-1] = (x[0], max(x[1], b), x[2] + n, x[3] + c)
            else:
                merged.append((a, b, n, c))
        mark = state.getCurrentWatermarkMs() * 1000
        done = [x for x in merged if x[1] + gap < mark]
        rest = [x for x in merged if x[1] + gap >= mark]
        if done:
            yield pd.DataFrame([(key[0], *x) for x in done], columns=["user_id", "first_t", "last_t", "n_events", "cents"])
        if rest:
            state.update(([list(x) for x in rest],))
            state.setTimeoutTimestamp(max(min(x[1] for x in rest) // 1000 + gap // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()

    marked = rows.withWatermark("ts", lateness)
    return marked.groupBy("user_id").applyInPandasWithState(step, SESSIONS, "open array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_hysteresis(rows: DataFrame, need: dict[str, int], default: int = 2) -> DataFrame:
    """user_id, event_id, state of a stream of (user_id, t, event_id, instant) whose rows come in order per user."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last, streak = state.get if state.exists else (None, None, 0)
        out = []
        for row in pd.concat(parts).sort_values(["t", "event_id"]).itertuples():
            streak = streak + 1 if row.instant == last else 1
            last = row.instant
            if not out and not state.exists or streak >= need.get(last, default):
                now = last
            out.append((key[0], row.event_id, now))
        state.update((now, last, streak))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "state"])

    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, state string", "now string, last string, streak int", "append", GroupStateTimeout.NoTimeout)
