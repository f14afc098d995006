"""Folds along a key whose state is small: the key is cut into ranges of the order, so that a hot one spreads over many tasks.

Rows are dealt to ranges of (keys, order) once. Each range is streamed in order with the state alone in memory, first as if its first
key began there, and what comes of it is written. A range whose first key goes on from the range before gets that range's last state, and
only the rows of that key are streamed again; where a range holds no other key, its own last state may change by this, and the next one
begins anew. When no range begins with another state than the one before it ended with, all ranges hold what one pass over the key would
give. Most folds forget: then two rounds do. The driver sees one row for each range: its first and last key and its last state. A state
should name rows by their own values, not by counts from the key's start, which never forget.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracklark.sources.scratch import saved

#: (rows of one key in order, state before or None at the key's start) -> (columns to add, state after as a list)
Step = Callable[[pd.DataFrame, list | None], tuple[dict[str, np.ndarray], list | None]]


def ranged(rows: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """rows, dealt to as many ranges of (keys, order); what is grouped by these afterwards stays where it is."""
    return rows.repartitionByRange(ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys, *order)


def carried(rows: DataFrame, keys: list[str], order: list[str], step: Step, more: str, ranges: int | None = None, handed: Callable[[list | None], list | None] | None = None, dealt: bool = False) -> DataFrame:
    """rows with the columns `more` (a DDL string) that step gives them. step is called for consecutive stretches of a key's rows, and must
    not depend on where they are cut; its state must be plain numbers, strings or nulls. handed: what a range hands to the next one of its state,
    where that is less than it carries itself. dealt: rows come from ranged() with the same keys and order, and no shuffle since. Rows
    that are equal in keys and order come in any order."""
    fields = [*rows.schema.fields, *T._parse_datatype_string(more).fields]
    marks = T._parse_datatype_string("_part int, _first boolean, _end string").fields
    names, added = [f.name for f in fields], T._parse_datatype_string(more).fieldNames()
    told = lambda state: json.dumps(handed(state) if handed else state)

    def streamed(begins: dict[int, str], ends_alone: bool):
        """Rows with the new columns and marks (_end: on the last row, of a task that holds one range), or the ranges' last states alone."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, first, key, state, held = None, None, None, None, None
            for b in batches:
                if not len(b):
                    continue
                at = b[["_part", *keys]]
                same = (at == at.shift()) | (at.isna() & at.shift().isna())
                starts = np.flatnonzero(~same.all(axis=1).to_numpy() | (np.arange(len(b)) == 0))
                outs: dict[str, list] = {c: [] for c in added}
                firsts: list[bool] = []
                for a, z in zip(starts, np.append(starts[1:], len(b)), strict=True):
                    g = b.iloc[a:z]
                    p, k = int(g["_part"].iloc[0]), repr([g[c].iloc[0] for c in keys])
                    if p != part:
                        if part is not None and ends_alone:
                            yield pd.DataFrame({"part": [part], "state": [told(state)]})
                        part, first, state = p, k, json.loads(begins.get(p, "null"))
                    elif k != key:
                        state = None
                    key = k
                    new, state = step(g, state)
                    if not ends_alone:
                        firsts.extend([k == first] * int(z - a))
                        for c in added:
                            outs[c].extend(new[c])
                if not ends_alone:
                    if held is not None:
                        yield held
                    held = b.assign(**outs, _first=firsts, _end=None)[[*names, *(f.name for f in marks)]]
            if part is not None and ends_alone:
                yield pd.DataFrame({"part": [part], "state": [told(state)]})
            if held is not None:
                held.loc[held.index[-1], "_end"] = json.dumps([first, key, told(state)])
                yield held

        return run

    def again(parts: list[int]) -> DataFrame:
        some = done.filter(F.col("_first") & F.col("_part").isin(parts)).select(*rows.columns, "_part")
        return some.repartition(len(parts), "_part").sortWithinPartitions("_part", *keys, *order)

    parts = (rows if dealt else ranged(rows, keys, order, ranges)).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*keys, *order)
    done = saved(parts.mapInPandas(streamed({}, False), T.StructType([*fields, *marks])))
    ends: dict[int, list] = {r["_part"]: json.loads(r["_end"]) for r in done.filter("_end is not null").select("_part", "_end").collect()}
    begins: dict[int, str] = {}
    while True:
        inside = sorted(ends)
        wanted = {b: ends[a][2] for a, b in zip(inside, inside[1:]) if ends[a][1] == ends[b][0] and ends[a][2] != "null"}
        todo = [p for p in inside if wanted.get(p) != begins.get(p) and ends[p][0] == ends[p][1]]
        begins = wanted
        if not todo:
            break
        for r in again(todo).mapInPandas(streamed(begins, True), "part int, state string").collect():
            ends[r["part"]][2] = r["state"]
    if not begins:
        return done.select(*names)
    taken = list(begins)
    anew = saved(again(taken).mapInPandas(streamed(begins, False), T.StructType([*fields, *marks])).select(*names))
    return done.filter(~(F.col("_first") & F.col("_part").isin(taken))).select(*names).unionByName(anew)


def by_key(rows: DataFrame, keys: list[str], order: list[str], uses: list[str], f: Callable[..., list[list]], more: T.StructType, light: bool = False) -> DataFrame:
    """rows with the columns `more` that f gives for each key from the lists of the columns `uses`, in order (nulls last, as None).

    A key is one task's, as a whole; keys are streamed in Arrow batches of many keys, as to start a group of its own for each would
    cost more than most keys' work. Columns that f does not use pass through untouched. light: f costs less than a task's start, so Spark may
    merge small parts."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    types = [x.type for x in to_arrow_schema(more)]

    def first_rows(b: pa.RecordBatch) -> tuple[list[int], list[tuple]]:
        at = list(zip(*(["nan" if x != x else x for x in b.column(k).to_pylist()] for k in keys), strict=True))
        return [i for i in range(len(at)) if i == 0 or at[i] != at[i - 1]], at

    def added(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
        starts, _ = first_rows(b)
        columns = [b.column(c).to_pylist() for c in uses]
        outs: list[list] = [[] for _ in types]
        for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
            for out, new in zip(outs, f(*(c[a:z] for c in columns)), strict=True):
                out.extend(new)
        arrays = [pa.array(x, kind, from_pandas=False) for x, kind in zip(outs, types, strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *more.fieldNames()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of keys that may go on
        key: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            starts, at = first_rows(b)
            if held and at[0] != key:
                yield from added(held)
                held = []
            if starts[-1]:
                yield from added([*held, b.slice(0, starts[-1])])
                held = []
            held.append(b.slice(starts[-1]))
            key = at[-1]
        if held:
            yield from added(held)

    dealt = (rows.repartition(*keys) if light else rows.repartition(n, *keys)).sortWithinPartitions(*keys, *(F.asc_nulls_last(c) for c in order))
    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields, *more.fields]))


def last_along(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, before: bool = False) -> DataFrame:
    """rows with name: the last value that is not null along the key, up to the row, or before it. The window runs inside ranges of the
    order; what a range takes over comes from one row for each range and key, so a hot key is no single task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = saved(rows.withColumn(name, value).repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    own = F.last(name, True).over(W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0))
    known = F.when(F.col(name).isNotNull(), F.struct(*order, name))
    ends = parts.groupBy("_part", *keys).agg(F.max(known)[name].alias("_end"))
    taken = F.last("_end", True).over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("_part", *keys, taken.alias("_taken")).filter("_taken is not null")
    found = alike(parts.withColumn("_own", own), ends, ["_part", *keys])
    return found.select(*(c for c in rows.columns if c != name), F.coalesce("_own", "_taken").alias(name))


def alike(rows: DataFrame, more: DataFrame, names: list[str]) -> DataFrame:
    """rows with the other columns of more, which has one row at most for each value of names; nulls are equal."""
    own = [f"_at{i}" for i in range(len(names))]
    right = more.select(*(F.col(c).alias(o) for c, o in zip(names, own, strict=True)), *(c for c in more.columns if c not in names))
    on = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(names, own, strict=True)]
    return rows.join(right, on, "left").drop(*own)


def pieces(rows: DataFrame, keys: list[str], order: list[str], s: str, gap: float, name: str = "piece") -> DataFrame:
    """rows with name: the s at which the row's piece begins; a new piece begins more than gap after the row before. order begins with s."""
    near = last_along(rows, keys, order, F.col(s), "_s", before=True)
    starts = F.when(F.col("_s").isNull() | (F.col(s) - F.col("_s") > gap), F.col(s))
    return last_along(near, keys, order, starts, name).drop("_s")
