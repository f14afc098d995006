"""Packing: shortest-pack-first over the histogram of piece lengths. Lengths are placed longest first, each on the open pattern
that is filled least, and only the patterns' counts are updated; a new sequence begins when even that one has no room. Documents
then join the patterns by the rank of their piece among those of its length.

A document's ids are cut into full sequences and a rest; only the rests are packed. The histogram has at most `room` entries and
the patterns a few thousand slots, whatever the number of documents, so both fit the driver. Ranks are counted within shares of
a length, as many as its count asks for; the driver gets one row for each, one for about SHARE_ROWS pieces.

Defined results: a null or empty text is the closing id alone; rows that repeat a doc_id are packed each on its own; a special
string in a text is its special id, as the tokenizer's default has it; an empty table gives an empty table; columns beside doc_id
and text do not matter. Sequence ids are dense from 0 and the same in every run for the same rows.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.llm.bpe import load_ranks, splitter
from tracklark.llm.common import cut, documents, id_and_text, per_batch
from tracklark.llm.pieces import differ, named, split

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces of one length that are ranked together.
SHARE_ROWS = 1 << 18
_encoders: dict[tuple, "Ids"] = {}


class Ids:
    """Token ids of whole texts; the ids of each distinct piece are worked out once while they stay in the table."""

    def __init__(self, ranks_path: str, json_path: str, most: int = 500_000):
        self.pattern, self.most, self.json_path, self.tokenizer = splitter(public_tokenizers.PATTERN), most, json_path, None
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        self.encode = encoding._core_bpe.encode_single_piece
        with open(json_path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def slow(self, text: str) -> np.ndarray:
        """For texts with a special string, and those with a piece that shares its hash with another one: the tokenizer itself."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.json_path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        special = {i: self.slow(t) for i, t in enumerate(texts) if any(x in t for x in self.special)}
        data, offsets, first = split([("" if i in special else t) for i, t in enumerate(texts)], self.pattern)
        _, at, which = np.unique(named(data, offsets), return_index=True, return_inverse=True)
        for i in np.unique(np.searchsorted(first, differ(data, offsets, at[which]), "right") - 1).tolist():
            special[i] = self.slow(texts[i])
        if len(self.place) + len(at) > self.most:
            self.clear()
        keys, place, more = [data[offsets[i] : offsets[i + 1]] for i in at.tolist()], self.place, []
        for k in keys:
            if k not in place:
                place[k] = len(place)
                more.append(self.encode(k))
        if more:
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in more])])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(more), np.uint32)])
        rows = np.fromiter(map(place.__getitem__, keys), np.int64, len(keys))[which] if keys else np.zeros(0, np.int64)
        count = self.begin[rows + 1] - self.begin[rows]
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(self.begin[rows] - ends[:-1], count) + np.arange(ends[-1])]
        return [special[i] if i in special else flat[ends[first[i]] : ends[first[i + 1]]] for i in range(len(texts))]


def pieces(docs: DataFrame, ranks_path: str, json_path: str, room: int, closing: int = 0) -> DataFrame:
    """PIECES: the ids of every text and the closing id, cut every room ids."""

    def run(ids: list, texts: list) -> dict:
        key = (ranks_path, json_path)
        if key not in _encoders:
            _encoders[key] = Ids(*key)
        out: dict[str, list] = {x.split()[0]: [] for x in PIECES.split(", ")}
        for i, x in zip(ids, _encoders[key].of_texts(texts), strict=True):
            data, n = np.append(x, np.uint32(closing)).astype("<u4").tobytes(), len(x) + 1
            for a in range(0, n, room):
                b = min(n, a + room)
                for c, v in zip(out, (i, a, b - a, zlib.crc32(data[4 * a : 4 * b]), n), strict=True):
                    out[c].append(v)
        return out

    return per_batch(id_and_text(docs), PIECES, run)


def patterns(histogram: dict[int, int], room: int) -> list[tuple[list[int], int]]:
    """(lengths, count): how often which lengths share a sequence. The packs are those of placing pieces one by one, longest first,
    each on the pack filled least; a pack that is alone in having room takes as many of the length as it can."""
    open_: dict[int, list[tuple[list[int], int]]] = {}  # room left -> patterns
    most_room: list[int] = []  # negated
    done: list[tuple[list[int], int]] = []

    def add(lengths: list[int], count: int) -> None:
        free = room - sum(lengths)
        if not free:
            done.append((lengths, count))
            return
        if free not in open_:
            open_[free] = []
            heapq.heappush(most_room, -free)
        open_[free].append((lengths, count))

    for n in sorted(histogram, reverse=True):
        need = histogram[n]
        while need and most_room and -most_room[0] >= n:
            free = -most_room[0]
            lengths, count = open_[free].pop()
            if not open_[free]:
                del open_[free]
                heapq.heappop(most_room)
            take = min(need, count)
            if count > take:
                add(lengths, count - take)
            add([*lengths, n], take)
            need -= take
        each = room // n
        for size, count in ((each, need // each), (need % each, 1)):
            if size and count:
                add([n] * size, count)
    return done + [x for some in open_.values() for x in some]


def slots(histogram: dict[int, int], room: int) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence id, offset, ids' stride) of its slots, by first rank."""
    out: dict[int, list] = {}
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    at = 0
    for lengths, count in patterns(histogram, room):
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((used[n], at, offset))
            used[n] += count
            offset += n
        at += count
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in out.items()}


def pack(docs: DataFrame, ranks_path: str, json_path: str, room: int = 1024, closing: int = 0) -> DataFrame:
    """PIECES with sequence_id and offset."""
    rows = cut(pieces(docs, ranks_path, json_path, room, closing))
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most room rows
    shares = docs.sparkSession.createDataFrame([(n, -(-c // SHARE_ROWS)) for n, c in histogram.items()], "length long, shares long")
    rows = rows.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("shares"))).drop("shares")
    before: dict[tuple[int, int], int] = {}
    seen = dict.fromkeys(histogram, 0)
    for r in rows.groupBy("length", "share").count().orderBy("length", "share").collect():  # one for about SHARE_ROWS pieces
        before[r["length"], r["share"]] = seen[r["length"]]
        seen[r["length"]] += r["count"]
    plan = docs.sparkSession.sparkContext.broadcast((slots(histogram, room), before))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, first = plan.value
        for b in batches:
            length, share, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "share", "rank"))
            rank = rank + np.array([first[k] for k in zip(length.tolist(), share.tolist(), strict=True)], np.int64)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                of_n = np.flatnonzero(length == n)
                begin, ids, offsets = where[int(n)]
                k = np.searchsorted(begin, rank[of_n], "right") - 1
                sequence[of_n], offset[of_n] = ids[k] + rank[of_n] - begin[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*(b.column(x.split()[0]) for x in PIECES.split(", ")), pa.array(sequence), pa.array(offset)], names=[*(x.split()[0] for x in PIECES.split(", ")), "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def op10_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_histogram_packing": op10_histogram_packing}
SQL: dict[str, str] = {}
