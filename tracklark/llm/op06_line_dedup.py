"""Line dedup: line hashes are range-partitioned and sorted by document and position; a stream over each partition keeps the
first document of every key, and only compressed keep bitmaps per document come back, never text.

Defined results: a null or empty text is one empty line; lines whose key has fewer than min_chars code points, and rows without
a doc_id, keep everything; rows that repeat a doc_id are judged each by its own lines (a bitmap belongs to doc_id and the CRC of
the text); an empty table gives an empty table; columns beside doc_id and text pass through apply_bitmaps unchanged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.llm.common import cut, documents, id_and_text, packed, partitions, per_batch, unpacked

WHITE = b" \t\n\x0b\x0c\r"
DECISIONS = "kind int, h1 long, h2 long, doc_id long, slot long"


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row for each line with a long enough key: 128-bit hash, document, and slot (CRC of the text, then line number)."""

    def run(ids: list, texts: list) -> dict:
        h1, h2, doc, slot = [], [], [], []
        for i, text in zip(ids, texts, strict=True):
            data = text.encode()
            crc = (zlib.crc32(data) & 0x7FFFFFFF) << 32
            for k, line in enumerate(data.split(b"\n")):
                key = line.strip(WHITE).lower()
                if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
                    continue
                d = xxhash.xxh3_128_digest(key)
                h1.append(d[:8])
                h2.append(d[8:])
                doc.append(i)
                slot.append(crc + k)
        as_long = lambda x: np.frombuffer(b"".join(x), "<i8")
        return {"h1": as_long(h1), "h2": as_long(h2), "doc_id": doc, "slot": slot}

    rows = id_and_text(docs).filter("doc_id is not null and text != ''")
    return per_batch(rows, "h1 long, h2 long, doc_id long, slot long", run)


def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a partition sorted by hash, document, slot. kind 0: a line to drop. kind 1: a line of the first document of the
    partition's first key, which an earlier partition may hold too. kind 2: the partition's last key and its first document."""
    names = [x.split()[0] for x in DECISIONS.split(", ")]
    key, first, leading, seen = (0, 0), 0, True, False
    for batch in batches:
        h1, h2, doc, slot = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(h1):
            continue
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = not seen or key != (h1[0], h2[0])
        run = np.cumsum(new)
        firsts = np.concatenate([[first], doc[new]])
        mine = firsts[run]
        lead = run <= (0 if seen else 1) if leading else np.zeros(len(h1), bool)
        leading = leading and bool(lead[-1])
        drop, wait = doc != mine, lead & (doc == mine)
        for kind, at in ((0, drop), (1, wait)):
            if at.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(at.sum(), kind, np.int32)), *(pa.array(x[at]) for x in (h1, h2, doc, slot))], names=names)
        key, first, seen = (h1[-1], h2[-1]), mine[-1], True
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (*key, first, 0))], names=names)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, text_crc, n_dropped, keep_bitmap (zlib of packed bits; lines past its end are kept) of documents that lose lines."""
    n = partitions(docs.sparkSession)
    # A key in very many documents is spread over several ranges, as the document is part of the range.
    ranged = line_hashes(docs, min_chars).repartitionByRange(n, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "slot")
    made = cut(ranged.mapInArrow(first_occurrences, DECISIONS))
    # At most one row for each partition.
    tails = made.filter("kind = 2").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    late = made.filter("kind = 1").join(F.broadcast(tails), ["h1", "h2"]).filter("first_doc < doc_id")
    drops = made.filter("kind = 0").select("doc_id", "slot").union(late.select("doc_id", "slot")).distinct()
    by_doc = drops.groupBy("doc_id", F.shiftright("slot", 32).alias("text_crc")).agg(F.collect_list(F.col("slot").bitwiseAND(0xFFFFFFFF)).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for lines in batch.column("lines").to_pylist():
                keep = np.ones(max(lines) // 8 * 8 + 8, bool)  # whole bytes
                keep[lines] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            sizes = [len(x) for x in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_crc"), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "text_crc", "n_dropped", "keep_bitmap"])

    return by_doc.mapInArrow(run, "doc_id long, text_crc long, n_dropped long, keep_bitmap binary")


def kept_lines(text: str, bitmap: bytes | None) -> str:
    if bitmap is None:
        return text
    lines = text.split("\n")
    keep = np.ones(len(lines), bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)].astype(bool)
    keep[: len(bits)] = bits
    return "\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def with_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with the columns _keep and _dropped of their bitmaps (null: nothing to drop)."""
    maps = keep_bitmaps(docs, min_chars).select(F.col("doc_id").alias("_id"), F.col("text_crc").alias("_crc"), F.col("keep_bitmap").alias("_keep"), F.col("n_dropped").alias("_dropped"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).bitwiseAND(0x7FFFFFFF)
    return docs.withColumn("_row_crc", crc).join(maps, (F.col("doc_id") == F.col("_id")) & (F.col("_row_crc") == F.col("_crc")), "left").drop("_row_crc", "_id", "_crc")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with the repeated lines gone from text; rows without repeated lines keep their text (null stays null)."""

    @F.pandas_udf("string")
    def rewrite(text, keep):
        return text.combine(keep, kept_lines)

    joined = with_bitmaps(packed(docs, "doc_id", "text"), min_chars)
    text = F.when(F.col("_keep").isNull(), F.col("text")).otherwise(rewrite(F.coalesce("text", F.lit("")), "_keep"))
    return unpacked(joined, docs, text=text)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = with_bitmaps(id_and_text(documents(spark, sf_dir)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, keep = batch.column("text").to_pylist(), batch.column("_keep").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([t.count("\n") + 1 for t in text], pa.int64()),
                    batch.column("_dropped").fill_null(0),
                    pa.array([hashlib.sha256(kept_lines(t, k).encode()).hexdigest() for t, k in zip(text, keep, strict=True)]),
                ],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return joined.select("doc_id", "text", "_keep", "_dropped").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {
    "op6_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (first_doc < doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first_doc IS NULL OR first_doc >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (k) GROUP BY doc_id
""",
}
