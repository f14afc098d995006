"""Ranked lexical search by dual-sorted wavelet trees, one for each shard of documents.

A shard's posting lists stand one after another, each ordered by falling impact, and the documents' numbers in them form a wavelet
tree: going down a level splits every range by one bit of the number and keeps the order by impact. So a list is read by impact at
the root and by document at the leaves, and the first entry of a range has the highest impact under that node. The sum of these over
a query's terms bounds every document below, and at a leaf it is the score. A search keeps a frontier of nodes, expands the best of
them first, and ends when no bound reaches the k-th best leaf; all leaves that tie with it have been reached by then. The result is
the exact top k.

One pass over the texts gives the postings of the terms that are asked for, and a header row for each document; both counts that
the scores need and each term's weight come from that table. Documents are dealt to shards by a number of their own, so one source
or one frequent term spreads over all; a shard is bounded by its postings. Items are dealt to blocks, a pair of a block and a shard
is one task's group, and the best of each shard are merged. The vocabulary is broadcast while its bytes are few and joined beyond.

Defined results: a null or empty text has no terms; every row of the documents is a document of its own, so a doc_id that stands
twice can be listed twice; rows without a doc_id count in the statistics but are not listed; items with one id and different texts
are ranked each by itself, equal rows once; items without an id or without terms that any document holds have no rows; ties go to
the smaller doc_id; an empty table on either side gives an empty table; further columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.llm.common import cut, documents

#: Postings of a shard, items of a block, and nodes that are expanded at a time.
SHARD_POSTINGS, BLOCK_ITEMS, STEP_NODES = 1 << 20, 1024, 128
#: Largest vocabulary that is broadcast, in bytes of its terms.
BROADCAST_BYTES = 1 << 23
#: Rows of an Arrow batch of counted terms.
BATCH_ROWS = 1 << 16
#: Letters and digits stay, A-Z lower-cased, other ASCII bytes become spaces; bytes from 128 on belong to other letters and stay.
TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode(errors="surrogatepass").translate(TABLE).split()


def counted(texts: DataFrame, id_name: str) -> DataFrame:
    """uid (one for each row), id, n, term, tf: a row for each distinct term, and one with an empty term for each row that has any.

    uid joins the task's number with a count inside it, so it differs between rows however the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        uids: list[int] = []
        ids: list = []
        ns: list[int] = []
        names: list[bytes] = []
        tfs: list[int] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())], names=["uid", "id", "n", "term", "tf"])
            for x in (uids, ids, ns, names, tfs):
                x.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(text.as_py())
                if not found:
                    continue
                tf = Counter(found)
                k = len(tf) + 1
                uids += [uid] * k
                ids += [key] * k
                ns += [len(found)] * k
                names += [b"", *tf]
                tfs += [1, *tf.values()]
                uid += 1
                if len(uids) >= BATCH_ROWS:
                    yield flush()
        if uids:
            yield flush()

    return texts.select(F.col(id_name).cast("long").alias("id"), F.col("text")).mapInArrow(run, "uid long, id long, n long, term string, tf long")


class WaveletTree:
    """Posting lists of one shard. docs: a document's number for each posting, lists one after another, by falling impact in each."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
        self.depth = max(1, int(n_docs - 1).bit_length())
        n = len(docs)
        # ones[l, i]: postings among the first i of level l whose bit is set; zeros stand before ones on the next level.
        self.ones = np.zeros((self.depth, n + 1), np.int32)
        self.zeros = np.zeros(self.depth, np.int64)
        # One more column, read where a range is empty.
        self.impacts = np.zeros((self.depth + 1, n + 1), np.int32)
        self.impacts[0, :n] = impacts
        for level in range(self.depth):
            bit = (docs >> (self.depth - 1 - level)) & 1
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = n - self.ones[level, n]
            order = np.argsort(bit, kind="stable")
            docs = docs[order]
            self.impacts[level + 1, :n] = self.impacts[level, :n][order]

    def children(self, levels: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ranges (nodes x terms) of both children of each node."""
        a, b = self.ones[levels[:, None], low], self.ones[levels[:, None], high]
        z = self.zeros[levels][:, None]
        return (low - a, high - b), (a + z, b + z)

    def top(self, low: np.ndarray, high: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, document's number) of the k best for the lists [low, high) under weights, and all that tie with the k-th."""
        levels, nodes = np.zeros(1, np.int64), np.zeros(1, np.int64)
        low, high, bounds = low[None].astype(np.int64), high[None].astype(np.int64), np.full(1, np.iinfo(np.int64).max)
        scores, found, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        while len(levels):
            # The best nodes of the frontier first.
            pick = np.argpartition(-bounds, STEP_NODES)[:STEP_NODES] if len(bounds) > STEP_NODES else np.arange(len(bounds))
            rest = np.ones(len(bounds), bool)
            rest[pick] = False
            parts = []
            for bit, (a, b) in enumerate(self.children(levels[pick], low[pick], high[pick])):
                below = levels[pick] + 1
                bound = np.where(b > a, self.impacts[below[:, None], a], 0).astype(np.int64) @ weights
                parts.append((below, nodes[pick] * 2 + bit, a, b, bound))
            levels_, nodes_, low_, high_, bounds_ = (np.concatenate([x, y]) for x, y in zip(*parts, strict=True))
            leaf = levels_ == self.depth
            scores, found = np.concatenate([scores, bounds_[leaf]]), np.concatenate([found, nodes_[leaf]])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= least
                scores, found = scores[keep], found[keep]
            new, old = ~leaf & (bounds_ >= least), rest & (bounds >= least)
            levels, nodes, low, high, bounds = (np.concatenate([x[old], y[new]]) for x, y in ((levels, levels_), (nodes, nodes_), (low, low_), (high, high_), (bounds, bounds_)))
        keep = scores >= least
        return list(zip(scores[keep].tolist(), found[keep].tolist(), strict=True))


def searched(postings: pa.Table, items: pa.Table, k: int, n_docs: int, n_terms: int) -> pa.Table:
    """The k best of one shard for the items of one block. postings: uid, id, n, tid, tf; items: item, tid, weight."""
    out: dict[str, list] = {"item": [], "doc_id": [], "score": []}
    if postings.num_rows and items.num_rows:
        column = lambda t, c: t.column(c).to_numpy()
        uid, ids, n, tid, tf = (column(postings, c) for c in ("uid", "id", "n", "tid", "tf"))
        # Documents are numbered by doc_id, repeated ids by uid.
        order = np.lexsort((uid, ids))
        first = np.concatenate([[True], (np.diff(uid[order]) != 0)])
        number = np.empty(len(uid), np.int64)
        number[order] = np.cumsum(first) - 1
        names = ids[order][first]
        m = 75 + 25 * n * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m)
        at = np.lexsort((number, -impact, tid))
        tree = WaveletTree(number[at], impact[at], len(names))
        lists, starts = np.unique(tid[at], return_index=True)
        ends = np.append(starts[1:], len(at))
        item, asked, weight = (column(items, c) for c in ("item", "tid", "weight"))
        place = np.searchsorted(lists, asked)
        held = (place < len(lists)) & (lists[np.minimum(place, len(lists) - 1)] == asked)
        by_item = np.argsort(item[held], kind="stable")
        item, place, weight = item[held][by_item], place[held][by_item], weight[held][by_item]
        for one in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1) if len(item) else []:
            best = sorted(((-s, int(names[d])) for s, d in tree.top(starts[place[one]], ends[place[one]], weight[one], k)))[:k]
            out["item"] += [int(item[one[0]])] * len(best)
            out["doc_id"] += [d for _, d in best]
            out["score"] += [-s for s, _ in best]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null").distinct()
    wanted = cut(counted(asked, "item_id").filter("term != ''"))
    vocabulary = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("items"))
    # A dense number for each term: its place among all terms of its hash part, and the part. The header's is -1.
    parts = 64
    own = vocabulary.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    numbered = own.select("term", ((F.row_number().over(W.partitionBy("part").orderBy("term")) - 1) * parts + F.col("part")).cast("long").alias("tid"))
    known = cut(numbered.union(spark.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("tid"))))
    size = known.agg(F.sum(F.octet_length("term") + 8)).first()[0]
    side = F.broadcast(known) if size <= BROADCAST_BYTES else known
    held = cut(counted(docs, "doc_id").join(side, "term").select("uid", "id", "n", "tid", "tf"))
    per_term = cut(held.groupBy("tid").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("tid") == -1, F.col("n"))).alias("length")))
    # Three numbers for the whole table.
    n_docs, n_terms, n_postings = per_term.agg(F.max(F.when(F.col("tid") == -1, F.col("df"))), F.max("length"), F.sum(F.when(F.col("tid") >= 0, F.col("df")))).first()
    n_docs, n_terms, n_postings = n_docs or 0, n_terms or 1, n_postings or 0
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = known.join(per_term.filter("tid >= 0").select("tid", weight.alias("w")).filter("w > 0"), "tid")
    shards = max(1, -(-n_postings // SHARD_POSTINGS))
    rows = cut(wanted.join(weighted, "term").select(F.col("uid").alias("item"), F.col("id").alias("item_id"), "tid", (F.col("w") * F.col("tf")).alias("weight")))
    blocks = max(1, -(-rows.select("item").distinct().count() // BLOCK_ITEMS))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.filter("tid >= 0 and id is not null").withColumn("shard", deal("uid", shards)).withColumn("block", each(blocks))
    right = rows.select("item", "tid", "weight").withColumn("block", deal("item", blocks)).withColumn("shard", each(shards))

    def search(postings: pa.Table, block: pa.Table) -> pa.Table:
        return searched(postings, block, k, n_docs, n_terms)

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(search, "item long, doc_id long, score long")
    best = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.join(rows.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def op12_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = {
    "op12_wavelet_search": f"""
WITH q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {_TERMS} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::bigint AS n FROM p GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::bigint AS n_terms FROM len),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
scored AS (
  SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN len USING (doc_id), total GROUP BY item_id, doc_id
)
SELECT item_id, rank::int AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""
}
QUERIES = {"op12_wavelet_search": op12_wavelet_search}
