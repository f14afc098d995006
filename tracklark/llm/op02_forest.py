"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long string of hash bits (signs of random projections); a tree is the sorted array of these
strings. A query descends every tree to its longest prefix match by binary search, and then ascends all trees at once, one bit
at a time, until the ranges under its prefixes hold enough candidates; these are ranked by their exact cosine.

Equal vectors are collapsed first: a class keeps its k + 1 smallest ids, all that a result of k can show, so a hot vector is one
entry. Vectors are dealt to shards of bounded size, each with a forest of its own over all its rows, and queries to blocks; a
pair of a block and a shard is one task's group, and the best of each shard are merged. A forest is built once for a block of
BLOCK_ROWS queries, so with n rows of which one in 50 asks, n / 1.6 million copies of the index and n / 8,192 of the queries
move. The number of candidates is a share of the shard: without structure in the vectors, recall is what the share buys.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components take no part; only vectors of equal
dimension are compared; repeated rows of an id count once; ties go to the smaller vec_id; an empty table gives an empty table;
further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.llm.common import cut

#: Trees, hash bits of each, vectors in a shard and queries in a block, and the share of a shard that are candidates.
TREES, BITS, SHARD_ROWS, BLOCK_ROWS, SHARE = 48, 32, 8192, 32768, 0.45
#: Queries of a block that are searched at a time.
STEP_ROWS = 1024
LEAST_CANDIDATES = 256
#: Ids of a class are gathered in this many shares first.
SALTS = 64


class Forest:
    """Sorted arrays of hash strings over the rows of x (float64, no zero rows)."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 7):
        self.x = x / np.linalg.norm(x, axis=1)[:, None]
        self.planes = np.random.default_rng(seed).standard_normal((trees, x.shape[1], bits))
        self.bits = bits
        codes = self.codes(self.x)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        weights = (np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)).astype(np.float64)
        return np.stack([((x @ p > 0) @ weights).astype(np.int64) for p in self.planes])

    def ranges(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query the range of the sorted array that shares the first level bits."""
        shift = self.bits - level
        low = codes >> shift << shift
        at = [(np.searchsorted(s, a, "left"), np.searchsorted(s, a + (1 << shift), "left")) for s, a in zip(self.sorted, low, strict=True)]
        return np.stack([a for a, _ in at]), np.stack([b for _, b in at])

    def candidates(self, q: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """Per query, sorted rows: those under its prefixes of the longest length at which all trees together hold least."""
        codes, need = self.codes(q), min(least, len(self.x))
        marks = np.zeros((len(q), len(self.x)), bool)
        waiting = np.arange(len(q))
        done_low = done_high = None
        for level in range(self.bits, -1, -1):
            low, high = self.ranges(codes[:, waiting], level)
            for t in range(len(self.sorted)):
                for k, i in enumerate(waiting):
                    a, b = low[t, k], high[t, k]
                    # Only what the ascent has added.
                    if done_low is None:
                        if b > a:
                            marks[i, self.order[t, a:b]] = True
                    elif b - a > done_high[t, k] - done_low[t, k]:
                        marks[i, self.order[t, a : done_low[t, k]]] = True
                        marks[i, self.order[t, done_high[t, k] : b]] = True
            left = marks[waiting].sum(1) < need
            waiting, done_low, done_high = waiting[left], low[:, left], high[:, left]
            if not len(waiting):
                break
        for row in marks:
            yield np.flatnonzero(row)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """key (the vector), dim, ids (the k + 1 smallest, ascending) of the usable vectors."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    plain = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))  # -0.0 and 0.0 are equal
    good = rows.filter("vec_id is not null and embedding is not null").filter(~bad & F.exists("embedding", lambda v: v != 0))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("key"))

    # Smallest ids of each salt of a class, then of the class: never more than (k + 1) * SALTS in one group.
    salted = good.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).distinct()
    first = salted.withColumn("r", F.row_number().over(W.partitionBy("key", "salt").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    return first.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.size("key").alias("dim"))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score. rows: vec_id, embedding; is_query: a condition on vec_id."""
    known = cut(classes(rows.select("vec_id", "embedding"), k).withColumn("class_id", F.get("ids", F.lit(0))))
    usable = rows.filter(is_query).select(F.col("vec_id").cast("long").alias("query_id"), F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("key")).distinct()
    queries = cut(usable.join(known.select("key", "class_id", "dim"), "key").select("query_id", "class_id", "dim"))
    # A class is searched once for all its queries.
    searched = known.join(queries.select("class_id").distinct(), "class_id", "left_semi")
    n, m = known.count(), searched.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_ROWS))
    left = known.withColumn("shard", F.pmod(F.xxhash64("class_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = searched.toDF(*searched.columns).withColumn("block", F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def search(index: pa.Table, query: pa.Table) -> pa.Table:
        out: dict[str, list] = {"class_id": [], "vec_id": [], "score": []}
        if index.num_rows and query.num_rows:
            matrix = lambda t: t.column("key").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            x, q = matrix(index), matrix(query)
            ids, own = index.column("ids").to_pylist(), query.column("class_id").to_numpy()
            forest = Forest(x)
            norms = np.linalg.norm(x, axis=1)
            steps = (forest.candidates(q[a : a + STEP_ROWS], max(LEAST_CANDIDATES, int(share * len(x)))) for a in range(0, len(q), STEP_ROWS))
            for i, rows_ in enumerate(chain.from_iterable(steps)):
                score = x[rows_] @ q[i] / (norms[rows_] * np.linalg.norm(q[i]))
                # Enough classes for k ids besides the query's own.
                keep = np.argpartition(-score, k) if len(score) > k + 1 else np.arange(len(score))
                level = score[keep[min(k, len(keep) - 1)]] if len(score) > k + 1 else -np.inf
                best = np.flatnonzero(score >= level)
                found = sorted((-score[b], v) for b in best for v in ids[rows_[b]])[: k + 1]
                out["class_id"] += [int(own[i])] * len(found)
                out["vec_id"] += [v for _, v in found]
                out["score"] += [-s for s, _ in found]
        return pa.table({"class_id": pa.array(out["class_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["dim", "block", "shard"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "class_id long, vec_id long, score double")
    # Every query of a class shares its finds, without itself.
    best = W.partitionBy("class_id").orderBy(F.desc("score"), "vec_id")
    of_class = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = queries.select("query_id", "class_id").join(of_class, "class_id").filter("vec_id != query_id")
    return out.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, F.col("vec_id") % 50 == 0)


QUERIES = {"op2_hash_prefix_forest": op2_hash_prefix_forest}
SQL: dict[str, str] = {}
