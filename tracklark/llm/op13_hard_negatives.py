"""Hard-negative mining by one-dimensional distance keys.

Vectors of integers get one more component, sqrt(M - |x|^2) with M the largest squared norm, and anchors get 0 there, so the
nearest in distance is the one with the highest inner product: d^2 = |a|^2 + M - 2 a.x. Every row belongs to its nearest pivot and
lies at its distance from it: rows are stored sorted by (label, pivot, distance), cut into ranges of bounded size, however hot a label
or pivot is. By the triangle inequality a row at key c of a pivot that is d away from the anchor is at least |d - c| away, so

* positives: each anchor first scans the one range of its label whose keys are nearest to its own; its k-th find bounds the distance
  that matters, and only ranges whose keys reach into it are scanned after that;
* negatives: the scores that are allowed, from a share of the positive's score to another, are an annulus around the anchor; only
  ranges whose keys can meet the annulus are scanned.

Inside a range, chunks of keys are scanned by growing distance of their interval from the anchor's key, until what is left is too far
to change the anchor's finds. Bounds have a slack far above rounding, and scores are integers, so the result is exact. Pivots are
PIVOTS rows of the table, those with the smallest hashes of their ids; any would give the same result. Vectors without structure lie
almost equally far from all pivots, and then most ranges are scanned: n / 50 anchors against n rows, in blocks.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; equal rows count once;
an empty vector is a vector of inner products 0; only vectors of equal dimension meet; positives with a score of 0 allow negatives of
score 0 only, those below 0 none; ties go to the smaller vec_id; an empty table gives an empty table; further columns do not matter.
Sums of products must stay under 2^53, which holds for components up to 2^26 in 2 dimensions and up to 2^20 in 8,192.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.llm.common import cut

#: Pivots, rows of a range, anchors of a block, rows of a chunk of keys.
PIVOTS, RANGE_ROWS, BLOCK_ROWS, CHUNK_ROWS = 16, 16384, 2048, 512
SLACK = 1e-6


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, v (array<double> of integers), asks of the rows that take part. rows: vec_id, label, embedding, asks."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256).cast("double"))
    good = rows.filter("vec_id is not null and label is not null and embedding is not null").filter(~bad)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"), "asks").distinct()


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, len(flat) // table.num_rows)


def keyed(rows: DataFrame, pivots: np.ndarray, most: float) -> DataFrame:
    """rows with pivot and far, the distance of the augmented row from its nearest pivot (pivots: augmented rows, one dimension)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(pa.table(batch), "v")
            far = distances(x, pivots, most)
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far[np.arange(len(far)), near])], names=[*batch.schema.names, "pivot", "far"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, v array<double>, pivot int, far double")


def distances(x: np.ndarray, pivots: np.ndarray, most: float, anchors: bool = False) -> np.ndarray:
    """Distances of rows, augmented (or as anchors: with 0), from pivots."""
    norm = (x * x).sum(1)
    last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(most - norm, 0))
    plain, more = pivots[:, :-1], pivots[:, -1]
    square = norm[:, None] + (plain * plain).sum(1) - 2 * x @ plain.T + (last[:, None] - more) ** 2
    return np.sqrt(np.maximum(square, 0))


class Range:
    """The rows of one range, sorted by (pivot, far), in chunks of keys of one pivot."""

    def __init__(self, table: pa.Table):
        far, pivot, ids = (table.column(c).to_numpy() for c in ("far", "pivot", "vec_id"))
        order = np.lexsort((ids, far, pivot))
        self.x, self.ids, self.labels = _matrix(table, "v")[order], ids[order], table.column("label").to_numpy()[order]
        far, pivot = far[order], pivot[order]
        starts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, np.arange(0, len(far), CHUNK_ROWS)]))
        self.chunks = list(zip(starts, np.append(starts[1:], len(far)), strict=True))
        self.pivot, self.low, self.high = pivot[starts], far[starts], far[np.append(starts[1:], len(far)) - 1]

    def gaps(self, far: np.ndarray) -> np.ndarray:
        """Least distances (anchors x chunks) by the keys. far: of anchors from pivots."""
        d = far[:, self.pivot]
        return np.maximum(np.maximum(self.low - d, d - self.high), 0)


def best(state: tuple[np.ndarray, np.ndarray], a: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Merges finds (anchor number a, score, id) into state: k scores and ids for each anchor, best first, in place."""
    top, names = state
    for one in np.unique(a):
        mine = a == one
        s, i = np.concatenate([top[one], scores[mine]]), np.concatenate([names[one], ids[mine]])
        order = np.lexsort((i, -s))[:k]
        top[one], names[one] = s[order], i[order]


def scanned(part: Range, q: np.ndarray, far: np.ndarray, labels: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of each anchor and each of its windows [low, high] of scores (anchors x windows), by an expanding scan.
    same: rows of the anchor's label without itself, else of other labels. reach + |q|^2 - 2 score is a squared distance."""
    n, windows = low.shape
    state = (np.full((n * windows, k), -np.inf), np.full((n * windows, k), np.iinfo(np.int64).max))
    gaps = part.gaps(far)
    # The chunks of each anchor by growing distance; a step takes the next chunk of every anchor that still needs one.
    order = np.argsort(gaps, axis=1, kind="stable")
    square = (q * q).sum(1) + reach
    for step in range(len(part.chunks)):
        chunk = order[:, step]
        # The best score that a row at this distance, or farther, can have.
        bound = (square - np.maximum(gaps[np.arange(n), chunk] - SLACK * np.sqrt(square), 0) ** 2) / 2 + SLACK
        kth = state[0].reshape(n, windows, k)[:, :, -1]
        need = np.flatnonzero((bound[:, None] >= np.maximum(low, kth)).any(1))
        if not len(need):
            break
        for c in np.unique(chunk[need]):
            a = need[chunk[need] == c]
            start, end = part.chunks[c]
            s = q[a] @ part.x[start:end].T
            alike = part.labels[start:end] == labels[a][:, None]
            fits = (alike & (part.ids[start:end] != ids[a][:, None])) if same else ~alike
            s = np.where(fits, s, -np.inf)
            for w in range(windows):
                # Equal scores may have smaller ids.
                least = np.maximum(np.maximum(low[a, w], state[0][a * windows + w, -1]), -1e300)
                i, j = np.nonzero((s >= least[:, None]) & (s <= high[a, w][:, None]))
                best(state, a[i] * windows + w, s[i, j], part.ids[start:end][j], k)
    return state


def scan(index: DataFrame, anchors: DataFrame, pairs: DataFrame, summary: tuple[np.ndarray, float], k: int, same: bool) -> DataFrame:
    """anchor_id, at (number of the window), vec_id, score: the k best of each window in each range of pairs (anchor_id, range_id).
    anchors: anchor_id, label, v, lows, highs."""
    pivots, most = summary
    asked = pairs.join(anchors, "anchor_id")
    blocks = max(1, -(-anchors.count() // BLOCK_ROWS))
    # toDF: columns of their own, as pairs stem from the index.
    right = asked.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int")).toDF(*asked.columns, "block")
    wanted = right.select("block", "range_id").distinct()
    left = index.join(wanted.toDF("block", "range_id"), "range_id")

    def run(rows: pa.Table, block: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "at": [], "vec_id": [], "score": []}
        if rows.num_rows and block.num_rows:
            part, q = Range(rows), _matrix(block, "v")
            ids, labels = (block.column(c).to_numpy() for c in ("anchor_id", "label"))
            lows, highs = _matrix(block, "lows"), _matrix(block, "highs")
            n, windows = lows.shape
            top, names = scanned(part, q, distances(q, pivots, most, True), labels, ids, lows, highs, k, same, most)
            i, j = np.nonzero(top > -np.inf)
            out = {"anchor_id": ids[i // windows], "at": i % windows, "vec_id": names[i, j], "score": top[i, j].astype(np.int64)}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return left.groupBy("block", "range_id").cogroup(right.groupBy("block", "range_id")).applyInArrow(run, "anchor_id long, at long, vec_id long, score long")


def firsts(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    own = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, label, embedding; is_anchor: a
    condition on vec_id. A negative's score is from low to high per cent of the positive's."""
    all_ = cut(vectors(rows.select("vec_id", "label", "embedding", is_anchor.alias("asks"))).withColumn("dim", F.size("v")))
    out = None
    # One index for each dimension; a table of embeddings has one.
    for (dim,) in all_.select("dim").distinct().collect():
        part = _mined(all_.filter(F.col("dim") == dim).drop("dim"), positives, negatives, low, high)
        out = part if out is None else out.union(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _mined(rows: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    # A scalar, and PIVOTS rows whose number does not grow.
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    n, most = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(PIVOTS).collect()], dtype=float)
    pivots = np.column_stack([sample, np.sqrt(np.maximum(most - (sample * sample).sum(1), 0))])
    ranges = max(1, -(-n // RANGE_ROWS))
    key = ["label", "pivot", "far", "vec_id"]
    stored = keyed(rows, pivots, most).repartitionByRange(ranges, *key).sortWithinPartitions(*key)
    index = cut(stored.withColumn("range_id", F.spark_partition_id()))
    keys = index.groupBy("range_id", "label", "pivot").agg(F.min("far").alias("low"), F.max("far").alias("high"))
    anchors = cut(rows.filter("asks").select(F.col("vec_id").alias("anchor_id"), "label", "v"))
    # Each anchor and pivot: the distance between them.
    plain = [F.array(*map(F.lit, map(float, p))) for p in pivots]
    square = lambda p: F.aggregate(F.zip_with("v", F.slice(p, 1, pivots.shape[1] - 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x) + F.element_at(p, -1) * F.element_at(p, -1)
    own = norm.alias("norm")
    away = anchors.select("anchor_id", "label", own, F.explode(F.array(*(F.struct(F.lit(i).alias("pivot"), F.sqrt(square(p)).alias("away")) for i, p in enumerate(plain)))).alias("_p")).select("anchor_id", "label", "norm", "_p.*")
    gap = F.greatest(F.col("low") - F.col("away"), F.col("away") - F.col("high"), F.lit(0.0))

    # The highest score that a range can hold for an anchor.
    def bound(df: DataFrame) -> DataFrame:
        whole = F.col("norm") + F.lit(float(most))
        at = F.greatest(gap - F.lit(SLACK) * F.sqrt(whole), F.lit(0.0))
        return df.withColumn("bound", (whole - at * at) / 2 + SLACK)

    # Positives: the nearest range of the label, then those whose keys reach what is found there.
    alike = cut(bound(away.join(keys, ["label", "pivot"])).groupBy("anchor_id", "range_id").agg(F.max("bound").alias("bound"), F.min(gap).alias("gap")))
    home = alike.groupBy("anchor_id").agg(F.min_by("range_id", F.struct("gap", "range_id")).alias("range_id"))
    lowest, highest = F.lit(-1e300), F.lit(1e300)
    open_ = anchors.select("*", F.array(lowest).alias("lows"), F.array(highest).alias("highs"))
    summary = (pivots, float(most))
    first = cut(scan(index, open_, home, summary, positives, True))
    kth = first.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    least = F.when(F.col("n") >= positives, F.col("score").cast("double")).otherwise(lowest)
    reach = anchors.select("anchor_id").join(kth, "anchor_id", "left").select("anchor_id", F.coalesce(least, lowest).alias("least"))
    later = alike.join(home.withColumn("home", F.lit(True)), ["anchor_id", "range_id"], "left").filter("home is null").join(reach, "anchor_id").filter("bound >= least").select("anchor_id", "range_id")
    narrowed = anchors.join(reach, "anchor_id").select("anchor_id", "label", "v", F.array("least").alias("lows"), F.array(highest).alias("highs"))
    second = scan(index, narrowed, later, summary, positives, True)
    pos = cut(firsts(first.union(second), ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"))

    # Negatives: one window of scores for each positive, by rank; a window without a positive is empty.
    window = pos.filter("positive_score >= 0").groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "positive_score"))).alias("w"))
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    # Smallest and largest whole scores s with low * p <= 100 * s <= high * p.
    limits = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda r: F.coalesce(F.when(F.col("w")[r].isNotNull(), F.struct(F.ceil(F.col("w")[r] * low / 100).cast("double").alias("a"), F.floor(F.col("w")[r] * high / 100).cast("double").alias("b"))), none))
    asked = cut(anchors.join(window, "anchor_id").withColumn("_w", limits).select("anchor_id", "label", "v", F.transform("_w", lambda x: x["a"]).alias("lows"), F.transform("_w", lambda x: x["b"]).alias("highs")))
    from_ = F.array_min(F.transform(F.filter(F.arrays_zip("lows", "highs"), lambda x: x["lows"] <= x["highs"]), lambda x: x["lows"]))
    to_meet = away.drop("label").join(asked.select("anchor_id", "label", from_.alias("from")), "anchor_id").filter("`from` is not null")
    others = keys.groupBy("range_id", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("label").alias("l1"), F.max("label").alias("l2"))
    met = bound(to_meet.join(others, "pivot")).filter("bound >= `from` and (l1 != label or l2 != label)").select("anchor_id", "range_id").distinct()
    found = firsts(scan(index, asked, met, summary, negatives, False), ["anchor_id", "at"], negatives)
    return found.join(pos.select("anchor_id", (F.col("rank") - 1).cast("long").alias("at"), "positive_id", "positive_score"), ["anchor_id", "at"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_distance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


SQL = {
    "op13_distance_keys": """
WITH good AS (
  SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::bigint AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::bigint AS score
  FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scores WHERE alike) WHERE r <= 5),
neg AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM pos p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3"""
}
QUERIES = {"op13_distance_keys": op13_distance_keys}
