"""N-gram Jaccard join: a grouped prefix join.

A document's set is its distinct k-word shingles. Documents of equal sets collapse into one class. Classes whose prefixes (the
rarest shingles, as many as any partner of the wanted similarity must share one of) and sizes are equal collapse into one group;
group pairs that share a prefix shingle are filtered by size, position and a parity sketch; what is left is expanded to members
and verified on the texts.

Shingles are ordered by how common they are (a fixed table of levels, from counts over all documents), then by hash; any order is
right, this one keeps hot passages out of prefixes. Members of a group of copies need not all be compared: a first and a second
round compare every group only with one centre for each prefix shingle, linked groups become components, and the last round
compares all group pairs that are in different components still. So no link between components is lost, and a group of m near
copies costs about m comparisons.

The parity sketch of a set has at bit b the parity of the shingles that hash to b; the sketches of two sets differ in at most as
many bits as the sets differ in shingles, so a pair beyond the allowed difference is out for certain.

Shingles have two 64-bit hashes that are independent of each other: equal sets are those whose sums of both agree, and a pair is
verified by both, so it does not depend on one hash alone.

Defined results: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; fewer than k words are one shingle; a text without words (null,
empty) has no shingles and no links; a doc_id that repeats with another text takes part with each; rows without a doc_id are left
out; an empty table gives an empty table; columns beside doc_id and text do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.llm.common import STEP_BYTES, cut, discard, documents, id_and_text, packed, partitions, per_batch, pieces_by_bytes, unpacked
from tracklark.llm.components import components
from tracklark.llm.textnum import U, mix, shingles

#: Buckets of the table of levels: a fixed size, however many shingles there are.
LEVEL_BUCKETS = 1 << 20
#: Shingles counted fewer times than this among the sampled ones are all alike.
COMMON = 8
SKETCH_WORDS = 8
#: Ids up to which endpoints are broadcast against documents (16 bytes each).
BROADCAST_IDS = 1_000_000
#: Tasks that the partners of one centre are spread over.
SALTS = 16


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1 if n else 0


def level_table(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """log2 of the count of the most common shingle in each bucket. Every document counts with the shingles that are its prefix in
    hash order, which takes a common shingle from the same share of its documents as any other."""

    def run(ids: list, texts: list) -> dict:
        sets = shingles([t.encode() for t in texts], k)
        some = np.concatenate([s[: prefix_size(len(s), percent)] for s in map(np.unique, (a for a, _ in sets))])
        token, count = np.unique(some, return_counts=True)
        return {"token": token.astype(np.int64), "n": count}

    counts = per_batch(id_and_text(docs).filter("text != ''"), "token long, n long", run).groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    bucket = F.col("token").bitwiseAND(F.lit(LEVEL_BUCKETS - 1)).cast("int").alias("bucket")
    levels = counts.groupBy(bucket).agg(F.max(F.floor(F.log2("n"))).cast("int").alias("level"))
    table = np.zeros(LEVEL_BUCKETS, np.uint8)
    for r in levels.toArrow().to_batches():  # at most LEVEL_BUCKETS rows
        table[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return table


def sketch(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((mix(s) >> U(40)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, sig1 and sig2 (of the set), prefix (rarest first) and its hash h, sketch."""
    levels = docs.sparkSession.sparkContext.broadcast(level_table(docs, k, percent))

    def run(ids: list, texts: list) -> dict:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n", "sig1", "sig2", "h", "prefix", "sketch")}
        table = levels.value
        for i, (all_, more) in zip(ids, shingles([t.encode() for t in texts], k), strict=True):
            s, at = np.unique(all_, return_index=True)
            order = np.argsort(table[(s & U(LEVEL_BUCKETS - 1)).astype(np.int64)], kind="stable")
            out["doc_id"].append(i)
            out["n"].append(len(s))
            out["sig1"].append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
            out["sig2"].append(int(mix(more[at]).sum(dtype=np.uint64).astype(np.int64)))
            prefix = s[order[: prefix_size(len(s), percent)]].astype(np.int64)
            out["h"].append(int.from_bytes(xxhash.xxh3_64_digest(prefix.tobytes()), "little", signed=True))
            out["prefix"].append(prefix)
            out["sketch"].append(sketch(s))
        return out

    return per_batch(id_and_text(docs).filter("doc_id is not null"), "doc_id long, n long, sig1 long, sig2 long, h long, prefix array<long>, sketch array<long>", run)


def sizes_fit(a: str, b: str, percent: int) -> Column:
    """Can sets of the sizes of rows a and b be similar enough?"""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def places_fit(a: str, b: str, percent: int) -> Column:
    """Can they, given the places of the shared shingle?"""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return F.least(n - F.col(f"{a}pos"), m - F.col(f"{b}pos")) * (100 + percent) >= percent * (n + m)


def sketches_fit(a: str, b: str, percent: int) -> Column:
    """Can they, given their parity sketches? |A xor B| <= (100 - p) / (100 + p) * (|A| + |B|)."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(SKETCH_WORDS)))
    return differ * (100 + percent) <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n"))


def close(a: str, b: str, percent: int) -> Column:
    """Can the sets of rows a and b (n, s0..) still be similar enough?"""
    return sizes_fit(a, b, percent) & sketches_fit(a, b, percent)


def salted(pairs: DataFrame) -> DataFrame:
    """pairs with a salt by v, so that a centre with very many partners is spread over SALTS tasks."""
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))


def similar(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], percent: int) -> bool:
    """Are two sets, by both hashes of their shingles, similar enough? A collision in one hash does not count."""
    both = min(len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(x, y, strict=True))
    return both > 0 and 100 * both >= percent * (max(map(len, x)) + max(map(len, y)) - both)


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """A table of the pairs (u, v) of documents whose sets are similar enough. Only texts of documents in pairs move; the text of
    u goes once to each of its salts and is followed there by those of its partners."""
    ids = cut(pairs.select(F.col("u").alias("_id")).union(pairs.select(F.col("v").alias("_id"))).distinct())
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = id_and_text(docs).join(few, F.col("doc_id") == F.col("_id")).select("doc_id", "text")
    dealt = salted(pairs)
    heads = dealt.select("u", "salt").distinct().join(texts.withColumnRenamed("doc_id", "u"), "u").select("u", "salt", F.lit(None).cast("long").alias("v"), "text")
    others = dealt.join(texts.withColumnRenamed("doc_id", "v"), "v").select("u", "salt", "v", "text")
    rows = heads.union(others).repartition(partitions(docs.sparkSession), "u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, centre = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            u, salt, v, text = (batch.column(c).to_pylist() for c in ("u", "salt", "v", "text"))
            for i, j in pieces_by_bytes([len(t) for t in text], STEP_BYTES):
                for n, both in enumerate(shingles([t.encode() for t in text[i:j]], k), i):
                    if head != (u[n], salt[n]):
                        head, centre = (u[n], salt[n]), []
                    own = tuple(map(np.unique, both))
                    if v[n] is None:
                        centre.append(own)
                    elif any(similar(x, own, percent) for x in centre):
                        found.append((u[n], v[n]))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["u", "v"])

    out = cut(rows.mapInArrow(run, "u long, v long"))
    discard(ids)
    return out


def similar_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    all_ = cut(profiles(docs, k, percent))
    known = ["n", "sig1", "sig2"]
    classes = all_.filter("n > 0").groupBy(*known).agg(F.min("doc_id").alias("rep"))
    sketches = [F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH_WORDS)]
    # The prefixes stay behind until only those of the groups' leaders are wanted.
    reps = all_.select("doc_id", *known, "h", *sketches).join(classes, known).filter("doc_id = rep").drop("rep").dropDuplicates(["doc_id", *known])
    groups = reps.groupBy("n", "h").agg(F.min("doc_id").alias("gid"))
    members = cut(reps.join(groups, ["n", "h"]).drop("h"))
    sk = ["n", *(f"s{i}" for i in range(SKETCH_WORDS))]
    leaders = members.filter("doc_id = gid").select("doc_id", *known, "gid")
    postings = all_.select("doc_id", *known, "prefix").join(leaders, ["doc_id", *known]).select("gid", F.posexplode("prefix").alias("pos", "token"))
    shared = postings.groupBy("token").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi")).filter("lo < hi").select("token")
    postings = cut(postings.join(shared, "token").select("token", "gid", "pos"))
    state = members.select("doc_id", "gid", F.col("doc_id").alias("comp"))
    edges = None

    def link(pairs: DataFrame) -> DataFrame:
        nonlocal edges
        pairs = cut(pairs.distinct())
        new = verified(docs, pairs, k, percent)
        edges = new if edges is None else edges.union(new)
        tops = components(edges)
        discard(pairs)
        return cut(members.select("doc_id", "gid").join(tops, members.doc_id == tops.id, "left").select("doc_id", "gid", F.coalesce("component", "doc_id").alias("comp")))

    info = members.select("doc_id", *sk)
    as_ = lambda df, p, cols: df.select(*(F.col(c).alias(f"{p}{c}") for c in cols))

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) of documents that pass the size and sketch filters."""
        dealt = salted(pairs)
        heads = dealt.select("u", "salt").distinct().join(as_(info, "a_", ["doc_id", *sk]), F.col("u") == F.col("a_doc_id"))
        both = dealt.join(heads, ["u", "salt"]).join(as_(info, "b_", ["doc_id", *sk]), F.col("v") == F.col("b_doc_id"))
        return both.filter(close("a_", "b_", percent)).select("u", "v")

    for turn in (0, 1):
        # Each group against the centre of each of its prefix shingles, member by member; and members against their group's first.
        range_ = state.groupBy("gid").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        at = postings.join(range_, "gid")
        order = F.col("gid") if turn == 0 else F.xxhash64("gid")
        centres = at.groupBy("token").agg(F.min(F.struct(order.alias("o"), "gid")).alias("x"), F.min("c0").alias("t0"), F.max("c1").alias("t1")).filter("t0 < t1").select("token", F.col("x.gid").alias("centre"))
        star = at.join(centres, "token").filter("gid != centre").select("centre", "gid").distinct()
        of_group = state.select("gid", F.col("doc_id").alias("v"), F.col("comp").alias("cv"))
        of_centre = state.filter("doc_id = gid").select(F.col("gid").alias("u"), F.col("comp").alias("cu"))
        pairs = star.join(of_group, "gid").select(F.col("centre").alias("u"), "v", "cv").join(of_centre, "u").filter("cu != cv").select("u", "v")
        own = of_group.filter("gid != v").select(F.col("gid").alias("u"), "v", "cv").join(of_centre, "u").filter("cu != cv").select("u", "v")
        state = link(near(pairs.union(own)))

    # All that is in different components still, by shared prefix shingle or group.
    range_ = state.groupBy("gid").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    at = postings.join(range_, "gid")
    open_ = at.groupBy("token").agg(F.min("c0").alias("t0"), F.max("c1").alias("t1")).filter("t0 < t1").select("token")
    at = at.join(open_, "token").join(as_(info, "", ["doc_id", *sk]), F.col("gid") == F.col("doc_id")).drop("doc_id")
    cols = ["token", "gid", "pos", "c0", "c1", *sk]
    differ = (F.col("a_c0") != F.col("b_c0")) | (F.col("a_c1") != F.col("b_c1")) | (F.col("a_c0") != F.col("a_c1"))
    # Size and places are the same in all of a group; a sketch is a member's own, so it only tells of groups of one.
    single = state.groupBy("gid").agg((F.count(F.lit(1)) == 1).alias("single"))
    at = at.join(single, "gid")
    cols.append("single")
    fits = sizes_fit("a_", "b_", percent) & places_fit("a_", "b_", percent) & (~(F.col("a_single") & F.col("b_single")) | sketches_fit("a_", "b_", percent))
    group_pairs = as_(at, "a_", cols).join(as_(at, "b_", cols), (F.col("a_token") == F.col("b_token")) & (F.col("a_gid") < F.col("b_gid")) & differ & fits).select(F.col("a_gid").alias("g"), F.col("b_gid").alias("h")).distinct()
    # Members meet under the size and sketch filters, so that only likely pairs come out of the join.
    known_ = state.join(info.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).drop("_id")
    one = known_.select(F.col("gid").alias("g"), F.col("doc_id").alias("u"), F.col("comp").alias("cu"), *(F.col(c).alias(f"a_{c}") for c in sk))
    two = known_.select(F.col("gid").alias("h"), F.col("doc_id").alias("v"), F.col("comp").alias("cv"), *(F.col(c).alias(f"b_{c}") for c in sk))
    apart = (F.col("cu") != F.col("cv")) & close("a_", "b_", percent)
    pairs = group_pairs.join(one, "g").join(two.withColumnRenamed("h", "_h"), (F.col("h") == F.col("_h")) & apart).select("u", "v")
    own = one.join(two, (F.col("g") == F.col("h")) & (F.col("u") < F.col("v")) & apart).select("u", "v")
    state = link(pairs.union(own))

    discard(members, postings)
    of_class = classes.join(state.select(F.col("doc_id").alias("rep"), "comp").distinct(), "rep")
    out = all_.select("doc_id", *known).join(of_class.select(*known, "comp"), known, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id. Rows without a doc_id stay."""
    gone = similar_components(docs, k, percent).filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return unpacked(packed(docs, "doc_id").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti"), docs)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
SQL = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 4 THEN list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' '))
                                 WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.x = e.a)
SELECT id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(x) AS component_id FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY id
""",
}
