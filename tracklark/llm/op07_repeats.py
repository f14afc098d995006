"""Suffix-array dedup: maximal repeats of at least `least` bytes from the common-prefix interval trees of sparse suffix arrays.

A window of `least` bytes is anchored at its minimizer, the seed of `seed` bytes with the smallest hash in it; equal windows have
the same anchor, so suffixes that begin at anchors are enough, and only those that share a seed can repeat. Suffixes are dealt by
ranges of (seed, context, document), sorted, and streamed; an anchor whose whole context (all windows it anchors, by a 128-bit hash
of their bytes) stood before is a repeat outright, and of each context only the first stays.

The contexts that stay are sorted by what follows their seed, with the longest common prefixes of neighbours: an enhanced suffix
array. A stack scan over it gives the interval tree; in each interval the left extensions are tested for diversity in the same way
(their sorted order, common lengths and stack scan), so that every node is a maximal repeat with all its occurrences. All but the
first occurrence of each are removed.

A seed with more than most contexts (the edge of a hot passage) is split by suffix order: a repeat holds half of its other bytes
after the seed or half of them before it, so those that share these bytes are scanned as families of their own. A family that is
still too large is split to the end, by the window itself: each window's first place is found by an aggregation that combines
before the shuffle.

repeats() gives the bytes to remove; repeat_groups() the groups of maximal repeats with all their occurrences, as long as they are.

Defined results: a null or empty text has no bytes; texts of fewer than `least` bytes keep all; rows that repeat a doc_id and its text
are one document, each row gets its result; different texts of one doc_id are documents of their own, in the order of their hashes, and
repeats() and repeat_groups() take such a table only through told_apart(), which numbers them; rows without a doc_id keep all; an empty table gives an empty table; columns beside
doc_id and text do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklark.llm.common import STEP_BYTES, arrow_types, cut, documents, id_and_text, partitions, per_batch
from tracklark.llm.textnum import BYTE_VALUES, U, content_hashes, prefix_sums, range_hashes
from tracklark.operators.sequence import ranked

#: Bytes of a repeat and of a seed; contexts of one seed that are scanned together.
LEAST, SEED, MOST = 100, 24, 4096
#: Tasks that the occurrences of one document's repeats are spread over.
SALTS = 16
ANCHORS = "seed long, context long, context2 long, doc_id long, place long"
SPANS = "doc_id long, start long, end long"
NODES = "h1 long, h2 long, left long, right long, doc_id long, anchor long"
GROUPS = "group_id long, doc_id long, start long, end long, first boolean"


def anchors(data: np.ndarray, bounds: np.ndarray, least: int = LEAST, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of joined texts (bounds: where each starts, and the end; at most STEP_BYTES in all): anchor, first and last window
    anchored there, hash of the seed and two of the context from the first window's start to the last one's end."""
    n = len(data)
    if n < least:
        return *(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 3
    s = prefix_sums(data, BYTE_VALUES)
    at = np.arange(n - seed + 1)
    h = range_hashes(s, at, at + seed)
    # The leftmost of the smallest hashes: the place is in the low bits.
    low = U(2 * STEP_BYTES - 1)
    m = (h & ~low) | at.astype(np.uint64)
    width, size = least - seed + 1, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    anchor = (m & low).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)  # windows that stay in one text
    long_ = np.diff(bounds) >= least
    np.add.at(inside, bounds[:-1][long_], 1)
    np.add.at(inside, bounds[1:][long_] - least + 1, -1)
    valid = np.cumsum(inside)[: len(anchor)] > 0
    change = np.ones(len(anchor), bool)
    change[1:] = anchor[1:] != anchor[:-1]
    change[1:] |= valid[1:] != valid[:-1]
    starts = bounds[1:-1]
    change[starts[starts < len(anchor)]] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(anchor)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    q = anchor[first]
    return q, first, last, h[q], *content_hashes(data.tobytes(), first, last + least)


def all_anchors(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """ANCHORS: place holds the anchor, and how far before it the first and last window start. Long texts go in overlapping parts."""
    if not seed <= least < 256 + seed:
        raise ValueError("a window must hold a seed and at most 255 bytes before it")

    def run(ids: list, texts: list) -> dict:
        parts, owner, base = [], [], []
        for i, t in zip(ids, texts, strict=True):
            t = t.encode()
            for a in range(0, max(1, len(t) - least + 1), STEP_BYTES - least + 1):
                parts.append(t[a : a + STEP_BYTES])
                owner.append(i)
                base.append(a)
        # Parts of one call sum to 2 * STEP_BYTES at most: a step of whole texts or each part of a long one alone.
        out: dict[str, list] = {x.split()[0]: [] for x in ANCHORS.split(", ")}
        alone = len(parts) > len(texts)
        for some in [[k] for k in range(len(parts))] if alone else [list(range(len(parts)))]:
            bounds = np.cumsum([0] + [len(parts[k]) for k in some])
            q, first, last, h, c, c2 = anchors(np.frombuffer(b"".join(parts[k] for k in some), np.uint8), bounds, least, seed)
            at = np.searchsorted(bounds, first, "right") - 1
            which = np.array(some)[at]
            local = q - bounds[at] + np.array(base, np.int64)[which]
            out["seed"].append(h.astype(np.int64))
            out["context"].append(c.astype(np.int64))
            out["context2"].append(c2.astype(np.int64))
            out["doc_id"].append(np.array(owner, np.int64)[which])
            out["place"].append(local << 16 | (q - first) << 8 | (q - last))
        return {k: np.concatenate(v) for k, v in out.items()}

    return per_batch(id_and_text(docs).filter(f"doc_id is not null and octet_length(text) >= {least}"), ANCHORS, run)


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted anchors: again = true for those whose context stood before; of the others, the first of each context of the
    seeds that have several, and of the first and last seed, which other partitions may hold too."""
    held: list[np.ndarray] = []
    edge, last = True, None

    def out(x: np.ndarray, left: bool, right: bool) -> pa.RecordBatch:
        seed, context, more = x[:3]
        new_seed = np.ones(len(seed), bool)
        new_seed[1:] = seed[1:] != seed[:-1]
        new = new_seed.copy()
        new[1:] |= (context[1:] != context[:-1]) | (more[1:] != more[:-1])
        run = np.cumsum(new_seed) - 1
        several = np.bincount(run, weights=new) > 1
        several[0] |= left
        several[-1] |= right
        keep = ~new | several[run]
        return pa.RecordBatch.from_arrays([pa.array(~new[keep]), *(pa.array(c[keep]) for c in x)], names=["again", *(c.split()[0] for c in ANCHORS.split(", "))])

    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
        # A row of the table that stands twice is no repeat; its anchors follow each other.
        other = np.ones(x.shape[1], bool)
        other[1:] = (x[:, 1:] != x[:, :-1]).any(0)
        other[0] = last is None or (x[:, 0] != last).any()
        last = x[:, -1].copy()
        x = x[:, other]
        if not x.shape[1]:
            continue
        held.append(x)
        if x[0, 0] != x[0, -1]:
            x = np.concatenate(held, 1)
            at = np.flatnonzero(x[0] != x[0, -1])[-1] + 1
            yield out(x[:, :at], edge, False)
            held, edge = [x[:, at:]], False
        elif sum(h.shape[1] for h in held) > 1 << 20:
            # A seed on more rows than fit: its parts are like those of several partitions.
            yield out(np.concatenate(held, 1), True, True)
            held, edge = [], True
    if held:
        yield out(np.concatenate(held, 1), edge, True)


def common(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Depth, first and last entry of each node of the interval tree with at least this depth. lcp[i]: entries i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*lcp, -1]):
        left = i
        while stack and stack[-1][0] > v:
            depth, left = stack.pop()
            yield depth, left, i
        if v >= least and (not stack or stack[-1][0] < v):
            stack.append((v, left))


def maximal_repeats(after: list[bytes], before: list[bytes], least: int, seed: int) -> Iterator[tuple[int, int, list[int]]]:
    """left, right, entries: entry i's occurrence reaches left bytes before its anchor and right bytes from it on. after: the bytes
    from the anchor on; before: those before it, reversed. Groups are maximal within these contexts."""
    order = sorted(range(len(after)), key=after.__getitem__)
    lcp = [common(after[i], after[j]) for i, j in zip(order, order[1:], strict=False)]
    rank = {i: r for r, i in enumerate(sorted(range(len(before)), key=before.__getitem__))}
    for right, a, b in intervals(lcp, seed):
        nodes = sorted(order[a : b + 1], key=rank.__getitem__)
        shared = [common(before[i], before[j]) for i, j in zip(nodes, nodes[1:], strict=False)]
        # Left-diverse: a node of the tree of left extensions; with the right side it must reach the least length.
        for left, c, d in intervals(shared, max(0, least - right)):
            yield left, right, nodes[c : d + 1]


def contexts(docs: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """seed, doc_id, anchor, before (reversed) and after the anchor; rows: seed, doc_id, place."""
    wanted = cut(rows.groupBy("doc_id").agg(F.collect_set(F.struct("seed", "place")).alias("at")))
    few = F.broadcast(wanted.select(F.col("doc_id").alias("_id"))) if wanted.count() <= 1_000_000 else wanted.select(F.col("doc_id").alias("_id"))
    texts = id_and_text(docs).join(few, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, t, at in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                t = t.encode()
                for x in at:
                    q, first, last = x["place"] >> 16, x["place"] >> 8 & 255, x["place"] & 255
                    out.append((x["seed"], i, q, t[q - first : q][::-1], t[q : q - last + least]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["seed", "doc_id", "anchor", "before", "after"])

    return texts.join(wanted, "doc_id").mapInArrow(run, "seed long, doc_id long, anchor long, before binary, after binary")


def of_seed(rows: list[tuple], least: int, seed: int) -> Iterator[tuple[int, int, list[tuple]]]:
    """left, right and the contexts (in order of document and place) of each maximal repeat among one seed's contexts."""
    rows = sorted(set(rows), key=lambda r: (r[1], r[2]))
    for left, right, nodes in maximal_repeats([r[4] for r in rows], [r[3] for r in rows], least, seed):
        yield left, right, [rows[k] for k in sorted(nodes)]


def node_rows(rows: list[tuple], least: int, seed: int) -> Iterator[tuple]:
    """A row for each context of each maximal repeat."""
    for left, right, found in of_seed(rows, least, seed):
        h1, h2 = halves(found[0][3][:left][::-1] + found[0][4][:right])
        for _, doc, q, _, _ in found:
            yield h1, h2, left, right, doc, q


def covered_rows(rows: list[tuple], least: int, seed: int) -> Iterator[tuple]:
    """For each context the union of the repeats of which it is not the first occurrence: all hold the seed, so it is one span."""
    reach: dict[tuple[int, int], list[int]] = {}
    for left, right, found in of_seed(rows, least, seed):
        for _, doc, q, _, _ in found[1:]:
            x = reach.setdefault((doc, q), [0, 0])
            x[0], x[1] = max(x[0], left), max(x[1], right)
    for (doc, q), (left, right) in reach.items():
        yield doc, q - left, q + right


def halves(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def by_rows(schema: str, each: Callable[[list[tuple]], Iterable[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: a batch of each(rows) for every batch."""
    names, kinds = [x.split()[0] for x in schema.split(", ")], arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(each(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))))
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def scanned(rows: DataFrame, schema: str, each: Callable[[list[tuple], int, int], Iterable[tuple]], least: int, seed: int) -> DataFrame:
    """each() of the contexts of every seed or family, whose rows (as of contexts()) stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def of_batch(found: list[tuple]) -> Iterator[tuple]:
            for r in found:
                if held and held[-1][0] != r[0]:
                    yield from each(held, least, seed)
                    held.clear()
                held.append(r)

        yield from by_rows(schema, of_batch)(batches)
        last = list(each(held, least, seed))
        if last:
            names, kinds = [x.split()[0] for x in schema.split(", ")], arrow_types(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*last, strict=True), kinds, strict=True)], names=names)

    dealt = rows.repartition(partitions(rows.sparkSession), "seed").sortWithinPartitions("seed")
    return dealt.mapInArrow(run, schema)


def families(rows: DataFrame, least: int, seed: int) -> DataFrame:
    """The rows under the hash of what they share, in place of the seed: it and half of the other bytes of a window, after it or before."""
    half = (least - seed) // 2
    after = rows.filter(F.octet_length("after") >= seed + half).withColumn("seed", F.xxhash64("seed", F.lit(0), F.substring("after", 1, seed + half)))
    before = rows.filter(F.octet_length("before") >= least - seed - half).withColumn("seed", F.xxhash64("seed", F.lit(1), F.substring("before", 1, least - seed - half)))
    return after.union(before)


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))


def windows(rows: list[tuple], least: int) -> Iterator[tuple]:
    """A row, as of node_rows(), for each window of each context."""
    for _, doc, q, before, after in rows:
        text = before[::-1] + after
        for k in range(len(text) - least + 1):
            yield *halves(text[k : k + least]), len(before) - k, k + least - len(before), doc, q


def window_firsts(rows: DataFrame, least: int) -> DataFrame:
    """SPANS of the windows of contexts that stood before, window by window."""
    keyed = cut(rows.mapInArrow(by_rows(NODES, lambda x: windows(x, least)), NODES).select("h1", "h2", "doc_id", (F.col("anchor") - F.col("left")).alias("start")).distinct())
    firsts = keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    late = keyed.join(firsts, ["h1", "h2"]).filter(F.struct("doc_id", "start") > F.col("first"))
    return late.select("doc_id", "start", (F.col("start") + least).alias("end"))


def split_hot(rows: DataFrame, counts: DataFrame, least: int, seed: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """What is scanned (seeds and, of those with more than most contexts, families), and what is split by windows (None: nothing)."""
    hot = cut(counts.filter(F.col("n") > most).select("seed"))
    if hot.isEmpty():
        return rows, None
    parts = cut(families(rows.join(hot, "seed", "left_semi"), least, seed))
    still = cut(sizes(parts).filter(F.col("n") > most).select("seed"))
    plain = rows.join(hot, "seed", "left_anti").union(parts.join(still, "seed", "left_anti"))
    return plain, None if still.isEmpty() else parts.join(still, "seed", "left_semi")


def repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED, most: int = MOST) -> DataFrame:
    """SPANS of all bytes that stood before."""
    n = partitions(docs.sparkSession)
    keys = ["seed", "context", "context2", "doc_id"]
    ranged = all_anchors(docs, least, seed).repartitionByRange(n, *keys).sortWithinPartitions(*keys, "place")
    made = cut(ranged.mapInArrow(stream, f"again boolean, {ANCHORS}"))
    anchor = F.shiftright("place", 16)
    first, last = F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    whole = made.filter("again").select("doc_id", (anchor - first).alias("start"), (anchor - last + least).alias("end"))
    kept = made.filter("not again")
    counts = sizes(kept)
    rows = cut(contexts(docs, kept.join(counts.filter("n > 1").select("seed"), "seed").select("seed", "doc_id", "place"), least))
    plain, still = split_hot(rows, counts, least, seed, most)
    spans = whole.union(scanned(plain, SPANS, covered_rows, least, seed))
    return spans if still is None else spans.union(window_firsts(still, least))


def repeat_groups(docs: DataFrame, least: int = LEAST, seed: int = SEED, most: int = MOST) -> DataFrame:
    """GROUPS: maximal repeats with all their occurrences; first marks the one that stood first.

    Each context that stands at several places, and each node of the trees, is a repeat. Repeats that overlap and stand at the same
    places, shifted, are one; then each grows while all of its occurrences agree. Not given are repeats all of whose
    contexts stand at more places than they do themselves, and of a run (one byte or phrase over and over) the longer ones."""
    anchor = F.shiftright("place", 16)
    place = [F.shiftright("place", 8).bitwiseAND(255).alias("left"), (F.lit(least) - F.col("place").bitwiseAND(255)).alias("right")]
    key = ["seed", "context", "context2"]
    found = cut(all_anchors(docs, least, seed).distinct())
    classes = cut(found.groupBy(*key).agg(F.min(F.struct("doc_id", "place")).alias("x"), F.count(F.lit(1)).alias("n")).select(*key, "x.doc_id", "x.place", "n"))
    counts = sizes(classes)
    rows = cut(contexts(docs, classes.join(counts.filter("n > 1").select("seed"), "seed").select("seed", "doc_id", "place"), least))
    plain, still = split_hot(rows, counts, least, seed, most)
    nodes = scanned(plain, NODES, node_rows, least, seed)
    if still is not None:
        nodes = nodes.union(still.mapInArrow(by_rows(NODES, lambda x: windows(x, least)), NODES))
    # All places of the contexts of each node; a context that stands at several places is a node by itself.
    of_class = classes.select(*key, F.col("doc_id").alias("_doc"), anchor.alias("_anchor"))
    of_node = nodes.distinct().join(of_class, (F.col("doc_id") == F.col("_doc")) & (F.col("anchor") == F.col("_anchor"))).select("h1", "h2", "left", "right", *key)
    alone = classes.filter("n > 1").select(F.col("context").alias("h1"), F.col("context2").alias("h2"), *place, *key)
    at = of_node.union(alone).join(found, key).select("h1", "h2", "left", "right", "doc_id", (anchor - F.col("left")).alias("start"))
    at = cut(at.distinct())
    piece = ["h1", "h2", "left", "right"]
    firsts = at.groupBy(*piece).agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shifted = at.join(firsts, piece).select(*piece, "f", "n", F.struct("doc_id", (F.col("start") - F.col("f.start")).alias("by")).alias("o"))
    same = shifted.groupBy(*piece, "f", "n").agg(F.sum(F.xxhash64("o").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(1), "o").cast("decimal(38,0)")).alias("s2"))
    chain = W.partitionBy("f.doc_id", "n", "s1", "s2").orderBy("f.start", F.col("left") + F.col("right"), *piece)
    end = F.col("f.start") + F.col("left") + F.col("right")
    heads = same.withColumn("new", F.col("f.start") >= F.coalesce(F.max(end).over(chain.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)))
    heads = cut(heads.filter("new").select(*piece, F.col("f.doc_id").alias("u"), F.col("f.start").alias("at")))
    grown = cut(extended(docs, heads, cut(at.join(heads, piece).select(*piece, "u", "at", "doc_id", "start"))))
    out = grown.select(F.xxhash64("u", "g_start", "g_end").alias("group_id"), "doc_id", (F.col("start") - F.col("at") + F.col("g_start")).alias("start"), (F.col("start") - F.col("at") + F.col("g_end")).alias("end"), (F.struct("doc_id", "start") == F.struct(F.col("u").alias("doc_id"), F.col("at").alias("start"))).alias("first"))
    return out.distinct()


def extended(docs: DataFrame, heads: DataFrame, at: DataFrame) -> DataFrame:
    """at with g_start and g_end: how far the first occurrence (u, at) reaches while all occurrences agree."""
    piece = ["h1", "h2", "left", "right"]
    texts = id_and_text(docs).dropDuplicates(["doc_id"])
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    pairs = at.filter("doc_id != u or start != at").select("u", salt, *piece, "at", "doc_id", "start")
    lone = pairs.select("u", "salt").distinct().join(texts.withColumnRenamed("doc_id", "u"), "u")
    lone = lone.select("u", "salt", *(F.lit(None).cast("long").alias(c) for c in (*piece, "at", "doc_id", "start")), "text")
    others = pairs.join(texts, "doc_id").select("u", "salt", *piece, "at", "doc_id", "start", "text")
    rows = lone.union(others).repartition(partitions(docs.sparkSession), "u", "salt").sortWithinPartitions("u", "salt", F.col("doc_id").asc_nulls_first())
    state: dict[str, bytes] = {}

    def each(found: list[tuple]) -> Iterator[tuple]:
        for _, _, h1, h2, left, right, a, doc, b, text in found:
            data = text.encode()
            if doc is None:
                state["text"] = data
                continue
            own, n = state["text"], left + right
            back = common(own[:a][::-1], data[:b][::-1])
            yield h1, h2, left, right, back, common(own[a + n :], data[b + n :])

    reach = rows.mapInArrow(by_rows("h1 long, h2 long, left long, right long, back long, more long", each), "h1 long, h2 long, left long, right long, back long, more long")
    spans = reach.groupBy(*piece).agg(F.min("back").alias("back"), F.min("more").alias("more"))
    return at.join(spans, piece).withColumn("g_start", F.col("at") - F.col("back")).withColumn("g_end", F.col("at") + F.col("left") + F.col("right") + F.col("more"))


def told_apart(docs: DataFrame) -> DataFrame:
    """own_id, doc_id, text: doc_id is own_id where every id stands once; else the place of (own_id, text) among all, so that texts that
    share an id have numbers of their own, in the order of the ids. Whether an id repeats is told from the ids alone."""
    rows = id_and_text(docs)
    known = rows.filter("doc_id is not null")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.select(F.col("doc_id").alias("own_id"), "doc_id", "text")
    key = [F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    numbers = ranked(known.select(*key).distinct(), ["own_id", "h1", "h2"], "number").select("own_id", "h1", "h2", F.col("number").cast("long").alias("doc_id"))
    return rows.select(*key, "text").join(numbers, ["own_id", "h1", "h2"], "left").select("own_id", "doc_id", "text")


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    docs = told_apart(docs)
    spans = repeats(docs)
    per_doc = spans.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.shiftleft("start", 32).bitwiseOR(F.col("end"))).alias("spans"))
    joined = docs.join(per_doc, F.col("doc_id") == F.col("_id"), "left").select("own_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                t = t.encode()
                kept, removed, runs = t, 0, 0
                if x.is_valid:
                    at = x.values.to_numpy()
                    turn = np.zeros(len(t) + 1, np.int32)
                    np.add.at(turn, at >> 32, 1)
                    np.add.at(turn, at & 0xFFFFFFFF, -1)
                    gone = np.cumsum(turn)[:-1] > 0
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                for c, v in zip(out, (i, len(t), removed, runs, hashlib.sha256(kept).hexdigest()), strict=True):
                    out[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op7_suffix_repeats": op7_suffix_repeats}
SQL: dict[str, str] = {}
