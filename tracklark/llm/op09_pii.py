"""PII: base patterns, and information-theoretic sanitisation of the terms that give a protected entity away.

Protected entities are the values that the base patterns find, and keys: strings of letters and digits that hold at least KEY_BITS of
information by the entropy of their own characters (spans of kind "key"). Co-occurring terms are the words of four or more letters or digits
anywhere in the texts that mention an entity. For a term t and an entity e, PMI(t; e) = log(p(t, e) / (p(t) p(e))) is the
information that t discloses of e, and IC(e) = -log p(e) all there is; t is a disclosing term of e if PMI / IC reaches the
disclosure threshold and t stands in at least least_contexts texts that mention e in as many distinct contexts (the words around
the mention; equal contexts count once, so copies are no evidence). p counts documents by distinct text, whole texts everywhere.
In documents that mention e, its disclosing terms become spans of kind "term". sanitise() puts a general
label in place of base spans and keys and removes terms.

Defined results: a null or empty text has no spans; spans count code points, end exclusive; repeated rows and copies get equal
spans; an empty table gives an empty table; further columns pass through sanitise unchanged.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.llm.common import cut, documents, id_and_text, packed, per_batch, unpacked

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base kinds; runs are taken whole, so that long ones cost no more than their length.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]{4,}")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "key": "[KEY]", "term": ""}
#: Strings that may be keys have so many characters, go from letters to digits or back so often, and hold so many bits.
KEY_RUN, KEY_TURNS, KEY_BITS = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+"), 4, 64
#: Words on each side of a mention that make its context, least distinct contexts and texts, and the disclosure threshold.
CONTEXT_WORDS, LEAST_CONTEXTS, DISCLOSURE = 6, 3, 0.8
#: Rows and bytes (as JSON) up to which a table of terms is broadcast; beyond, it is joined by shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8_000_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ the local part is read backwards, to the end of the match before at most."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end: leftmost non-overlapping matches per kind; failing matches are dropped without a retry."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def key_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Keys outside the base spans."""
    out = []
    for m in KEY_RUN.finditer(text):
        run = m.group()
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:], strict=False))
        bits = sum(n * math.log2(len(run) / n) for n in Counter(run).values())
        if turns >= KEY_TURNS and bits >= KEY_BITS and not any(m.start() < b and a < m.end() for _, a, b in base):
            out.append(("key", *m.span()))
    return out


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, keys."""
    base = base_spans(text)
    return base, key_spans(text, base)


def written(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed (keys and terms last), then start, comma-joined."""
    order = {k: i for i, k in enumerate((*KINDS, "key", "term"))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1])))


def context(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The whole words of at least four letters or digits beside a mention, within about 200 characters, nearest first."""
    low, high = max(0, start - 200), min(len(text), end + 200)
    while 0 < low < start and text[low - 1].isalnum():
        low += 1
    while end < high < len(text) and text[high].isalnum():
        high -= 1
    left = [m.group() for m in WORD.finditer(text, low, start)][::-1][:CONTEXT_WORDS]
    return left, [m.group() for m in WORD.finditer(text, end, high)][:CONTEXT_WORDS]


def text_hash(text: str) -> int:
    """What F.xxhash64 gives."""
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def found(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and keys (spans), and for each mention its entity and the context's hash (arrays of equal length)."""

    def run(ids: list, texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "text_hash", "base", "keys", "entities", "contexts")}
        for i, text in zip(ids, texts, strict=True):
            base, keys = all_spans(text)
            spans = base + keys
            around = [context(text, a, b) for _, a, b in spans]
            out["doc_id"].append(i)
            out["text_hash"].append(text_hash(text))
            out["base"].append(written(base))
            out["keys"].append(written(keys))
            out["entities"].append([f"{k}:{text[a:b].lower()}" for k, a, b in spans])
            out["contexts"].append([text_hash(repr(c)) for c in around])
        return out

    return per_batch(id_and_text(docs), "doc_id long, text_hash long, base string, keys string, entities array<string>, contexts array<long>", run)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes."""
    some = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("size")).first()
    return F.broadcast(df) if some["n"] <= BROADCAST_ROWS and (some["size"] or 0) <= BROADCAST_BYTES else df


def words_of(texts: DataFrame) -> DataFrame:
    """text_hash, term, outside: the distinct words of each text, and if they stand outside its base spans. texts: text_hash, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = sorted(set(WORD.findall(text)))
                free = {text[a:b] for _, a, b in term_spans(text, terms)}
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array([t in free for t in terms], pa.bool_())], names=["text_hash", "term", "outside"])

    return texts.mapInArrow(run, "text_hash long, term string, outside boolean")


def texts_with(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_term: the distinct texts that hold each of the terms (term, unique). texts: text, n_copies (null: 1). All words are counted, in each
    task before the shuffle, and then the terms are picked: in a larger corpus ever more words are asked, up to all words of all texts."""
    words = texts.select("n_copies", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))).alias("term"))
    return words.groupBy("term").agg(F.round(F.sum(1 / F.coalesce("n_copies", F.lit(1)))).alias("n_term")).join(terms, "term")


def disclosing(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """entity, term: the terms that disclose an entity. mentions: entity, text_hash, context."""
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    with_entity = mentions.groupBy("entity").agg(F.countDistinct("text_hash").alias("n_entity"), F.countDistinct("context").alias("n_contexts"))
    # An entity in fewer texts or contexts has no term with enough of them.
    with_entity = cut(with_entity.filter((F.col("n_entity") >= LEAST_CONTEXTS) & (F.col("n_contexts") >= LEAST_CONTEXTS)).drop("n_contexts"))
    if with_entity.isEmpty():
        return with_entity.select("entity", F.lit("").alias("term"))
    known = cut(mentions.select("entity", "text_hash", "context").distinct().join(small(with_entity.select("entity")), "entity"))
    holders = small(known.select("text_hash").distinct())
    terms_of = cut(words_of(texts.join(holders, "text_hash", "left_semi").dropDuplicates(["text_hash"])))
    # The texts with entities that hold a term are a lower bound of those that hold it, so what falls short by it is out for certain.
    at_least = terms_of.groupBy("term").agg(F.count(F.lit(1)).alias("n_least")).filter(F.col("n_least") >= LEAST_CONTEXTS)
    copies = cut(texts.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n_copies")))
    n = float(copies.count() + 1)
    disclosed = lambda n_term: F.log(F.lit(n) * F.col("n_both") / (F.col(n_term) * F.col("n_entity"))) / F.log(F.lit(n) / F.col("n_entity"))
    support = terms_of.join(small(known.select("entity", "text_hash").distinct()), "text_hash").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.max("outside").alias("outside"))
    support = support.filter((F.col("n_both") >= LEAST_CONTEXTS) & F.col("outside")).drop("outside")
    likely = cut(support.join(with_entity, "entity").join(at_least, "term").filter(disclosed("n_least") >= DISCLOSURE).drop("n_least"))
    if likely.isEmpty():
        return likely.select("entity", "term")
    # Counts of these terms over the whole corpus, by distinct text: each copy of a text counts its share, so nothing is kept by text.
    copies = copies.filter("n_copies > 1")
    terms = small(likely.select("term").distinct())
    with_term = texts_with(texts.join(F.broadcast(copies) if copies.count() <= 1_000_000 else copies, "text_hash", "left"), terms)
    out = cut(likely.join(with_term, "term").filter(disclosed("n_term") >= DISCLOSURE).select("entity", "term"))
    # Contexts of the entity in the texts that hold the term.
    in_contexts = terms_of.select("text_hash", "term").join(small(out.select("term").distinct()), "term").join(known, "text_hash").join(small(out), ["entity", "term"])
    return in_contexts.groupBy("entity", "term").agg(F.countDistinct("context").alias("n_contexts")).filter(F.col("n_contexts") >= LEAST_CONTEXTS).select("entity", "term")


def term_spans(text: str, terms: list[str]) -> list[tuple[str, int, int]]:
    """Spans of the terms as whole words, outside base spans and keys."""
    base, keys = all_spans(text)
    taken = sorted((a, b) for _, a, b in base + keys)
    reach = list(accumulate((b for _, b in taken), max))
    wanted = set(terms)

    def free(a: int, b: int) -> bool:
        k = bisect_left(taken, (b,)) - 1  # the last one that begins before b
        return k < 0 or reach[k] <= a

    return [("term", *m.span()) for m in WORD.finditer(text) if m.group() in wanted and free(*m.span())]


def term_lists(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """doc_id, text_hash, disclosing (array): the disclosing terms of the entities that a document mentions; None if there are none.
    rows: found(docs)."""
    zipped = rows.filter(F.size("entities") > 0).select("doc_id", "text_hash", F.explode(F.arrays_zip("entities", "contexts")).alias("m"))
    mentions = zipped.select("doc_id", "text_hash", F.col("m.entities").alias("entity"), F.col("m.contexts").alias("context"))
    known = cut(disclosing(docs, mentions))
    if known.isEmpty():
        return None
    of_entity = mentions.select("doc_id", "text_hash", "entity").distinct().join(known, "entity")
    return cut(of_entity.groupBy("doc_id", "text_hash").agg(F.collect_set("term").alias("disclosing")))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with base spans generalised to their kind's label and disclosing terms removed; a null text stays null."""
    lists = term_lists(docs, cut(found(docs)))

    @F.pandas_udf("string")
    def rewrite(text, terms):
        return text.combine(terms, lambda t, x: sanitised(t, list(x) if x is not None else []))

    joined = packed(docs, "doc_id", "text").withColumns({"_text": F.coalesce("text", F.lit("")), "_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    if lists is None:
        joined = joined.withColumn("disclosing_", F.lit(None).cast("array<string>"))
    else:
        lists = small(lists.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of"), F.col("disclosing").alias("disclosing_")))
        joined = joined.join(lists, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_of")), "left")
    return unpacked(joined, docs, text=F.when(F.col("text").isNotNull(), rewrite("_text", "disclosing_")))


def sanitised(text: str, terms: list[str]) -> str:
    base, keys = all_spans(text)
    spans = sorted(base + keys + (term_spans(text, terms) if terms else []), key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:  # spans of two kinds may overlap: the first one stands
            out += [text[at:a], LABELS[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op9_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = cut(found(docs))
    lists = term_lists(docs, rows)
    if lists is None:
        return digests(rows.select("doc_id", "base", "keys", F.lit("").alias("terms")))
    texts = id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).join(small(lists), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [written(term_spans(t, x)) for t, x in zip(b.column("text").to_pylist(), b.column("disclosing").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(terms, pa.string())], names=["doc_id", "text_hash", "terms"])

    added = texts.select("doc_id", "text_hash", "text", "disclosing").mapInArrow(run, "doc_id long, text_hash long, terms string")
    return digests(rows.join(added, ["doc_id", "text_hash"], "left").select("doc_id", "base", "keys", F.coalesce("terms", F.lit("")).alias("terms")))


def digests(rows: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter(F.split("base", ","), lambda x: x.startswith(k + ":"))).cast("long").alias(f"n_{k}")
    spans = F.array_join(F.filter(F.array("base", "keys", "terms"), lambda x: x != ""), ",")
    return rows.select("doc_id", *map(count, KINDS), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


QUERIES = {"op9_disclosure_pii": op9_disclosure_pii}
SQL: dict[str, str] = {}
