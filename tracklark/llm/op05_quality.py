"""Quality rules by distribution divergence, in DataFrame functions only: the character classes and common words of a document
are compared with its language's references by the Jensen-Shannon distance; texts under a minimum length, of
all characters, are not judged. Digits are in no class but have a largest share of their own.

The reference of a language is the median, over its documents that pass the base rules, of each class's share in thousandths
(the exact median of at most 1,001 distinct values, so bounded state and no pull by a junk source with under half the rows).

Defined results: a null or empty text has no words and fails the base rules; a null or unlisted language is judged by character
classes against the pooled reference "other"; repeated rows are judged alike; an empty table gives an empty table; further
columns pass through filter_quality unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.llm.common import cut, documents, packed, unpacked

# The most frequent words of each language, of at most three letters.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in"],
    "de": ["der", "die", "und", "in", "den"],
    "fr": ["de", "la", "le", "et", "les"],
    "es": ["de", "la", "que", "el", "en"],
}
N_COMMON = 5
# Character classes as regular expressions' sets, beside a-z and white space; what is in none is the class "rest".
# Digits are in no class: a number or two in a short, clean text would weigh more than junk does. They count for a text's length, and
# have a limit of their own.
CLASSES = {"upper": "A-Z", "mark": r".,;:!?'\"()-", "symbol": r"#*$%&|<>"}
DIGITS = "0-9"
N_CLASSES = len(CLASSES) + 3
WHITE = " \t\n\x0b\x0c\r"
#: Largest Jensen-Shannon distances (base 2) to the references, and the lengths from which they are judged.
MOST_CHAR_DISTANCE, LEAST_CHARS = 0.165, 200
MOST_WORD_DISTANCE, LEAST_WORDS = 0.18, 100
#: Largest share of digits in all characters but white space, in per cent, for texts from LEAST_CHARS on.
MOST_DIGITS = 30


def features(docs: DataFrame) -> DataFrame:
    """docs with the base counts and two histograms: _chars (classes, white space, a-z, rest) and _words (common words, others)."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    known = F.map_from_arrays(F.array(*map(F.lit, COMMON_WORDS)), F.array(*(F.array(*map(F.lit, v)) for v in COMMON_WORDS.values())))
    lang = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise("other")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    docs = docs.select("*", words.alias("_w"), F.length(text).cast("long").alias("_n"), lines.alias("_lines"), lang.alias("_lang"), known[lang].alias("_common"))
    # Three-word windows as hashes; _dup holds those found twice or more, with their places.
    windows = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    solid = F.array_join("_w", "")
    keep = [c for c in docs.columns if c not in ("_w", "_lines")]
    docs = docs.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        F.regexp_replace(solid, "[a-z]+", "").alias("_odd"),
        F.filter("_w", lambda x: F.octet_length(x) <= 3).alias("_short"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_h"),
    )
    with_place = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.select(*(c for c in docs.columns if c not in ("_h", "_odd", "_short", "_common")), *(F.length(F.regexp_replace("_odd", f"[^{v}]+", "")).cast("long").alias(f"_{k}") for k, v in CLASSES.items()), F.length(F.regexp_replace("_odd", f"[{DIGITS}]+", "")).alias("_n_odd"), F.length("_odd").alias("_n_with_digits"), *((F.size("_short") - F.size(F.array_remove("_short", F.get("_common", F.lit(i))))).cast("long").alias(f"_c{i}") for i in range(N_COMMON)), F.when(F.size(F.array_distinct("_h")) < F.size("_h"), with_place).alias("_dup"))
    again = F.filter("_dup", lambda x, i: (F.get("_dup", i - 1)["h"] == x["h"]) | (F.get("_dup", i + 1)["h"] == x["h"]))
    # A window covers three words, or those up to the next window's start.
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at")), lambda acc: acc["n"])
    named = [F.col(f"_{k}") for k in CLASSES]
    found = [F.col(f"_c{i}") for i in range(N_COMMON)]
    repeat = F.coalesce(covered, F.lit(0).cast("long"))
    out = docs.select(
        *(c for c in docs.columns if c not in ("_dup", "_n", "_n_odd", "_n_with_digits", *(f"_{k}" for k in CLASSES), *(f"_c{i}" for i in range(N_COMMON)))),
        F.col("_symbol").alias("n_symbols"),
        repeat.alias("n_repeat_words"),
        F.col("_n").alias("_size"),
        (F.col("_n_with_digits") - F.col("_n_odd")).cast("long").alias("_digits"),
        F.array(*named, F.col("_n") - F.col("word_chars"), F.col("word_chars") - F.col("_n_with_digits"), F.col("_n_odd") - sum(named, F.lit(0))).alias("_chars"),
        F.when(F.col("_lang") != "other", F.array(*found, F.col("n_words") - sum(found, F.lit(0)))).alias("_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(rows: DataFrame) -> DataFrame:
    """_lang, _ref_chars, _ref_words: at most one row for each listed language and one for the rest."""
    good = rows.filter("not base_failed")

    def medians(name: str, n: int, total: str) -> Column:
        share = lambda i: F.floor(1000 * F.get(name, F.lit(i)) / F.col(total) + 0.5)
        return F.array(*(F.percentile(share(i), 0.5) for i in range(n)))

    good = good.withColumn("_n_chars", F.aggregate("_chars", F.lit(0).cast("long"), lambda a, x: a + x))
    own = good.groupBy("_lang").agg(medians("_chars", N_CLASSES, "_n_chars").alias("_ref_chars"), medians("_words", N_COMMON + 1, "n_words").alias("_ref_words"))
    pooled = good.select(F.lit("other").alias("_lang"), "_chars", "_n_chars").groupBy("_lang").agg(medians("_chars", N_CLASSES, "_n_chars").alias("_ref_chars"))
    return own.filter("_lang != 'other'").unionByName(pooled.withColumn("_ref_words", F.lit(None).cast("array<double>")))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms (not normalised); null if either is null or sums to 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def both(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return term(a, m) / 2 + term(b, m) / 2

    shares = F.zip_with(p, q, lambda a, b: both(a / F.nullif(total(p), F.lit(0.0)), b / F.nullif(total(q), F.lit(0.0))))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(shares, F.lit(0.0), lambda a, v: a + v)))


def judged(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows of features() with char_distance, word_distance and kept in place of the histograms."""
    rows = rows.join(F.broadcast(refs), "_lang", "left")  # refs: at most five rows
    rows = rows.withColumns({"char_distance": js_distance(F.col("_chars"), F.col("_ref_chars")), "word_distance": js_distance(F.col("_words"), F.col("_ref_words"))})
    long_enough = F.col("_size") >= LEAST_CHARS
    odd_chars = long_enough & (F.coalesce("char_distance", F.lit(0.0)) > MOST_CHAR_DISTANCE)
    odd_digits = long_enough & (100 * F.col("_digits") > MOST_DIGITS * F.col("word_chars"))
    odd_words = (F.col("n_words") >= LEAST_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return rows.withColumn("kept", ~F.col("base_failed") & ~odd_chars & ~odd_digits & ~odd_words).drop("_lang", "_size", "_digits", "_chars", "_words", "_ref_chars", "_ref_words")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept; the references are those of docs. Features are worked out once, in a table beside the rows."""
    measured = cut(features(packed(docs, "text", "lang")).drop("text", "lang"))
    return unpacked(judged(measured, references(measured)).filter("kept"), docs)


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(features(documents(spark, sf_dir).select("doc_id", "text", "lang")).drop("text", "lang"))
    return judged(rows, references(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op5_quality_divergence": op5_quality_divergence}


def _sql() -> str:
    classes = [f"length(regexp_replace(solid, '[^{v.replace(chr(39), chr(39) * 2)}]', '', 'g'))" for v in CLASSES.values()]
    lower = "length(regexp_replace(solid, '[^a-z]', '', 'g'))"
    digits = f"length(regexp_replace(solid, '[^{DIGITS}]', '', 'g'))"
    lists = " ".join(f"WHEN '{k}' THEN {v}" for k, v in COMMON_WORDS.items())
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON_WORDS)}) THEN lang ELSE 'other' END AS lang,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents
), b AS (
  SELECT *, len(a) AS n_words, array_to_string(a, '') AS solid, CASE lang {lists} END AS common,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w
), t AS (SELECT doc_id, a, unnest(range(1, n_words - 1)) AS i FROM b),
d AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, a[i], a[i + 1], a[i + 2]) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (
  SELECT b.doc_id, lang, n_words, length(solid) AS word_chars, {classes[2]} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, 
         [{", ".join(classes)}, length(text) - length(solid), {lower}, length(solid) - {lower} - {" - ".join(classes)} - {digits}] AS chars,
         CASE WHEN common IS NOT NULL THEN list_append(list_transform(common, lambda c: len(list_filter(a, lambda x: x = c))), len(list_filter(a, lambda x: NOT list_contains(common, x)))) END AS words,
         length(text) AS size, {digits} AS n_digits
  FROM b LEFT JOIN r ON r.doc_id = b.doc_id
), g AS (SELECT *, list_sum(chars) AS n_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
c AS (SELECT doc_id, lang, base_failed, 'c' AS part, unnest(chars) AS v, generate_subscripts(chars, 1) AS j, n_chars AS total FROM g
      UNION ALL SELECT doc_id, lang, base_failed, 'w', unnest(words), generate_subscripts(words, 1), n_words FROM g WHERE words IS NOT NULL),
m AS (SELECT lang, part, j, quantile_cont(floor(1000 * v / total + 0.5), 0.5) AS q FROM c WHERE NOT base_failed AND lang <> 'other' GROUP BY ALL
      UNION ALL SELECT 'other', part, j, quantile_cont(floor(1000 * v / total + 0.5), 0.5) FROM c WHERE NOT base_failed AND part = 'c' GROUP BY ALL),
q AS (SELECT lang, part, j, q / sum(q) OVER (PARTITION BY lang, part) AS q FROM m),
x AS (SELECT doc_id, part, v / total AS p, q, (v / total + q) / 2 AS h FROM c JOIN q USING (lang, part, j) WHERE total > 0),
y AS (SELECT doc_id, part, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / h) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / h) ELSE 0 END) / 2)) AS far FROM x GROUP BY ALL)
SELECT g.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (size >= {LEAST_CHARS} AND (coalesce(yc.far, 0) > {MOST_CHAR_DISTANCE} OR 100 * n_digits > {MOST_DIGITS} * word_chars)) AND NOT (n_words >= {LEAST_WORDS} AND coalesce(yw.far, 0) > {MOST_WORD_DISTANCE}) AS kept
FROM g LEFT JOIN y yc ON yc.doc_id = g.doc_id AND yc.part = 'c' LEFT JOIN y yw ON yw.doc_id = g.doc_id AND yw.part = 'w'
"""


SQL = {"op5_quality_divergence": _sql()}
