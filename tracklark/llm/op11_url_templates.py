"""URL filters by a tree of path templates, in DataFrame functions only.

Rules of (host, path) come first: a rule fits its host and all subdomains if the path starts with the rule's, and the longest that
fits decides. All other urls are judged by the template of their path, learned for each host from labelled pages:

1. Runs of digits and long opaque tokens in a segment are wildcards by their looks; distinct skeletons of a host are counted, so what
   follows works on skeletons, not on pages. Segments beyond LEVELS are one wildcard for the tail.
2. From the root down, each branch of a node stays literal, or is generalised: branches with fewer than LEAST_PAGES pages become `*`,
   and branches with enough labels whose share of bad pages and whose continuation (ends, wildcard or word next) are like those of
   their pooled siblings merge into `+`. A branch is compared with the pool, not with each sibling, so a node with very many
   branches costs one aggregation and one join.
3. A template is rejected where its share of bad pages, smoothed by PRIOR (bad, good) pages, exceeds MOST_BAD.

Labels are a table (page_id, bad); without one, the urls that a rule judges are the labelled ones. A template without labels has the
prior's share, so urls that nothing is known about are allowed.

Defined results: a url that is null or without :// has an empty host and path, and goes by the (empty) template of that host;
a page_id that stands in several rows is judged for each row; labels that are null or contradict each other for one page count once,
bad if any is; only A-Z are lower-cased, paths are compared as written; an empty table gives an empty table; further columns do not
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.llm.common import cut, discard

#: (verdict, host and path), tried from the longest on.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Segments of a template; those beyond are one wildcard.
LEVELS = 8
#: Pages under which a branch is generalised, and labelled pages from which it can be merged.
LEAST_PAGES, LEAST_LABELS = 5, 5
#: Merged branches differ from the pool by at most this share of their pages' continuations, and by this share of bad pages or
#: this many standard errors.
MOST_SHAPE, MOST_SHARE, MOST_ERRORS = 0.1, 0.05, 2.0
#: Bad and good pages of the prior, and the largest smoothed share of bad pages.
PRIOR, MOST_BAD = (1.0, 3.0), 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Opaque tokens: at least sixteen letters, digits, _ and - with a digit among them.
OPAQUE = "^[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*$"
OPAQUE_CHARS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, with A-Z lower-cased, and the path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^([^?#]*)", 1)
    none = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), none), F.coalesce(path, none)


def by_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule and its verdict, null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda x: len(x[1])):  # the last one wraps the others, so the longest is tried first
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def skeleton(path: Column) -> Column:
    """The segments of a path, wildcards by their looks in place of what varies; <n> digits, <t> opaque tokens, ** the tail."""
    seen = F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.when((F.length(s) >= OPAQUE_CHARS) & s.rlike(OPAQUE), F.lit("<t>")).otherwise(F.regexp_replace(s, "[0-9]+", "<n>")),
    )
    return F.when(F.size(seen) > LEVELS, F.concat(F.slice(seen, 1, LEVELS), F.array(F.lit("**")))).otherwise(seen)


def grown(rows: DataFrame, level: int) -> DataFrame:
    """rows (host, template, segments, pages, labels, bad), each template longer by the branch that segment number level takes."""
    here = F.get("segments", F.lit(level))
    follows = F.get("segments", F.lit(level + 1))
    share = lambda c: F.sum(F.when(c, F.col("pages")).otherwise(0))
    ends, wild = follows.isNull(), follows.contains("<") | (follows == "**")
    at = ["host", "template"]
    branches = rows.filter(here.isNotNull()).groupBy(*at, here.alias("segment")).agg(F.sum("pages").alias("n"), F.sum("labels").alias("l"), F.sum("bad").alias("b"), share(ends).alias("e"), share(~ends & wild).alias("w"))
    known = F.when(F.col("l") >= LEAST_LABELS, 1).otherwise(0)
    pool = branches.filter(known == 1).groupBy(*at).agg(F.count(F.lit(1)).alias("members"), *(F.sum(c).cast("double").alias(f"p_{c}") for c in "nlbew"))
    rate, pooled = F.col("b") / F.col("l"), F.col("p_b") / F.col("p_l")
    apart = sum((F.abs(F.col(c) / F.col("n") - F.col(f"p_{c}") / F.col("p_n")) for c in "ew"), F.abs((F.col("n") - F.col("e") - F.col("w")) / F.col("n") - (F.col("p_n") - F.col("p_e") - F.col("p_w")) / F.col("p_n"))) / 2
    off = F.abs(rate - pooled)
    like = (F.col("members") >= 2) & (F.col("l") >= LEAST_LABELS) & (apart <= MOST_SHAPE) & ((off <= MOST_SHARE) | (off * off * F.col("l") <= MOST_ERRORS**2 * pooled * (1 - pooled)))
    plain = ~F.col("segment").contains("<") & (F.col("segment") != "**")
    token = F.when(plain & (F.col("n") < LEAST_PAGES), F.lit("*")).when(plain & F.coalesce(like, F.lit(False)), F.lit("+")).otherwise(F.col("segment"))
    taken = branches.join(pool, at, "left").select(*at, "segment", token.alias("token"))
    longer = F.when(F.col("token").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "token"))
    return rows.withColumn("segment", here).join(taken, [*at, "segment"], "left").select("host", longer.alias("template"), "skeleton", "segments", "pages", "labels", "bad")


def templates(pages: DataFrame) -> DataFrame:
    """host, skeleton, template, template_pages, template_labels, purity (smoothed share of bad pages). pages: host, path, bad (null
    without a label)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    found = pages.withColumn("segments", skeleton(F.col("path"))).groupBy("host", "segments").agg(F.count(F.lit(1)).alias("pages"), n(F.col("bad").isNotNull()).alias("labels"), n(F.col("bad")).alias("bad"))
    rows = cut(found.select("host", F.lit("").alias("template"), F.array_join("segments", "/").alias("skeleton"), "segments", "pages", "labels", "bad"))
    deep = rows.agg(F.max(F.size("segments"))).first()[0]
    for level in range(deep or 0):
        # A level reads the one before three times, so each is written.
        before, rows = rows, cut(grown(rows, level))
        discard(before)
    own = rows.groupBy("host", "template").agg(F.sum("pages").alias("template_pages"), F.sum("labels").alias("template_labels"), ((F.sum("bad") + F.lit(PRIOR[0])) / (F.sum("labels") + F.lit(sum(PRIOR)))).alias("purity"))
    return rows.select("host", "template", "skeleton").join(own, ["host", "template"])


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, template_pages, template_labels, purity. pages: page_id, url."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, says = by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))
    if labels is None:
        rows = rows.withColumn("bad", F.col("says") == "block")
    else:
        known = labels.filter("page_id is not null and bad is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.bool_or("bad").alias("bad"))
        rows = rows.join(known, "page_id", "left")
    learned = templates(rows)
    rows = rows.withColumn("skeleton", F.array_join(skeleton(F.col("path")), "/")).join(learned, ["host", "skeleton"])
    own = F.when(F.col("purity") > MOST_BAD, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("says", own).alias("verdict"), "template", "template_pages", "template_labels", F.round("purity", 9).alias("purity"))


def op11_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql(rules: list[tuple[str, str]] = RULES) -> str:
    cases = lambda say: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{v if say else r}'" for v, r in sorted(rules, key=lambda x: -len(x[1])) for h, _, p in [r.partition("/")]) + " END"
    sql = f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), seen AS (
  SELECT page_id, host, path, {cases(False)} AS rule, {cases(True)} AS says,
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN length(s) >= {OPAQUE_CHARS} AND regexp_matches(s, '{OPAQUE}') THEN '<t>' ELSE regexp_replace(s, '[0-9]+', '<n>', 'g') END) AS all_
  FROM split
), labelled AS (
  SELECT *, CASE WHEN len(all_) > {LEVELS} THEN list_concat(all_[1:{LEVELS}], ['**']) ELSE all_ END AS segments FROM seen
), level0 AS (
  SELECT host, '' AS template, array_to_string(segments, '/') AS skeleton, segments, count(*) AS pages, count(says) AS labels, count(*) FILTER (says = 'block') AS bad
  FROM labelled GROUP BY host, segments
)"""
    for i in range(LEVELS + 1):
        wild = f"(segments[{i + 2}] LIKE '%<%' OR segments[{i + 2}] = '**')"
        sql += f""", branch{i} AS (
  SELECT host, template, segments[{i + 1}] AS segment, sum(pages) AS n, sum(labels) AS l, sum(bad) AS b,
         sum(CASE WHEN segments[{i + 2}] IS NULL THEN pages ELSE 0 END) AS e, sum(CASE WHEN {wild} THEN pages ELSE 0 END) AS w
  FROM level{i} WHERE segments[{i + 1}] IS NOT NULL GROUP BY 1, 2, 3
), pool{i} AS (
  SELECT host, template, count(*) AS members, sum(n)::double AS pn, sum(l)::double AS pl, sum(b)::double AS pb, sum(e)::double AS pe, sum(w)::double AS pw
  FROM branch{i} WHERE l >= {LEAST_LABELS} GROUP BY 1, 2
), taken{i} AS (
  SELECT host, template, segment, CASE WHEN segment LIKE '%<%' OR segment = '**' THEN segment WHEN n < {LEAST_PAGES} THEN '*'
         WHEN members >= 2 AND l >= {LEAST_LABELS} AND (abs((n - e - w) / n - (pn - pe - pw) / pn) + abs(e / n - pe / pn) + abs(w / n - pw / pn)) / 2 <= {MOST_SHAPE}
              AND (abs(b / l - pb / pl) <= {MOST_SHARE} OR abs(b / l - pb / pl) * abs(b / l - pb / pl) * l <= {MOST_ERRORS**2} * (pb / pl) * (1 - pb / pl)) THEN '+'
         ELSE segment END AS token
  FROM (SELECT host, template, segment, n::double AS n, l::double AS l, b::double AS b, e::double AS e, w::double AS w FROM branch{i}) LEFT JOIN pool{i} USING (host, template)
), level{i + 1} AS (
  SELECT a.host, a.template || coalesce('/' || t.token, '') AS template, a.skeleton, a.segments, a.pages, a.labels, a.bad
  FROM level{i} a LEFT JOIN taken{i} t ON a.host = t.host AND a.template = t.template AND a.segments[{i + 1}] = t.segment
)"""
    return sql + f""", learned AS (
  SELECT host, template, sum(pages)::bigint AS template_pages, sum(labels)::bigint AS template_labels, (sum(bad)::double + {PRIOR[0]}) / (sum(labels)::double + {sum(PRIOR)}) AS purity
  FROM level{LEVELS + 1} GROUP BY host, template
)
SELECT page_id, l.host, path, rule, coalesce(says, CASE WHEN purity > {MOST_BAD} THEN 'block' ELSE 'allow' END) AS verdict, s.template, template_pages, template_labels, round(purity, 9) AS purity
FROM labelled l JOIN level{LEVELS + 1} s ON l.host = s.host AND array_to_string(l.segments, '/') = s.skeleton JOIN learned t ON s.host = t.host AND s.template = t.template"""


QUERIES = {"op11_path_template_tree": op11_path_template_tree}
SQL = {"op11_path_template_tree": _sql()}
