"""Path templates, ranked search and hard negatives against plain versions, on small tables with every odd case."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.oracle import check
from tracklark.llm import op11_url_templates, op12_lexical_search, op13_hard_negatives

RULES = op11_url_templates.RULES
URLS = [
    None, "", "no scheme", "http://", "http://Foo.Example.COM", "https://WWW.example.com/en/1", "http://example.com/en/", "http://example.com/en", "http://xexample.com/en/1",
    "http://a.b.example.com/en/x?u=http://z.net/es/", "http://foo.net/es/5#a/b", "http://foo.net?x=/es/", "http://foo.net/ES/5", "ftp://foo.org#frag", "http://É.org/ü/1", "://x.com/y", "http://net/fr/", "http://foo.net//es/1",
    "http://deep.org/" + "/".join(f"s{i}" for i in range(300)), "http://long.org/" + "y" * 50_000, "http://foo.com:80/en/",
]


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return host, path, *best


@pytest.fixture(scope="module")
def pages(spark):
    urls = URLS + [f"http://shop.org/{a}/{i}" for a in ("good", "fine", "bad", "evil") for i in range(40)] + [f"http://shop.org/rare{i}x/list" for i in range(30)]
    return spark.createDataFrame([(i, u, "<p>", "h", "r", 1) for i, u in enumerate(urls)] + [(0, None, "twice", "h", "r", 1)], "page_id long, url string, html string, host string, segment string, pages int")


def test_op11_rules(pages):
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    rows = op11_url_templates.judged(pages).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, rule, verdict = plain_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"])


def test_op11_templates(spark, pages):
    """Branches with like labels merge, others stay apart; rare ones become one wildcard; templates with bad pages are rejected."""
    ids = {r["url"]: r["page_id"] for r in pages.collect()}
    labels = [(i, "/bad/" in u or "/evil/" in u) for u, i in ids.items() if u and "shop.org" in u and "rare" not in u]
    labels += [(ids["http://shop.org/good/1"], None), (None, True), (labels[0][0], False)]
    got = {r["page_id"]: r for r in op11_url_templates.judged(pages, [], spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    at = lambda u: (got[ids[u]]["template"], got[ids[u]]["verdict"])
    assert at("http://shop.org/bad/1") == ("/bad/<n>", "block") and at("http://shop.org/good/7") == ("/good/<n>", "allow")
    assert at("http://shop.org/rare3x/list") == ("/rare<n>x/list", "allow")
    assert got[ids[URLS[18]]]["template"].count("/") == op11_url_templates.LEVELS + 1 and got[ids[URLS[18]]]["template"].endswith("/**")
    # All alike: one merged branch.
    even = spark.createDataFrame([(i, True) for i, _ in labels[:-3]], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in op11_url_templates.judged(pages, [], even).collect()}
    assert {at(f"http://shop.org/{x}/3") for x in ("good", "bad", "evil", "fine")} == {("/+/<n>", "block")}
    assert op11_url_templates.judged(pages.limit(0)).count() == 0


def test_op11_equals_its_sql(spark, pages, tmp_path):
    """On the fixture, with rules as labels."""
    for t in "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    more = [(1000 + i, f"http://s{i % 3}.net/{['es', 'fr', 'en', 'de', 'x'][i % 5]}/{i}{['', '.html', '/a/b'][i % 3]}") for i in range(400)]
    pages.select("page_id", "url").union(spark.createDataFrame(more, "page_id long, url string")).coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("part-*")).rename(tmp_path / "pages.parquet")
    check(spark, op11_url_templates.op11_path_template_tree, op11_url_templates.SQL["op11_path_template_tree"], str(tmp_path))


def plain_ranks(docs, items, k=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = defaultdict(list)
    for item, text in set(items):
        if item is None:
            continue
        asked, scores = Counter(split(text)), []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out[item] += [(r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return {i: sorted(x) for i, x in out.items() if x}


@pytest.mark.parametrize("sizes", [None, (40, 2, 3), (1 << 20, 1, 1), (300, 1024, 7)])
def test_op12(spark, docs, texts, monkeypatch, sizes):
    """One shard, and many shards and blocks; a vocabulary that is broadcast, and one that is joined."""
    if sizes:
        for name, value in zip(("SHARD_POSTINGS", "BLOCK_ITEMS", "STEP_NODES"), sizes, strict=True):
            monkeypatch.setattr(op12_lexical_search, name, value)
        monkeypatch.setattr(op12_lexical_search, "BROADCAST_BYTES", 0)
    rng = random.Random(2)
    every = [w for t in texts.values() if t for w in t.split()[:200]]
    items = [(i, " ".join(rng.choices(every, k=rng.randrange(1, 60)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "no such terms qqq"), (23, "word WORD Word"), (24, texts[10]), (24, texts[10]), (25, texts[63]), (26, "naïve 🙂 É é"), (None, "word"), (0, "two words")]
    more = [(100, "two words two"), (100, "two words"), (101, "two words"), (None, "two words words")]
    every_doc = docs.select("doc_id", "text", "rank", "n").union(spark.createDataFrame([(i, t, 1, 1) for i, t in more], "doc_id long, text string, rank long, n long"))
    table = spark.createDataFrame([(i, t, 3, 4) for i, t in items], "item_id long, text string, rank int, score int")
    got = defaultdict(list)
    for r in op12_lexical_search.ranked(every_doc, table).collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    assert {i: sorted(x) for i, x in got.items()} == plain_ranks([*texts.items(), *more], items)


def test_op12_empty(spark, docs):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert op12_lexical_search.ranked(docs.limit(0), items).count() == 0
    assert op12_lexical_search.ranked(docs, items.limit(0)).count() == 0


def test_wavelet_tree_reads_lists_by_document():
    rng = np.random.default_rng(1)
    docs, impacts = rng.integers(0, 50, 400), rng.integers(1, 9, 400)
    tree = op12_lexical_search.WaveletTree(docs, impacts, 50)
    low, high, node = np.array([[0]]), np.array([[400]]), 0
    for level in range(tree.depth):
        zero, one = tree.children(np.array([level]), low, high)
        bit = (37 >> (tree.depth - 1 - level)) & 1
        (low, high), node = (one if bit else zero), node * 2 + bit
    assert node == 37 and tree.impacts[tree.depth, low[0, 0] : high[0, 0]].tolist() == impacts[docs == 37].tolist()


def plain_negatives(rows, positives=5, negatives=3):
    good = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for a, label, v in good:
        if a % 50:
            continue
        near = lambda like: sorted((-sum(p * q for p, q in zip(v, w)), i) for i, other, w in good if i != a and len(w) == len(v) and (other == label) == like)
        others = near(False)
        for s, p in near(True)[:positives]:
            fits = [(t, i) for t, i in others if 50 * -s <= 100 * -t <= 95 * -s]
            out |= {(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fits[:negatives], 1)}
    return out


@pytest.mark.parametrize("sizes", [None, (4, 60, 2, 8), (2, 200, 3, 16)])
@pytest.mark.parametrize("hot", [False, True])
def test_op13(spark, monkeypatch, sizes, hot):
    """Clusters, copies, zeros, a hot label; one range, and many ranges and blocks."""
    if sizes:
        for name, value in zip(("PIVOTS", "RANGE_ROWS", "BLOCK_ROWS", "CHUNK_ROWS"), sizes, strict=True):
            monkeypatch.setattr(op13_hard_negatives, name, value)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 12))
    x = (centres[rng.integers(0, 6, 500)] + 0.3 * rng.standard_normal((500, 12))).astype("float32")
    x[100:140] = x[50]  # copies, all with the same scores
    x[200:203] = 0
    labels = [1 if hot and i % 3 else int(i % 4) for i in range(500)]
    rows = [(i, labels[i], v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0], rows[50], (500, None, [1.0] * 12), (550, 1, None), (600, 1, [float("nan")] * 12), (650, 1, [float("inf")] * 12), (700, 1, [1.0, None] * 6), (None, 1, [1.0] * 12), (750, 9, [2.0] * 12), (751, 1, [1.0, 2.0]), (800, 1, [1.0, 2.0]), (801, 2, [0.5, 1.2]), (850, 3, [])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, rank int, pivot string")
    got = op13_hard_negatives.mined(table, table.vec_id % 50 == 0)
    assert {tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()} == plain_negatives(rows)
    assert op13_hard_negatives.mined(table.limit(0), table.vec_id % 50 == 0).count() == 0


def test_op13_scans_only_what_can_matter(spark, monkeypatch):
    """With clusters apart, most ranges are outside of what an anchor needs."""
    monkeypatch.setattr(op13_hard_negatives, "RANGE_ROWS", 50)
    asked = []
    scan = op13_hard_negatives.scan
    monkeypatch.setattr(op13_hard_negatives, "scan", lambda index, anchors, pairs, *rest: (asked.append((pairs.count(), index.select("range_id").distinct().count(), anchors.count())), scan(index, anchors, pairs, *rest))[1])
    rng = np.random.default_rng(6)
    centres = 10 * rng.standard_normal((16, 8))
    x = centres[np.arange(800) % 16] + 0.1 * rng.standard_normal((800, 8))
    table = spark.createDataFrame([(i, i % 16 // 4, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    rows = [(i, i % 16 // 4, v.tolist()) for i, v in enumerate(x)]
    got = op13_hard_negatives.mined(table, table.vec_id % 50 == 0)
    assert {tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()} == plain_negatives(rows)
    pairs, ranges, anchors = asked[1]
    assert pairs < ranges * anchors / 2
