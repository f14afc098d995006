import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm import brute
from tests.llm.conftest import SCHEMA
from tests.oracle import check
from tracklark.llm import op01_jaccard, op02_forest, op03_license, op04_token_counts, op05_quality, op06_line_dedup, op07_repeats, op08_bpe, op09_pii, op10_packing

TIK, JSON, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture
def through_queries(monkeypatch, docs):
    """Lets a query read the fixture in place of a table."""
    import sys

    for name, module in list(sys.modules.items()):
        if name.startswith("tracklark.llm.op") and hasattr(module, "documents"):
            monkeypatch.setattr(module, "documents", lambda spark, folder: docs)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_op1(docs, texts):
    for k, percent in ((4, 85), (5, 80)):
        got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(op01_jaccard.similar_components(docs, k, percent)).items()}
        assert got == brute.similar(texts, k, percent)


def test_op1_drops_all_but_one(docs, texts):
    got = op01_jaccard.drop_near_copies(docs, 5, 80)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {i for i, (_, c) in brute.similar(texts, 5, 80).items() if i == c}


def test_op2(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8)).astype("float32")
    x[50:90] = x[50]  # a hot vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [1.0, None] * 4, 1), (404, [], 1), (450, [1.0, 2.0], 1), (0, x[0].tolist(), 1), (None, x[1].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = op02_forest.nearest(table, table.vec_id % 50 == 0, share=1.0).collect()
    d = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for q in range(0, 400, 50):
        s = d @ d[q]
        s[q] = -9
        want = sorted(range(400), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == want and np.allclose([r["score"] for r in mine], s[want])
    assert not [r for r in got if r["query_id"] in (400, 450)]
    assert op02_forest.nearest(table.limit(0), table.vec_id % 50 == 0).count() == 0


def test_op2_recall_at_the_real_share(spark):
    """Vectors without structure, several shards and blocks, copies and scaled copies among them."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64)).astype("float32")
    x[1000:1040] = x[50]
    x[2000] = 3 * x[100]  # the same direction: equal cosines
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = op02_forest.nearest(table, table.vec_id % 50 == 0).collect()
    d = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        s = np.round(d @ d[q], 12)
        s[q] = -9
        want = sorted(range(3000), key=lambda i: (-s[i], i))[:5]
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(mine) == 5
        hits += len(set(want) & set(mine))
    assert hits >= 0.9 * 5 * 60


def test_op3(docs):
    got = by_id(op03_license.license_scan(docs))
    assert got[62]["license"] == "MIT" and got[62]["coverage"] == 1.0 and (got[62]["start_word"], got[62]["end_word"]) == (0, 5)
    assert all(r["n_licenses"] == 0 for i, r in got.items() if i != 62)


def test_op3_alignment():
    assert op03_license.increasing([3, 1, 2, 5, 4, 6]) in ([1, 2, 3, 5], [1, 2, 4, 5])
    assert op03_license.align("a x b c d".split(), "a b y c d".split()) == [(0, 0), (2, 1), (3, 3), (4, 4)]
    changed = "permission is hereby freely granted free of any charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"
    hits = op03_license.scan(changed, {k: op03_license.TOKEN.findall(v.lower()) for k, v in op03_license.TEMPLATES.items()}, 0.85)
    assert hits[0][0] == "MIT-grant"


def test_op3_two_copies_amid_prose():
    """Every word of the notice stands at least twice, and others of its words lie before, between and after the copies."""
    parsed = {k: op03_license.TOKEN.findall(v.lower()) for k, v in op03_license.TEMPLATES.items()}
    t = parsed["Apache-2.0-header"]
    prose = "this is not the file of the law that you may use at will in any other way except when you obtain a license".split()
    for apart in (0, 3, 60):
        text = prose * 3 + t + (prose * 3)[:apart] + t + prose[::-1] * 3
        assert ("Apache-2.0-header", 1.0, len(prose) * 3, len(prose) * 3 + len(t)) in op03_license.scan(" ".join(text), parsed, 0.9)
    # One copy in a long text in which each of its words stands elsewhere too, out of order.
    text = prose * 40 + sorted(t) + prose * 40 + t + prose * 40 + sorted(t)
    assert op03_license.scan(" ".join(text), parsed, 0.9)[0][1:2] == (1.0,)


def test_op3_against_every_window():
    rng = random.Random(8)
    templates = {"short": "a b a c d".split(), "long": "e a b f a g h c b a".split(), "same": "a a b a".split()}
    hits = less = 0
    for _ in range(300):
        text = [rng.choice("aabbcdefghxyz") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            copy = [w for w in templates[rng.choice(sorted(templates))] if rng.random() < 0.9]
            at = rng.randrange(len(text) + 1)
            text[at:at] = copy
        each = {name: [brute.covered(text, t, int(x * len(t))) for x in op03_license.STRETCHES] for name, t in templates.items()}
        for least in (0.7, 0.9):
            most = {k: next((n for n in x if n >= least * len(templates[k])), 0) for k, x in each.items()}
            got = {name: (c, s, e) for name, c, s, e in op03_license.scan(" ".join(text), templates, least)}
            assert {k: c for k, (c, _, _) in got.items()} == {k: n / len(templates[k]) for k, n in most.items() if n}, text
            for name, (_, s, e) in got.items():
                assert e - s <= int(max(op03_license.STRETCHES) * len(templates[name]))
                assert text[s] in templates[name] and text[e - 1] in templates[name] and brute.longest(text[s:e], templates[name]) >= most[name]
                less += brute.longest(text[s:e], templates[name]) > most[name]
            hits += len(got)
    assert hits > 300 and less > 0


def test_op3_alignment_decides():
    """A moved unique word is an anchor of its own chain: the alignment may match fewer words than the longest common subsequence."""
    a, b = "x y p p q q".split(), "p p q q x y".split()
    assert len(op03_license.align(a, b)) == brute.patience(a, b) == 2 and brute.longest(a, b) == 4
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = op03_license.align(a, b)
        assert len(pairs) == brute.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        whole = op03_license.subsequence(a, 0, len(a), b, 0, len(b))
        assert len(whole) == brute.longest(a, b) and all(a[i] == b[j] for i, j in whole)


def test_op3_whole_licence():
    """A template of 5,000 words, twice in a text, with one word in fifty gone from one copy and two in a hundred from the other."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(5000)]
    prose = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    text = prose + [w for w in words if rng.random() > 0.02] + prose[::-1] + [w for w in words if rng.random() > 0.04] + prose
    (name, coverage, start, end), = op03_license.scan(" ".join(text), {"whole": words}, 0.9)
    assert name == "whole" and 0.97 < coverage < 1 and abs(start - 4000) < 100 and abs(end - 8900) < 100


def test_op3_ties():
    """Equal coverage: the longer template, then the name; the shortest place, then the first."""
    t = {"b": "p q r s".split(), "a": "p q r s".split(), "longer": "p q r s t".split()}
    assert op03_license.scan("p x q r s t p q r s t p q r s t", t, 0.8) == [("longer", 1.0, 6, 11), ("a", 1.0, 6, 10), ("b", 1.0, 6, 10)]


def test_op4(docs, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD)
    for i, r in by_id(op04_token_counts.token_counts(docs, WORD, 20)).items():
        n = len(plain.encode(texts[i] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[i] or "").encode()), n, n > 20)


def test_op5_base(docs, texts):
    rows = by_id(op05_quality.features(docs))
    for i, r in rows.items():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.quality_base(texts[i]), i
        n, rep = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)


def test_op5_verdict(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abdeinorst") for _ in range(rng.randrange(4, 9)))
    good = [(i, " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.15 else word() for _ in range(200)) + ".", "en") for i in range(20)]
    junk = [(100, " ".join(f"Xa{j}###" + "|" for j in range(120)), "en"), (101, " ".join(chr(65 + j % 26) * 5 + chr(65 + j // 26) + "!!" for j in range(200)), "en")]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in op05_quality.filter_quality(docs).collect()}
    assert kept == set(range(20))


def test_op5_numbers(spark):
    """Numbers count for the length and have a limit; a few in short, clean texts do no harm."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abdeinorst") for _ in range(rng.randrange(4, 9)))
    say = lambda n: [rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.15 else word() for _ in range(n)]
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    good = [(i, " ".join(say(200)) + ".", "en") for i in range(20)] + [(20, " ".join(say(55) + ["1984", "31.12.2024", "17"]) + ".", "en")]
    numbers = [" ".join(number(20) for _ in range(60)), " ".join(number(10_000) for _ in range(99)), " ".join(number(7) for _ in range(180))]
    dumps = [(100 + i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in numbers for lang in ("en", None))]
    dumps.append((110, " ".join(say(150) + [number(20_000)] + say(50)) + ".", "en"))
    docs = spark.createDataFrame(good + dumps, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in op05_quality.filter_quality(docs).collect()} == set(range(21))


def test_op6(docs, texts, spark, through_queries):
    want = brute.kept_lines(texts)
    got = by_id(op06_line_dedup.op6_line_dedup(spark, ""))
    assert {i: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for i, r in got.items()} == {i: (a, b, hashlib.sha256(t.encode()).hexdigest()) for i, (a, b, t) in want.items()}
    out = op06_line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {i: r["text"] or "" for i, r in by_id(out).items()} == {i: t for i, (_, _, t) in want.items()}
    assert by_id(out)[0]["text"] is None


def test_op6_key_over_partitions():
    """A key that several ranges hold keeps only its first document."""
    import pyarrow as pa

    part = lambda rows: pa.RecordBatch.from_pydict({c: [r[k] for r in rows] for k, c in enumerate(("h1", "h2", "doc_id", "slot"))})
    out = [b for rows in ([(1, 1, 1, 0), (2, 2, 1, 1)], [(2, 2, 3, 0), (2, 2, 3, 5)], [(2, 2, 4, 0), (3, 3, 9, 0)]) for b in op06_line_dedup.first_occurrences(iter([part(rows)]))]
    seen = [r for b in out for r in b.to_pylist()]
    tails = {(r["h1"], r["h2"]): min(x["doc_id"] for x in seen if x["kind"] == 2 and x["h1"] == r["h1"]) for r in seen if r["kind"] == 2}
    late = [r for r in seen if r["kind"] == 1 and tails.get((r["h1"], r["h2"]), r["doc_id"]) < r["doc_id"]]
    dropped = {(r["doc_id"], r["slot"]) for r in seen if r["kind"] == 0} | {(r["doc_id"], r["slot"]) for r in late}
    assert dropped == {(3, 0), (3, 5), (4, 0)}


@pytest.mark.parametrize("most", [4096, 2])
def test_op7(docs, texts, spark, through_queries, monkeypatch, most):
    monkeypatch.setattr(op07_repeats.repeats, "__defaults__", (100, 24, most))
    got = by_id(op07_repeats.op7_suffix_repeats(spark, ""))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == brute.without_repeats(texts)


def grouped(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["group_id"], []).append((r["doc_id"], r["start"], r["end"], r["first"]))
    return groups


def test_op7_groups_are_the_maximal_repeats(spark):
    """Exact copies, long and nested passages, edges of a passage in many texts; against every repeat of every length."""
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abdeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    long_, short = say(120), say(25)
    texts = {i: f"{say(12)} {short} {say(15)}" for i in range(12)}
    texts |= {20: f"{say(9)} {long_} {say(9)}", 21: f"{say(3)} {long_} {say(30)}", 22: say(5) + " " + long_[200:500] + " " + say(4), 23: None, 24: say(60), 26: short}
    texts |= {25: texts[24], 27: texts[24], 28: "é" + short}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.maximal_repeats(texts)
    for most in (4096, 2):
        got = grouped(op07_repeats.repeat_groups(docs, most=most))
        mine = {frozenset((d, a, b) for d, a, b, _ in g) for g in got.values()}
        assert mine <= want and all([d[:2] for d in sorted(g) if d[3]] == [min(g)[:2]] for g in got.values())
        if most == 4096:
            # What is left out are repeats all of whose windows stand at more places than they do.
            of = {}
            for i, t in texts.items():
                t = (t or "").encode()
                for k in range(len(t) - 99):
                    of[t[k : k + 100]] = of.get(t[k : k + 100], 0) + 1
            for g in want - mine:
                i, a, b = min(g)
                assert all(of[texts[i].encode()[k : k + 100]] > len(g) for k in range(a, b - 99))
            assert len(mine) >= 0.8 * len(want) and any(b - a > 600 for g in mine for _, a, b in g)
        else:  # families split to the end: every repeated window is in a group with all its places
            held = {(d, k) for g in mine for d, a, b in g for k in range(a, b - 99)}
            assert held == {(d, k) for g in want for d, a, b in g for k in range(a, b - 99)}


def test_op7_groups_hold_all_occurrences():
    after, before = [b"abcX", b"abcY", b"abcY", b"abdZ"], [b"pq", b"pr", b"zz", b"pq"]
    got = {(left, right, tuple(sorted(n))) for left, right, n in op07_repeats.maximal_repeats(after, before, 3, 2)}
    assert (0, 3, (0, 1, 2)) in got and (1, 3, (0, 1)) in got and (0, 4, (1, 2)) in got and (2, 2, (0, 3)) in got and (1, 2, (0, 1, 3)) in got


def test_op8(docs, texts, spark, through_queries):
    ranks = op08_bpe.load_ranks(TIK)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in by_id(op08_bpe.op8_prefix_bpe(spark, "")).items():
        ids = plain.encode_ordinary(texts[i] or "")
        digest = lambda x: hashlib.sha256(x).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids)).encode()), digest((texts[i] or "").encode()))
    back = by_id(op08_bpe.decoded(op08_bpe.encoded(docs, TIK), TIK))
    assert all(bytes(r["bytes"]) == (texts[i] or "").encode() for i, r in back.items())


def test_op8_append_and_edit():
    core, _ = op08_bpe.encoder(TIK, public_tokenizers.PATTERN)
    rng = np.random.default_rng(2)
    for _ in range(60):
        data = bytes(rng.choice(list(b"aethinr 12"), rng.integers(1, 200)))
        last = core.extend(data, [])
        a = int(rng.integers(0, len(data)))
        b = int(rng.integers(a, len(data) + 1))
        put = bytes(rng.choice(list(b"aethinr"), rng.integers(0, 5)))
        new, table = core.edit(data, last, a, b, put)
        assert new == data[:a] + put + data[b:] and table == core.extend(new, [])
        assert core.append(data[:a], last[:a], data[a:]) == (data, last)


def test_op9_base(docs, texts, spark, through_queries):
    got = by_id(op09_pii.op9_disclosure_pii(spark, ""))
    for i, r in got.items():
        spans = brute.pii(texts[i])
        assert r["base_sha256"] == hashlib.sha256(op09_pii.written(spans).encode()).hexdigest(), i
        assert [r[f"n_{k}"] for k in op09_pii.KINDS] == [sum(s[0] == k for s in spans) for k in op09_pii.KINDS]
        assert r["spans"] == op09_pii.written(spans)


def test_op9_discloses(spark):
    seen = [(i, f"Write to jane.roe@ex.org or ask Zanzibar {x} desk", "en") for i, x in enumerate(["alpha", "betas", "gamma", "delta"])]
    plain = [(100 + i, f"plain text {i} about a desk and nothing else, write soon", "en") for i in range(60)] + [(900, None, "en"), (901, "Zanzibar", "en")]
    docs = spark.createDataFrame(seen + plain, "doc_id long, text string, _text string")
    out = {r["doc_id"]: r["text"] for r in op09_pii.sanitise(docs).collect()}
    assert "Zanzibar" not in out[0] and "desk" in out[0] and "[EMAIL]" in out[0] and "alpha" in out[0]
    assert all(out[i] == t for i, t, _ in plain)


def test_op9_query_gives_keys_and_terms(spark, monkeypatch):
    texts = {i: f"soon write jane.roe@ex.org and ask Zanzibar {x} desk, the Zanzibar" for i, x in enumerate(["alpha", "betas", "gamma", "delta"])}
    texts |= {100 + i: f"plain text {i} about a desk and nothing else, write soon" for i in range(60)}
    texts |= {200: "Key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff, not 12345678901234567890123 nor abcdefghijklmnopqrstuvwxyz", 201: None, 202: "0" * 30 + "a1" * 15}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(op09_pii, "documents", lambda spark, folder: docs)
    got = by_id(op09_pii.op9_disclosure_pii(spark, ""))
    for i, t in texts.items():
        t = t or ""
        spans = brute.pii(t)
        more = brute.keys(t, spans) + [("term", k, k + 8) for k in range(len(t)) if t[k : k + 8] == "Zanzibar"]
        assert got[i]["spans"] == op09_pii.written(spans + more), i
        assert got[i]["base_sha256"] == hashlib.sha256(op09_pii.written(spans).encode()).hexdigest()
    assert got[200]["spans"] == "key:4:44" and got[0]["spans"].count("term") == 2


def test_op9_counts_whole_texts(spark):
    """Terms far from the mention, always or mostly; against a plain version on whole texts."""
    rng = random.Random(5)
    filler = ["".join(rng.choice("abdeinorst") for _ in range(rng.randrange(4, 8))) for _ in range(150)]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [f"{say(8)} mail jane.roe@ex.org {say(30)} {'' if i > 1 else 'x'} Zanzibar {say(5)}" for i in range(8)]
    texts += [f"{say(8)} call +49 170 555 1234 {'Timbuktu' if i < 2 else ''} {say(40)} Timbuktu {say(3)}" for i in range(10)]
    texts += [f"same words here now and then one@ex.org ends with this Samarkand text right here {say(20)} Kathmandu" for _ in range(6)]  # one context
    texts += [f"{say(8)} two@ex.org {say(30)} Ulaanbaatar" for _ in range(2)]
    texts += [f"{say(9)} old.name@rare.example {say(9)} {'rare' if i == 0 else ''}" for i in range(4)]
    texts += [say(40) for _ in range(300)] + [None, "", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = op09_pii.found(docs)
    zipped = [(e, r["text_hash"], c) for r in rows.collect() for e, c in zip(r["entities"], r["contexts"], strict=True)]
    mentions = spark.createDataFrame(zipped, "entity string, text_hash long, context long")
    got = {(r["entity"], r["term"]) for r in op09_pii.disclosing(docs, mentions).collect()}
    assert got == brute.disclosing(tuple(texts), op09_pii.context)
    terms = {t for _, t in got}
    assert {"Zanzibar", "Timbuktu", "rare"} <= terms and not {"Kathmandu", "Ulaanbaatar", "Samarkand"} & terms
    out = {r["doc_id"]: r["text"] for r in op09_pii.sanitise(docs).collect()}
    assert not any("Zanzibar" in out[i] for i in range(8)) and not any("Timbuktu" in out[i] for i in range(8, 18))


def test_op9_counts_words_before_it_picks_terms(spark):
    texts = spark.createDataFrame([("alpha beta alpha", None), ("beta gamma", 2), ("beta gamma", 2), ("delta", None)], "text string, n_copies long")
    got = op09_pii.texts_with(texts, spark.createDataFrame([("beta",), ("gamma",), ("omega",)], "term string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join Inner") < plan.index("Aggregate")
    assert {r["term"]: r["n_term"] for r in got.collect()} == {"beta": 2, "gamma": 1}


def test_op10(docs, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    for room in (1024, 16):
        rows = op10_packing.pack(docs, TIK, JSON, room).collect()
        ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
        seen, filled = {i: 0 for i in texts}, {}
        for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
            x = ids[r["doc_id"]]
            assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(x)
            assert r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
            seen[r["doc_id"]] += r["length"]
            filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert seen == {i: len(x) for i, x in ids.items()}
        assert sorted(filled) == list(range(len(filled)))
        for some in filled.values():
            at = 0
            for offset, n in sorted(some):
                assert offset == at
                at += n
            assert at <= room


def test_op10_patterns_are_those_of_placing_one_by_one():
    rng = np.random.default_rng(1)
    for turn in range(60):
        few = rng.integers(1, 65, 1 + turn % 25)
        histogram = {int(n): int(c) for n, c in zip(few, rng.integers(1, 60, len(few)), strict=True)}
        made = op10_packing.patterns(histogram, 64)
        assert {n: sum(x.count(n) * c for x, c in made) for n in histogram} == histogram
        assert sorted(sum(x) for x, c in made for _ in range(c)) == sorted(brute.shortest_pack_first(histogram, 64))


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_texts_that_collide_in_rolling_hashes_stay_apart(spark, monkeypatch):
    from tokenizers import Tokenizer

    x, y = thue_morse(2048)
    texts = {1: x, 2: y, 3: x, 4: f"{x} {y}", 5: y + x}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(op01_jaccard.similar_components(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute.similar(texts, 4, 85)
    plain = Tokenizer.from_file(JSON)
    for i, ids in zip(texts, op10_packing.Ids(TIK, JSON).of_texts(list(texts.values())), strict=True):
        assert ids.tolist() == plain.encode(texts[i], add_special_tokens=False).ids
    monkeypatch.setattr(op07_repeats, "documents", lambda spark, folder: docs)
    got = by_id(op07_repeats.op7_suffix_repeats(spark, ""))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == brute.without_repeats(texts)


def test_pieces_that_share_a_hash_are_told_apart():
    from tracklark.llm import pieces

    data = b"abcdefghijk abcdefghijK" + b"x" * 99 + b"y" + b"x" * 100
    offsets = np.array([0, 11, 12, 23, 123, 223])
    assert pieces.differ(data, offsets, np.array([0, 1, 0, 3, 3])).tolist() == [2, 4]
    assert pieces.differ(data, offsets, np.arange(5)).tolist() == []


def test_character_classes_are_the_tokenizers():
    from tracklark.llm import pieces

    table = pieces.classes()
    for kind, pattern in ((pieces.LETTER, r"\p{L}"), (pieces.NUMBER, r"\p{N}"), (pieces.WHITE, r"\s")):
        mine = set(np.flatnonzero((table == kind) | (kind == pieces.WHITE) & (table == pieces.SPACE)).tolist())
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        assert mine == set(pieces.matching(pattern, points))


RUNS = {
    "op1": lambda d: op01_jaccard.similar_components(d),
    "op1_drop": lambda d: op01_jaccard.drop_near_copies(d),
    "op3": lambda d: op03_license.license_scan(d),
    "op4": lambda d: op04_token_counts.token_counts(d, WORD),
    "op5": lambda d: op05_quality.filter_quality(d),
    "op6": lambda d: op06_line_dedup.dedup_lines(d),
    "op7": lambda d: op07_repeats.without_repeats(d),
    "op7_groups": lambda d: op07_repeats.repeat_groups(op07_repeats.told_apart(d)),
    "op8": lambda d: op08_bpe.digests(d, TIK),
    "op9": lambda d: op09_pii.sanitise(d),
    "op10": lambda d: op10_packing.pack(d, TIK, JSON),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_tables_give_empty_tables(no_docs, name):
    assert RUNS[name](no_docs).count() == 0


@pytest.mark.parametrize("name", sorted(set(RUNS) - {"op5", "op7_groups"}))
def test_repeated_rows_and_missing_ids(odd_docs, name):
    got = RUNS[name](odd_docs).collect()
    assert len(got) == (4 if name in ("op1",) else 5), got


def test_op7_texts_that_share_an_id(spark, texts):
    """Two texts of one id, of unlike lengths, with passages that repeat in both and in others; equal rows; rows without an id."""
    a, b = texts[10], texts[41]
    rows = [(5, a), (5, b + " " + a), (5, a), (3, b[40:]), (9, a[200:] + b), (None, a), (4, None), (4, "short"), (1 << 60, a + a), (-7, b)]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in op07_repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    # The order of two texts of one id is that of their hashes; either way the rest follows.
    ways = []
    for first, second in ((a, b + " " + a), (b + " " + a, a)):
        number = [(-7, b), (3, b[40:]), (5, first), (5, second), (9, a[200:] + b), (1 << 60, a + a)]
        plain = brute.without_repeats({i: t for i, (_, t) in enumerate(number)})
        own = {(i, t): plain[k] for k, (i, t) in enumerate(number)}
        want = []
        for i, t in rows:
            n_bytes, removed, *_, sha = own.get((i, t)) or (len((t or "").encode()), 0, 0, hashlib.sha256((t or "").encode()).hexdigest())
            want.append((i, n_bytes, removed, sha))
        ways.append(sorted(want, key=repr))
    assert got in ways
    groups = op07_repeats.repeat_groups(op07_repeats.told_apart(spark.createDataFrame(rows, "doc_id long, text string")))
    assert groups.groupBy("group_id").count().filter("count < 2").count() == 0


def test_op5_equals_its_sql_on_odd_texts(spark, tmp_path):
    """Number dumps, short texts, mixed case, symbols, other languages, nulls."""
    for t in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    rng = random.Random(4)
    odd = [" ".join(str(rng.randrange(10**19, 10**20)) for _ in range(60)), "The AND in Of " * 40, "THE OF AND " * 30, "a b", None, "", "#%$ " * 90, " ".join(f"word{i}" for i in range(120)), " ".join(f"{i} und der die" for i in range(90)), "1 " * 99, "ab1 " * 60]
    more = spark.createDataFrame([(10_000 + 10 * i + j, t, lang) for i, t in enumerate(odd) for j, lang in enumerate(("en", "de", None, "xx"))], "doc_id long, text string, lang string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").union(more)
    docs.coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("part-*")).rename(tmp_path / "documents.parquet")
    check(spark, op05_quality.op5_quality_divergence, op05_quality.SQL["op5_quality_divergence"], str(tmp_path))
    kept = {r["doc_id"] for r in op05_quality.op5_quality_divergence(spark, str(tmp_path)).filter("kept").collect()}
    assert not kept & {10_000, 10_001, 10_002, 10_003}


def test_schema_of_fixture_has_clashes():
    assert "_id" in SCHEMA
