"""The pipeline as a whole against plain versions of its stages, one after the other."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tracklark.llm import op05_quality, op09_pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept boolean, _id long"


def made_rows():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abdeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    common = {"en": ["the", "of", "and", "to", "in"], "de": ["der", "die", "und", "in", "den"]}

    def say(n, lang="en"):
        return " ".join(rng.choice(common[lang]) if rng.random() < 0.15 else rng.choice(vocabulary) for _ in range(n)) + "."

    line, rows = "a line that is found in quite a lot of documents", []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        text = "\n".join([say(90, lang), line if i % 2 else say(9, lang), say(90, lang)])
        if i % 7 == 0:
            text += f" Write to jane.roe@ex.org or ask Zanzibar {say(5, lang)}"
        if i % 11 == 0:
            text += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and call +1 (017) 555-7713 now'
        rows.append([i, text, lang])
    for i in range(10):  # near copies; a change in each line, as equal lines go before
        lines = [x.split(" ") for x in rows[5][1].split("\n")]
        for w in lines:
            w[rng.randrange(len(w))] = f"changed{i}"
        rows.append([100 + i, "\n".join(map(" ".join, lines)) + ("\n" + line if i % 2 else ""), "en"])
    rows += [[120 + i, rows[9][1], "en"] for i in range(4)]
    rows += [[130, None, "en"], [131, "", None], [132, "short", "xx"], [133, "### $$$ " * 90, "en"], [134, "1234567 " * 99, "en"]]
    rows += [[135, " ".join(f"{rng.randrange(10**9)}" for _ in range(120)), None], [136, say(3000), "en"], [137, "\n".join([say(20)] * 9), "en"]]
    return [(i, t, lang, "s", len(t or ""), "r", True, 7) for i, t, lang in rows]


def plain(rows):
    """(doc_id, text) of what reaches packing."""
    kept = brute.quality({r[0]: (r[1], r[2]) for r in rows})
    texts = {r[0]: r[1] for r in rows if r[0] in kept}
    texts = {i: t for i, (_, _, t) in brute.kept_lines(texts).items()}
    texts = {i: texts[i] for i, (_, c) in brute.similar(texts, 5, 80).items() if i == c}
    return {i: brute.sanitised(t, texts.values()) for i, t in texts.items()}


def run(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows = made_rows()
    texts = plain(rows)
    assert 40 < len(texts) < 64 and not {101, 109, 133, 134, 135} & set(texts) and 136 in texts
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for a in range(0, len(ids), 1024):
            want[i, a] = (min(1024, len(ids) - a), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids))
    got = run(spark, rows, tmp_path).collect()
    assert {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got} == want and len(got) == len(want)
    assert any("[KEY]" in t for t in texts.values()) and any("[EMAIL]" in t and "Zanzibar" not in t for t in texts.values())
    assert sum(r["length"] for r in got) > 0.8 * 1024 * len({r["sequence_id"] for r in got})


def test_stages_keep_the_columns(spark, tmp_path):
    rows = made_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    assert {r["doc_id"] for r in docs.collect()} == set(plain(rows))


@pytest.mark.parametrize("which", ["empty", "odd"])
def test_odd_tables(spark, tmp_path, which):
    good = made_rows()[1][1]
    odd = [(1, good, "en"), (1, good, "en"), (2, good + " more words", "en"), (None, good, None), (3, None, None)]
    rows = [] if which == "empty" else [(i, t, lang, "s", 1, "r", None, None) for i, t, lang in odd]
    got = run(spark, rows, tmp_path).collect()
    # Both rows of document 1 stay; document 2 loses its lines and keeps the rest; a row without an id links with nothing.
    assert sorted({(r["doc_id"] is None, r["doc_id"] or 0) for r in got}) == ([] if which == "empty" else [(False, 1), (False, 2), (True, 0)])


def test_no_stage_leaves_tables_behind(spark, tmp_path):
    import os

    from tracklark.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = run(spark, made_rows(), tmp_path)
    assert len(set(os.listdir(folder)) - before) == 1 and out.count()


def test_constants_of_the_plain_versions():
    assert brute.COMMON == op05_quality.COMMON_WORDS and brute.KINDS == op09_pii.KINDS
