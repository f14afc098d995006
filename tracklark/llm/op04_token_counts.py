"""Token counts: Arrow batches balanced by bytes are encoded in batch calls that return lengths only; texts are split at safe
boundaries first, so no call sees a long text and each distinct part of a batch is encoded once.

A safe boundary is a plain space or a line end: the vocabulary's normaliser turns white space into one space, its splitter drops
it, no special token holds any, and neither composition nor lower-casing reaches across it.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings count as the library's default has it; ties and
repeated rows count alike; an empty table gives an empty table; columns beside doc_id and text do not matter.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklark.llm.common import Cache, documents, id_and_text, per_batch

_counters: dict[str, Counter] = {}


class Counter:
    """Token counts of texts by one vocabulary file, one for each worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Cache()

    def lengths(self, texts: list[str]) -> list[int]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        new = list({x for p in parts for x in p if x not in known})
        known.room(len(new))
        missing = new if len(known) else list({x for p in parts for x in p})
        for i in range(0, len(missing), 4096):
            some = missing[i : i + 4096]
            known.update(zip(some, (len(e) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        return [sum(map(known.__getitem__, p)) for p in parts]


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, most: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than most tokens)."""
    run = lambda ids, texts: {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counter(path).lengths(texts)}
    return per_batch(id_and_text(docs), "doc_id long, n_bytes long, n_tokens long", run).withColumn("over_limit", F.col("n_tokens") > most)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
