"""Byte-level BPE encoding and decoding of whole texts by prefix dynamic programming (see bpe.py), in Arrow batches.

Defined results: a null or empty text has no tokens (the hash of nothing); special strings in a text are ordinary text; ties and
repeated rows are encoded alike; an empty table gives an empty table; columns beside doc_id and text do not matter.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracklark.llm.bpe import PrefixEncoder, PieceEncoder, load_ranks
from tracklark.llm.common import documents, id_and_text, per_batch

_encoders: dict[tuple, tuple] = {}


def encoder(path: str, pattern: str) -> tuple[PrefixEncoder, PieceEncoder]:
    """One for each worker; a piece's value is its number of ids, the ids as text with a space before each, and their bytes."""
    if (path, pattern) not in _encoders:
        core = PrefixEncoder(load_ranks(path))

        def value(piece: str) -> tuple[int, str, bytes]:
            ids = core.encode(piece.encode())
            return len(ids), "".join(f" {i}" for i in ids), core.decode(ids)

        _encoders[path, pattern] = core, PieceEncoder(pattern, value)
    return _encoders[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids: the token ids of every text."""

    def run(doc_ids: list, texts: list) -> dict:
        _, pieces = encoder(path, pattern)
        return {"doc_id": doc_ids, "ids": [[int(i) for part in pieces.of_text(t) for i in part[1].split()] for t in texts]}

    return per_batch(id_and_text(docs), "doc_id long, ids array<int>", run)


def decoded(rows: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, bytes of rows (doc_id, ids)."""
    import pyarrow as pa

    def run(batches):
        core, _ = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([core.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of what they decode to; ids do not leave the batch."""

    def run(doc_ids: list, texts: list) -> dict:
        _, pieces = encoder(path, pattern)
        out = {"doc_id": doc_ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts:
            parts = pieces.of_text(t)
            out["n_tokens"].append(sum(p[0] for p in parts))
            out["ids_sha256"].append(hashlib.sha256("".join([p[1] for p in parts])[1:].encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
        return out

    return per_batch(id_and_text(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op8_prefix_bpe": op8_prefix_bpe}
SQL: dict[str, str] = {}
