"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of documents; columns beside text pass through as they are. A row stays unless a stage
says otherwise: quality drops what it rejects, near_copies all but the smallest doc_id of each component.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracklark.llm.common import discard, written
from tracklark.llm.op01_jaccard import drop_near_copies
from tracklark.llm.op05_quality import filter_quality
from tracklark.llm.op06_line_dedup import dedup_lines
from tracklark.llm.op09_pii import sanitise
from tracklark.llm.op10_packing import pack


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, k=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_copies", near_copies), ("pii", pii), ("packing", packing)]
#: Corpus statistics of terms and token ids are beyond SQL; tests/llm/test_pipeline.py holds run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = written(lambda f=stage, d=docs: f(spark, d, sf_dir))
        discard(before)
        before = docs
    return docs
