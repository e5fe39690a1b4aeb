"""Corpus cleaning in five stages, each written as Parquet and read again by the next.

1. quality: documents that the fixed rules or the adaptive fences reject go.
2. lines: lines of recurring templates go but for the first document's; a document of
   which nothing is left goes with them.
3. near_dedup: of each group of exact and near copies (five-word shingles, similarity of
   0.8 or more) the document with the smallest id stays.
4. decontaminate: documents that hold a benchmark window go (items of fewer than ten words
   are one window; ``least`` raises the words that a window needs).
5. tokens: byte-level BPE ids of what is left, checked by decoding them.

All stages but the last return the columns of ``documents``. SQL cannot express the
near-duplicate and token stages, so there is no SQL for the whole; tests compare
the stages with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import bpe, decontaminate, linededup, quality, simhash
from frameloom.llm.common import passing_scratch, removed, scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.trimmed(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_deduped(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: int = 1) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=least)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encoded(docs, "text", docs.columns, ranks, public_tokenizers.PATTERN)


#: Name and function of each stage; a function takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("tokens", tokens_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in order.

    A stage's intermediate results go once it is written, and its input, if an earlier stage
    wrote it, with them: the shared folder holds one stage's at a time.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with passing_scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
