"""The corpus pipeline: five stages, each a (name, function) that takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage reads what its predecessor kept.  All but the last return the columns of documents: rejected documents
are gone and live-looking secrets are masked in the text.  The last packs what is left into training sequences.

A row without id passes every stage that finds documents by their id (near_dedup, decontamination) and is judged like
any other where rows are judged one by one; rows of equal id stay or go together.  A null text has no language and goes
in the first stage.  Columns beyond those of documents pass through, whatever their names.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidespan.llm import contamination, language, near_dups, packing, secrets
from tidespan.llm.common import discard, give_back_heap, kept_alone


def in_small_heaps(stage):
    """The stage, begun once the executors have given back the heap that the stages before it needed."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heap(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_small_heaps
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told."""
    return language.reject_unknown(docs)


@in_small_heaps
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return near_dups.keep_one(docs, percent=80)


@in_small_heaps
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.8)


@in_small_heaps
def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask credentials that look live."""
    return secrets.redact(docs, shared_owners=3)


@in_small_heaps
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 4096 tokens.  Executors have grown by now, so workers take little memory."""
    small = {"cache_words": 150_000, "resident": False, "together": 1 << 19}
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), capacity=4096, end_id=1, **small)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("best_fit_packing", packed),
]

#: Language scores, the tokenizer and best fit can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next one's input.  What a
    stage wrote on its way, and the stage before it, is deleted once the result is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = kept_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline_{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
