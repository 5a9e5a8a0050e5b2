"""Registered queries of the text operators: each applies one operator, with production parameters, to its whole
table.  oracle_sql() has DuckDB equivalents where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import contamination, importance, language, licenses, near_dups, oracles, packing, phrases, quality, secrets, tokens
from .common import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), most_targets=20_000, buckets=1 << 20, scale=100.0)


def op2_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeated(table(spark, sf_dir, "documents"), size=20)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), rare=12, slack=8)


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summarize(secrets.find(spread(table(spark, sf_dir, "documents"))), shared_owners=3)


def op5_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~language.held_out(), per_language=3000, words=15_000)
    return language.predict(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.ledger(spread(table(spark, sf_dir, "documents"))), "v1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), capacity=4096, end_id=1)


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), percent=85, k=5)


def op9_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), threshold=0.8, k=5)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), limit=512)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """None for the operators whose results need random numbers, a fitted model, a tokenizer or templates."""
    return {
        "op2_phrase_automata": oracles.OP2,
        "op4_secret_ownership": oracles.OP4,
        "op6_rule_ledger": oracles.OP6,
        "op8_chosen_path": oracles.OP8,
        "op9_containment_search": oracles.OP9,
    }
