"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, html, jaccard, langid, licenses, lm, oracles, pieces, quality, repeats, secrets
from sparkloom.sources.spread import spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for an operator that doesn't shuffle, over all cores."""
    return spread(_table(spark, sf_dir, name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_spread(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_spread(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_spread(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(spread(docs), langid.fit(docs))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_spread(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(_spread(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_scores(spread(docs), references=quality.fit(docs, _table(spark, sf_dir, "labels").where("quality = 1")))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 4 that the contract fixes, which SQL can express."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of operator 7."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of operator 10."""
    scores = quality.quality_scores(_spread(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both segmentations of operator 9, decoded."""
    return pieces.round_trips(_spread(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_license_scan": op4_license_scan,
    "op5_html_extraction": op5_html_extraction,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality_rules": op10_quality_rules,
    "license_base": license_base,
    "secret_base": secret_base,
    "quality_base": quality_base,
    "piece_round_trip": piece_round_trip,
}

ORACLE: dict[str, str] = {
    "op1_suffix_dedup": oracles.REPEATS,
    "op2_decontamination": oracles.CONTAMINATION,
    "op8_ngram_jaccard_join": oracles.SIMILAR,
    "license_base": oracles.LICENSES,
    "secret_base": oracles.SECRETS,
    "quality_base": oracles.QUALITY,
    "piece_round_trip": "SELECT doc_id, coalesce(text, '') AS text, coalesce(text, '') AS best FROM documents",
}
