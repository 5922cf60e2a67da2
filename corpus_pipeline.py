"""Preparation of a training corpus in stages, each on all that the one before kept.

Every stage works on whole texts and goes by rows: null and repeated ids, equal rows, and columns of any
name are allowed.  Empty tables stay empty.  Null and empty texts fail the first stage; later stages,
given such rows, keep them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, jaccard, pieces, quality, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; references come from rows that ``labels`` calls good."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality.keep_good(docs, references=quality.fit(docs, good))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the smallest id stays (null ids come last; of
    rows with the same id the one with the smallest hash)."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single benchmark passages are cut out of the others."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; overlapping ones by one mask."""
    return secrets.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, best): the texts as the library's token ids, and as those of the segmentation with the
    largest sum of scores; no ids for a null or empty text."""
    return pieces.encode_both(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

#: The stages use trained references and a tokenizer, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of a directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
