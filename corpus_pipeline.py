"""Corpus preparation in five stages: quality, near duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm.common import discard, stage, staged
from panelweave.llm.decontaminate import without_leaks
from panelweave.llm.neardup import keep_one_of_each
from panelweave.llm.packing import pack_documents
from panelweave.llm.queries import good_documents, table, tokenizer_path
from panelweave.llm.secrets import redact_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the bar go; each row is judged by its own text, those without an id too."""
    return good_documents(spark, docs, sf_dir)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays; rows without an id stay."""
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows without an id stay."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as places in token sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicate_join", near_duplicate_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Trained scores, hashed signatures and token ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written to the shared folder and read again, and what it needed there is removed.

    Null and empty texts pass every stage that doesn't score them low, columns beside those of documents are kept as they are,
    repeated rows are judged alike, and an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        mark = staged()
        docs = stage(apply(spark, docs, sf_dir), name)
        discard(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
