"""The corpus pipeline: documents through quality rules, near-dedup, decontamination, secret scans and mixing.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import decontaminate, mixing, near_dedup, quality_rules, secrets
from framewright.llm.store import drop, stored, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy v2 go: null, empty and blank texts among them; repeated rows stay or go alike, an empty table stays empty."""
    return quality_rules.passing(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id: five-word shingles, similarity 0.8 or more.

    Texts without words are groups of their own, rows without a doc_id all stay,
    of rows that share one a single row does.
    """
    return near_dedup.deduplicated(docs, n=5, percent=80)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark passages are cut out; documents of which over 80% would go, go whole.  Null and empty texts, and all others without a passage, stay as they are."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, coverage=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays, null and empty texts as they are."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it (0: none, as of null and empty texts); no text."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", clean_of_benchmark),
    ("secret scans", without_secrets),
    ("mixing", mixed),
]

#: Hashes, a trained forest and a seeded selection have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on all documents; a stage's own tables go when its result is written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
            drop(spark, since, keep=1)
    return docs
