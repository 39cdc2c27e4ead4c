"""A corpus pipeline: stages that each apply one operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import decontaminate, language, neardup, packing, pii
from tidegate.llm.base import materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null text or no letter); lang becomes the predicted language.

    The classifiers learn from the documents that have a lang.
    """
    seen = language.predict(docs, language.fit(docs), keep=("doc_id", "text", "lang", "source", "n_chars"))
    kept = seen.where(F.col("lang_pred") != language.UNDETERMINED)
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates, that of least doc_id; rows are told apart by doc_id and text, and a missing doc_id is no exception. A document without words is in no class."""
    return neardup.without_duplicates(docs).select(*COLUMNS)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that leak an item of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences; a row for each piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_leaks),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over ``documents``, each stage's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
