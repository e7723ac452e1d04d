"""The corpus pipeline: five stages over ``documents``, each kept before the next.

Every stage is a function (spark, docs, sf_dir) -> DataFrame on all that its
predecessor kept; all but the last return the columns of ``documents``, whatever their names.

Defined results, for every stage: a null text counts as empty; rows are judged by their own text, so repeated
and null ids are told apart; very long texts are read whole; an empty table gives an empty one, and stages without
labels or benchmark items keep every row. The near-duplicate stage keeps, of each group, the row with the
smallest id (ties: the smallest hash of the text; of rows that are the same in both, one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, packing, pii, simhash, toxicity
from sluice.llm.store import keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, trained on the labelled ones, rejects go; empty texts stay."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id. Empty texts are one group."""
    return simhash.first_of_groups(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; texts of fewer than five words hold none."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is masked and n_chars follows; null texts stay null."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their places in packed sequences; a null or empty text is one piece
    that holds just the end id."""
    return packing.best_fit_packing(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]

#: Trained models, SimHash components and BPE merges have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
