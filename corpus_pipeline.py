"""The corpus pipeline: five stages, each one of the training-data operators on what the one
before kept. A stage gets (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.

All stages but the last return the columns of ``documents``, whatever these are called. Null or
empty texts fail the first stage's length rule; rows without a doc_id, and different texts under one,
are judged by their texts; of repeated rows near_dedup keeps one, of equals that of the smallest
doc_id; an empty table passes through every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import common, leaks, mixing, neardup, rules, suffixes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that no rule of the current policy rejects."""
    return rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    return neardup.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage that stands elsewhere too out of the texts; n_chars follows the text."""
    cut = suffixes.without_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.selectExpr(*[f"CAST(length(text) AS {docs.schema[c].dataType.simpleString()}) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])
    return cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a window of a benchmark item occurs."""
    return leaks.without_hits(docs, common.table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates at which to use each document so that the domains' tokens match the targets."""
    return mixing.mix(docs, common.table(spark, sf_dir, "labels"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("mix_to_targets", mix_to_targets),
]

#: Suffix arrays and fitted rates have no SQL form; a test compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. Each but the last is written, and its scratch tables deleted."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = common.mark()
        out = common.cut(stage(spark, docs, sf_dir), name)
        common.release(spark, spare=before | {out._cut})
        common.forget(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
