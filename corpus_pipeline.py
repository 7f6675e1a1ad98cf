"""A corpus pipeline of five stages over `documents`. Each stage works on all that the one
before it kept; its result is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalforge.llm import decontamination, exact_dedup, mixing, ngram_join, toxicity
from evalforge.llm.common import Scratch, table, temporary_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional Kneser-Ney models predict toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of word 5-grams the one with the
    smallest doc_id stays."""
    return ngram_join.one_per_group(docs, n=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's word 5-grams go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered by `copy`."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source_mix", mix_sources),
]

#: The scores of the first stage come from a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, all stages applied in turn. What a stage writes for itself is
    removed once its result is written, and so is the result of the stage before."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary_tables():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
