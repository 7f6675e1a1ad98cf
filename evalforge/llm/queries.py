"""The thin queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, exact_dedup, html_extract, language_id, lexical_search, mixing, ngram_join, pii, substring_dedup, topk_join, toxicity, warc
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), n=3, similarity=0.9)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.digests(conversation_repair.damage(rows), rows)


def op12_topk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_join.nearest(vectors, F.col("vec_id") % 50 == 0, "vec_id", topk_join.scaled(F.col("embedding")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_warc, op3_pii, op4_language_id, op5_ngram_join, op6_substring_dedup, op7_source_mix, op8_exact_dedup, op9_decontamination, op10_toxicity,
        op11_conversation_repair, op12_topk_join, op13_lexical_search,
    )
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op5_ngram_join": ngram_join.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op7_source_mix": mixing.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op12_topk_join": topk_join.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
