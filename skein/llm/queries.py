"""The queries of this subpackage over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import mixing, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.url_filter import filter_urls, page_outcomes

    pages = _table(spark, sf_dir, "pages")
    return filter_urls(pages, page_outcomes(pages, _table(spark, sf_dir, "labels")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.mixing import curriculum_mix

    return curriculum_mix(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.secrets import digest, scan_secrets

    return digest(scan_secrets(_table(spark, sf_dir, "documents")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.jaccard_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.suffix_tree import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.quality import judge_quality

    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {"op2_substring_dedup": substring_dedup.ORACLE, "op5_mixing": mixing.ORACLE}
