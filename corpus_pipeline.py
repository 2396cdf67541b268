"""The training-data pipeline: documents pass through the stages in order.

Each stage takes all that its predecessor kept. Toxic documents go; of each group of near copies one document stays;
documents that overlap with benchmark items go; live secrets are masked in the text; the rest is mixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.functions.durable import release, stored
from skein.llm.decontaminate import decontaminate
from skein.llm.jaccard_join import keep_first
from skein.llm.mixing import curriculum_servings
from skein.llm.secrets import redact
from skein.llm.toxicity import reject_toxic


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, chars_col="n_chars")


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its masked text, once a serving, with the words taken and its training position, in that order."""
    return curriculum_servings(docs, keep=("text", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("secrets", _secrets),
    ("mixing", _mixing),
]

#: The first stages learn a model and compare sets, which SQL doesn't express; tests/llm holds run() against plain Python that is
#: told only which documents are toxic.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if kept is not None:
            release(kept)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
