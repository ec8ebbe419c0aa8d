"""The corpus pipeline: documents in, a cleaned and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``; the last adds ``copies`` (how often the mix
takes a document) and ``taken`` (its words in the mix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rawi.llm.common import table, written
from rawi.llm.decontaminate import without_benchmark
from rawi.llm.language_id import in_known_language, learn
from rawi.llm.near_dedup import one_of_each
from rawi.llm.secrets_scan import mask_secrets
from rawi.llm.source_mix import label_weights, mixed

#: No SQL can express the learned stages; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a clear language."""
    return in_known_language(docs, learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of near duplicates."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets inside the texts."""
    return mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents up to the word targets of their sources."""
    return mixed(docs, label_weights(table(spark, sf_dir, "labels")))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
