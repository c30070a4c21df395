"""Corpus pipeline: from raw documents to token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eviflow.llm import stages
from eviflow.llm.common import session, work_folder, written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules_stage),
    ("simhash_near_dedup", stages.simhash_stage),
    ("suffix_array_dedup", stages.suffix_array_stage),
    ("source_mixture", stages.mixture_stage),
    ("sentencepiece", stages.sentencepiece_stage),
]

#: No SQL can express fingerprints, suffix order or piece encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
