"""Sinks: keyed upserts, feedback, tuning rows, reports and the registry index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.functions import text as tx
from eviflow.operators.common import latest_by_key
from eviflow.operators.feedback import sft_json, sft_rows
from eviflow.operators.names import registry_tokens

METADATA = ["applicant", "org", "directorate", "scenario", "tags", "pair"]
HUMAN = ["final_verdict", "officer_reason", "confirmed_by", "confirmed_at"]


def upsert_cases(current: DataFrame, changes: DataFrame) -> DataFrame:
    """New cases come in as they are; known ones take over only the metadata of the last change (``seq``)."""
    meta = [c for c in METADATA if c in changes.columns]
    last = changes.groupBy("case_id").agg(
        F.max_by(F.struct(*meta), "seq").alias("_meta"),
        F.min_by(F.struct(*[c for c in changes.columns if c not in ("case_id", "seq", *meta)]), "seq").alias("_first"),
    )
    joined = current.withColumn("_known", F.lit(True)).join(last, "case_id", "full")
    fresh = F.col("_known").isNull()
    touched = F.col("_meta").isNotNull()
    first = {c for c in changes.columns if c not in ("case_id", "seq", *meta)}

    def pick(c):
        if c == "case_id":
            return F.col(c)
        if c in meta:
            return F.when(touched, F.col(f"_meta.{c}")).otherwise(F.col(c)).alias(c)
        new = F.col(f"_first.{c}") if c in first else F.lit("new") if c == "status" else F.lit(None)
        return F.when(fresh, new).otherwise(F.col(c)).alias(c)

    return joined.select(*[pick(c) for c in current.columns])


def upsert_verdicts(current: DataFrame, changes: DataFrame) -> DataFrame:
    """A new AI verdict replaces the row and clears the human part."""
    keys = ["case_id", "rule_id"]
    last = latest_by_key(changes, keys, ["seq"]).drop("seq")
    fresh = last.select(
        *[F.col(c) if c in last.columns and c not in HUMAN else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns]
    )
    return current.join(last.select(*keys), keys, "left_anti").unionByName(fresh)


def write_feedback(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_sft(feedback: DataFrame, path: str, system: str) -> None:
    sft_json(sft_rows(feedback, system)).write.mode("overwrite").text(path)


def write_eval(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def build_registry_index(registry: DataFrame, path: str) -> None:
    """Full rebuild of the registry and its token index under ``path``.

    Tokens are range-partitioned by (token, ord): a frequent token spans several files instead of one, and file
    statistics still let a lookup skip the others.
    """
    rows = registry.withColumn("norm", tx.name_norm("name"))
    rows.write.mode("overwrite").parquet(f"{path}/registry")
    stored = registry.sparkSession.read.parquet(f"{path}/registry")
    tokens = registry_tokens(stored.select("ord", "norm")).repartitionByRange("token", "ord")
    tokens.sortWithinPartitions("token", "ord").write.mode("overwrite").parquet(f"{path}/tokens")


def read_registry_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/registry"), spark.read.parquet(f"{path}/tokens")
