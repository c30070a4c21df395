"""Shared helpers: work folder, written tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eviflow.session import prepare

#: Spark's setting that frees an action's shuffle files when it ends; otherwise they wait for the driver's garbage collection.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACES = " \t\n\x0b\f\r"


def session(spark: SparkSession) -> SparkSession:
    """The prepared session; Arrow batches hold few rows, as single texts may be long."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def work_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share.

    Where the session names no ``spark.checkpoint.dir``, a local master gets a temporary folder; a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="eviflow-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends here, and lost executors cost no recomputation of it.

    ``codec`` is the files' compression, if not the session's. The shuffles behind it are not read again, so their files go as soon as it is written.
    """
    path, conf = f"{folder}/{name}", df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        conf.unset(FREE_SHUFFLES) if before is None else conf.set(FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession, folder: str, *names: str) -> None:
    """Free tables of :func:`written` that are read no more, by writing an empty one over each."""
    for name in names:
        spark.range(0).write.mode("overwrite").parquet(f"{folder}/{name}")


def binary_text(text: str = "text"):
    """The text's UTF-8 bytes; null stays null."""
    return F.col(text).cast("string").cast("binary")


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch as tuples of Python values."""
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def packed(docs: DataFrame, *computed, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``carry``) as one struct ``doc`` beside computed columns, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc"), *computed)


def word_list(text):
    """Words (runs of characters other than ASCII white space) of a text column; none for null."""
    cut = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, r"[\x20\x09-\x0D]+"))
