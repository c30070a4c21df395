"""Registry of runnable queries with their SQL twins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eviflow.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PARTITIONS = "spark.eviflow.partitions"
TASKS_PER_CORE = 4
#: Adaptive execution joins small shuffle partitions up to this size; at Spark's 64 MB (packed) a task that sorts narrow rows
#: holds over 1 GB of them.
TASK_BYTES = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` under ``name``; ``t`` opens the tables of one folder."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(bounded(prepare(spark)), sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def bounded(spark: SparkSession) -> SparkSession:
    """Bound what a task of a shuffle takes, unless the session says how much."""
    key, most = TASK_BYTES
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)
    return spark


def work_folder(t: Tables) -> str:
    """A fresh folder under the cluster's checkpoint folder; a temporary one on a local master that names none."""
    root = t.spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="eviflow-")
        t.spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


class Tables:
    """Parquet tables of one folder, opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for costly per-row work, dealt over the cores whatever its files are like: a file of one row group would be
        one task. ``spark.eviflow.partitions`` gives another number than a few for each core. The splits of a stream are known
        batch by batch only, so it gets a few tasks for each core."""
        table = getattr(self, name)
        wanted = self.spark.conf.get(PARTITIONS, None)
        if wanted:
            return table.repartition(int(wanted))
        least = TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism
        return table.repartition(least if table.isStreaming else max(least, table.rdd.getNumPartitions()))
