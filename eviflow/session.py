"""Session settings the transforms rely on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Unions keep plain concatenation of partitions: the partition-aware union zips its inputs and fails when adaptive
    # execution has coalesced them differently.
    "spark.sql.unionOutputPartitioning": "false",
    # Keyed stream state lives on disk and is snapshotted to the checkpoint.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Arrow functions can import it there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="eviflow-ship-")
    copy = shutil.copytree(package, os.path.join(folder, "zip", os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "eviflow"), "zip", os.path.dirname(copy)))
    _shipped.add(context.applicationId)


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Builder with the settings applied; cluster-wide ones (partition counts, memory) stay with the cluster."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that was built elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark
