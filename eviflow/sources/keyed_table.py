"""A keyed table on files: merges rewrite the hash buckets that they touch, and nothing else.

Layout under the table's folder::

    table/                    one row: keys, number of buckets, schema
    data/v=<n>/bucket=<b>/    rows of bucket b as merge n left them
    commits/                  one file per merge: (version, batch, bucket) of every bucket it rewrote

A bucket's live rows are those of the last commit that names it. The commit file appears by one rename after all data is
written, so readers see a merge whole or not at all, and a merge that died leaves only files that no commit names; the next
one takes its place. A batch that was committed before is left alone, so a stream may hand over a batch twice. One writer
at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "version bigint, batch string, bucket int"
TABLE = "keys array<string>, buckets int, schema string"
#: The live bucket list is read by the driver, so it is bounded.
MAX_BUCKETS = 65_536
Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class KeyedTable:
    """A table of one row per key; see the module's text."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int
    schema: T.StructType

    @staticmethod
    def create(spark: SparkSession, path: str, keys: list[str], schema: T.StructType, buckets: int = 256) -> KeyedTable:
        """A new, empty table; a folder that holds one is refused. Buckets should hold some 100 MB each in the end."""
        if not 0 < buckets <= MAX_BUCKETS:
            raise ValueError(f"a table has 1 to {MAX_BUCKETS} buckets")
        if missing := [k for k in keys if k not in schema.names]:
            raise ValueError(f"no such columns: {missing}")
        spark.createDataFrame([(list(keys), buckets, schema.json())], TABLE).coalesce(1).write.json(f"{path}/table")
        return KeyedTable(spark, path, tuple(keys), buckets, schema)

    @staticmethod
    def open(spark: SparkSession, path: str) -> KeyedTable:
        row = spark.read.schema(TABLE).json(f"{path}/table").first()
        return KeyedTable(spark, path, tuple(row["keys"]), row["buckets"], T.StructType.fromJson(json.loads(row["schema"])))

    # --- commits -----------------------------------------------------------------------------------
    def commits(self) -> DataFrame:
        """(version, batch, bucket) of every merge."""
        try:
            return self.spark.read.schema(COMMIT).json(f"{self.path}/commits")
        except AnalysisException:  # nothing was merged yet
            return self.spark.createDataFrame([], COMMIT)

    def _live(self) -> dict[int, int]:
        """bucket -> version of its live rows; one entry per bucket at most."""
        rows = self.commits().filter("bucket >= 0").groupBy("bucket").agg(F.max("version").alias("version")).collect()
        return {r["bucket"]: r["version"] for r in rows}

    # --- reading -----------------------------------------------------------------------------------
    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The live rows, or those of some buckets; other buckets' files are not listed."""
        live = self._live()
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(live.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def bucket_of(self):
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows whose keys are in ``wanted``, read from their buckets only."""
        keys = wanted.select(*self.keys).distinct()
        touched = {r[0] for r in keys.select(self.bucket_of()).distinct().collect()}  # ``buckets`` values at most
        return self.read(touched).join(keys, list(self.keys), "left_semi")

    # --- writing -----------------------------------------------------------------------------------
    def merge(self, changes: DataFrame, batch: str, how: Merge) -> set[int]:
        """Apply ``how(current, changes)`` to the buckets that ``changes`` touch; returns them.

        ``how`` sees the live rows of those buckets and gives their new rows. ``changes`` must not change between runs of
        one batch. A batch that is committed already touches nothing.
        """
        history = self.commits()
        if not history.filter(F.col("batch") == batch).isEmpty():
            return set()
        version = (history.agg(F.max("version")).first()[0] or 0) + 1
        touched = {r[0] for r in changes.select(self.bucket_of()).distinct().collect()}  # ``buckets`` values at most
        if touched:
            rows = how(self.read(touched), changes).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema])
            placed = rows.withColumn("bucket", self.bucket_of())
            # Rebalanced by bucket: a bucket is one file unless it is large, and then it is split over tasks.
            placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        self._commit(version, batch, touched)
        return touched

    def _commit(self, version: int, batch: str, touched: set[int]) -> None:
        """Name the buckets that a merge wrote; one that was emptied has no folder, and reads as no rows."""
        written = touched
        if touched:
            found = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/data/v={version}")
            written = {r[0] for r in found.select("bucket").distinct().collect()}
        for bucket in touched - written:
            self.spark.createDataFrame([], self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/data/v={version}/bucket={bucket}")
        rows = [(version, batch, b) for b in sorted(touched)] or [(version, batch, -1)]
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("append").json(f"{self.path}/commits")


def replace_rows(table: KeyedTable, order: list[str]) -> Merge:
    """Keep the last change of each key, in ``order``, over the row that is there."""
    from eviflow.operators.common import latest_by_key

    def how(current: DataFrame, changes: DataFrame) -> DataFrame:
        last = latest_by_key(changes, table.keys, order).select(*current.columns)
        return current.join(last.select(*table.keys), list(table.keys), "left_anti").unionByName(last)

    return how
