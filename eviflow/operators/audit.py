"""Hash-chained audit log.

A row's hash covers the previous row's hash, so building a chain is serial by definition; chains are built in
parallel, each streamed through one task with constant memory. Verifying needs only the neighbour and is parallel
within a chain as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.operators.common import with_position, with_previous

HASHED = ["ts", "case_id", "actor", "role", "action", "detail"]


def row_hash(previous: Column) -> Column:
    """SHA-256 over the previous hash and the row's fields, nulls read as empty."""
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), hashed_fields()), 256)


def hashed_fields() -> Column:
    """The row's hashed fields in one string, nulls read as empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in HASHED])


def build_chain(df: DataFrame, chain: str | None = None, seq: str = "seq", heads: DataFrame | None = None) -> DataFrame:
    """Add prev_hash and hash in ``seq`` order, one chain per value of ``chain`` (one chain overall when None).

    Rows are hashed while streaming through sorted partitions: the task holds one hash per chain at a time, never a
    group. ``heads`` (chain, hash) continues existing chains, so a long log is appended to in batches and an
    interrupted build resumes from the last written batch.
    """
    if chain is None:
        work = df.withColumn("_chain", F.lit(0))
    else:
        work = df.withColumn("_chain", F.col(chain))
    if heads is not None:
        start = heads.select((F.lit(0) if chain is None else F.col(chain)).alias("_head_of"), F.col("hash").alias("_head"))
        work = work.join(start, F.col("_chain").eqNullSafe(F.col("_head_of")), "left").drop("_head_of")
    else:
        work = work.withColumn("_head", F.lit(None).cast("string"))
    work = work.withColumn("_fields", hashed_fields())
    ordered = work.repartition("_chain").sortWithinPartitions("_chain", seq)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, previous = object(), ""
        for batch in batches:
            before, after = [], []
            for key, head, fields in zip(batch["_chain"], batch["_head"], batch["_fields"]):
                key = None if pd.isna(key) else key
                if key != current:
                    current, previous = key, head if isinstance(head, str) else fv.CHAIN_GENESIS
                before.append(previous)
                previous = hashlib.sha256(f"{previous}|{fields}".encode()).hexdigest()
                after.append(previous)
            yield batch.drop(columns=["_chain", "_head", "_fields"]).assign(prev_hash=before, hash=after)

    return ordered.mapInPandas(link, f"{schema}, prev_hash string, hash string")


def build_chain_in_batches(
    df: DataFrame, folder: str, chain: str | None = "case_id", seq: str = "seq", batch_rows: int = 5_000_000, resume: bool = False
) -> DataFrame:
    """Build chains of any length without handing one task more than ``batch_rows`` rows of a chain.

    Batch ``n`` holds rows ``n * batch_rows`` onward of every chain; it is written under ``folder`` before the next one
    starts from its heads, so a lost executor repeats one batch only. A run takes a folder of its own: one that holds
    batches already is refused, unless ``resume`` is set and goes on after the last finished batch of the same log. One
    chain over the whole log (``chain=None``) is serial however it is cut, and is refused beyond one batch.
    """
    spark = df.sparkSession
    keys = [chain] if chain else []
    longest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if chain is None and longest > batch_rows:
        raise ValueError("one chain over the whole log is built by one task; name a chain column")
    finished = [b["batch"] for b in spark.read.parquet(folder).select("batch").distinct().collect()] if _exists(spark, folder) else []
    if finished and not resume:
        raise ValueError(f"{folder} holds batches of an earlier run")
    placed = with_position(df, keys, seq, "_at").withColumn("_batch", F.floor((F.col("_at") - 1) / batch_rows))
    for n in range(max(finished, default=-1) + 1, max(1, -(-longest // batch_rows))):
        heads = None
        if n:  # a chain that ended in an earlier batch has no head in the last one, and needs none
            heads = chain_heads(spark.read.parquet(f"{folder}/batch={n - 1}"), chain, seq)
        part = placed.filter(F.col("_batch") == n).drop("_at", "_batch")
        build_chain(part, chain, seq, heads).write.mode("overwrite").parquet(f"{folder}/batch={n}")
    return spark.read.parquet(folder).drop("batch")


def _exists(spark, folder: str) -> bool:
    """Has a finished batch been written under ``folder``?"""
    try:
        return bool(spark.read.parquet(folder).columns)
    except AnalysisException:
        return False


def chain_heads(df: DataFrame, chain: str | None = None, seq: str = "seq") -> DataFrame:
    """Last hash per chain."""
    keys = [chain] if chain else []
    return df.groupBy(*keys).agg(F.max_by("hash", F.col(seq)).alias("hash"))


def broken_links(df: DataFrame, chain: str | None = None, seq: str = "seq", width: int = 1_000_000) -> DataFrame:
    """Rows whose stored previous hash or own hash does not agree with the log."""
    keys = [chain] if chain else []
    linked = with_previous(df, keys, seq, {"hash": "_expected"}, width)
    expected = F.coalesce("_expected", F.lit(fv.CHAIN_GENESIS))
    bad = (~F.col("prev_hash").eqNullSafe(expected)) | (~F.col("hash").eqNullSafe(row_hash(expected)))
    return linked.withColumn("bad", bad).drop("_expected")


def verify_chain(df: DataFrame, chain: str | None = None, seq: str = "seq", width: int = 1_000_000) -> DataFrame:
    """Per chain: ok, first broken position, number of rows and the head hash when intact."""
    keys = [chain] if chain else []
    checked = broken_links(df, chain, seq, width)
    return (
        checked.groupBy(*keys)
        .agg(
            F.min(F.when(F.col("bad"), F.col(seq))).alias("broken_at_seq"),
            F.count("*").alias("total"),
            F.max_by("hash", F.col(seq)).alias("_head"),
        )
        .select(
            *keys,
            F.col("broken_at_seq").isNull().alias("ok"),
            "broken_at_seq",
            "total",
            F.when(F.col("broken_at_seq").isNull(), F.col("_head")).alias("head"),
        )
    )
