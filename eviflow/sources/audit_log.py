"""A hash-chained audit log that is appended to, with checkpoints to verify from.

An epoch is one append. Under the log's folder, ``log/epoch=n`` holds its rows with prev_hash and hash, ``heads/epoch=n``
a row for each chain that it touched (last seq, rows so far, last hash), ``nodes/epoch=n`` a hash tree over the heads of
all chains. An epoch counts once its nodes are written; one that was cut short is written again. One writer at a time.

The tree is keyed by the digits of the SHA-256 of the chain's key: leaves are buckets of about ``LEAF_CHAINS`` heads, a
node hashes its 16 children. A head covers all rows of its chain, so the root covers the whole log: kept elsewhere, it
shows later whether the heads are still the same, which buckets differ, and that a chain stood as claimed.

Defined cases: a null key is a chain of its own; rows at or before the end of their chain are refused; an append without
rows to an empty log leaves it empty.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.operators.audit import build_chain, row_hash
from eviflow.operators.common import with_previous

#: Chains in a leaf of the tree, on average at most.
LEAF_CHAINS = 64
HEAD = ["end_seq", "total", "hash"]


def append(rows: DataFrame, folder: str, chain: str = "case_id", seq: str = "seq") -> int:
    """Append ``rows`` to their chains; the number of the new epoch."""
    spark = rows.sparkSession
    last = last_epoch(spark, folder)
    heads = heads_at(spark, folder, last, chain) if last else None
    if heads is not None:
        late = _beside(rows, heads.select(chain, "end_seq"), chain).filter(F.col(seq) <= F.col("_end_seq"))
        if not late.isEmpty():
            raise ValueError("rows at or before the end of their chain can't be appended")
    at = last + 1
    build_chain(rows, chain, seq, heads).write.mode("overwrite").parquet(f"{folder}/log/epoch={at}")
    ended = _ends(spark.read.parquet(f"{folder}/log/epoch={at}"), chain, seq)
    if heads is not None:
        total = F.col("total") + F.coalesce("_total", F.lit(0))
        ended = _beside(ended, heads.select(chain, "total"), chain).select(chain, "end_seq", total.alias("total"), "hash")
    ended.write.mode("overwrite").parquet(f"{folder}/heads/epoch={at}")
    hash_tree(heads_at(spark, folder, at, chain), chain).write.mode("overwrite").parquet(f"{folder}/nodes/epoch={at}")
    return at


def last_epoch(spark: SparkSession, folder: str) -> int:
    """The last finished epoch; 0 for a log that is empty."""
    try:
        return spark.read.parquet(f"{folder}/nodes").agg(F.max("epoch")).first()[0] or 0
    except AnalysisException:
        return 0


def heads_at(spark: SparkSession, folder: str, epoch: int, chain: str = "case_id") -> DataFrame:
    """(chain, end_seq, total, hash) of every chain as it stood after ``epoch``."""
    stored = spark.read.parquet(f"{folder}/heads").filter(F.col("epoch") <= epoch)
    last = stored.groupBy(chain).agg(F.max_by(F.struct(*HEAD), "epoch").alias("_head"))
    return last.select(chain, *[F.col(f"_head.{c}").alias(c) for c in HEAD])


def tail(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    """Rows that came after ``epoch``; folders of earlier epochs are not read."""
    last = last_epoch(spark, folder)
    return spark.read.parquet(f"{folder}/log").filter((F.col("epoch") > epoch) & (F.col("epoch") <= last)).drop("epoch")


def verify_tail(rows: DataFrame, heads: DataFrame, chain: str = "case_id", seq: str = "seq", width: int = 1_000_000) -> DataFrame:
    """Per chain what ``audit.verify_chain`` finds over the whole log, from a checkpoint's heads and the rows after it."""
    linked = _beside(with_previous(rows, [chain], seq, {"hash": "_previous"}, width), heads.select(chain, "hash"), chain)
    expected = F.coalesce("_previous", "_hash", F.lit(fv.CHAIN_GENESIS))
    bad = ~F.col("prev_hash").eqNullSafe(expected) | ~F.col("hash").eqNullSafe(row_hash(expected))
    found = linked.withColumn("_bad", bad).groupBy(chain).agg(
        F.min(F.when(F.col("_bad"), F.col(seq))).alias("broken_at_seq"), F.count("*").alias("n"), F.max_by("hash", F.col(seq)).alias("last")
    )
    both = found.withColumn("_here", F.lit(True)).alias("t").join(heads.alias("h"), F.col(f"t.{chain}").eqNullSafe(F.col(f"h.{chain}")), "full")
    intact = F.col("broken_at_seq").isNull()
    return both.select(
        F.when(F.col("_here"), F.col(f"t.{chain}")).otherwise(F.col(f"h.{chain}")).alias(chain),
        intact.alias("ok"),
        "broken_at_seq",
        (F.coalesce("total", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("total"),
        F.when(intact, F.when(F.col("_here"), F.col("last")).otherwise(F.col("h.hash"))).alias("head"),
    )


def hash_tree(heads: DataFrame, chain: str = "case_id", depth: int | None = None) -> DataFrame:
    """(level, prefix, hash): level 0 is the root, the deepest level holds the buckets of heads."""
    if depth is None:
        n, depth = heads.count(), 0
        while 16**depth * LEAF_CHAINS < n:
            depth += 1
    level = heads.groupBy(F.substring(_digits(F.col(chain)), 1, depth).alias("prefix")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(_leaf(chain))), "\n"), 256).alias("hash")
    )
    nodes = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        children = F.sort_array(F.collect_list(F.concat("prefix", F.lit(":"), "hash")))
        level = level.groupBy(F.substring("prefix", 1, d).alias("prefix")).agg(F.sha2(F.array_join(children, "\n"), 256).alias("hash"))
        nodes = nodes.unionByName(level.withColumn("level", F.lit(d)))
    return nodes.select("level", "prefix", "hash")


def damaged(spark: SparkSession, folder: str, epoch: int, chain: str = "case_id") -> DataFrame:
    """Nodes (level, prefix, stored, found) of an epoch's tree that its heads no longer give; none if it is good."""
    stored = spark.read.parquet(f"{folder}/nodes").filter(F.col("epoch") == epoch)
    depth = stored.agg(F.max("level")).first()[0] or 0
    found = hash_tree(heads_at(spark, folder, epoch, chain), chain, depth).withColumnRenamed("hash", "found")
    met = stored.select("level", "prefix", F.col("hash").alias("stored")).join(found, ["level", "prefix"], "full")
    return met.filter(~F.col("stored").eqNullSafe(F.col("found")))


def last_good(spark: SparkSession, folder: str, chain: str = "case_id") -> int:
    """The newest epoch whose heads still give its tree: where verification may start; 0 if it must start anew."""
    for epoch in range(last_epoch(spark, folder), 0, -1):
        if damaged(spark, folder, epoch, chain).isEmpty():
            return epoch
    return 0


def proof(spark: SparkSession, folder: str, epoch: int, key, chain: str = "case_id") -> tuple[list[str], list[list[str]]]:
    """Proof of where chain ``key`` stood after ``epoch``: the lines of its bucket, and those of each node above it."""
    nodes = spark.read.parquet(f"{folder}/nodes").filter(F.col("epoch") == epoch)
    depth = nodes.agg(F.max("level")).first()[0] or 0
    digits = hashlib.sha256(("" if key is None else str(key)).encode()).hexdigest()
    heads = heads_at(spark, folder, epoch, chain).filter(_digits(F.col(chain)).startswith(digits[:depth]))
    bucket = sorted(r[0] for r in heads.select(_leaf(chain)).collect())
    above = nodes.filter((F.col("level") > 0) & F.lit(digits).startswith(F.expr("substring(prefix, 1, level - 1)")))
    lines = [(r["level"], f"{r['prefix']}:{r['hash']}") for r in above.collect()]
    return bucket, [sorted(line for at, line in lines if at == d) for d in range(depth, 0, -1)]


def proven(root: str, line: str, key, bucket: list[str], above: list[list[str]]) -> bool:
    """Does the proof lead from the chain's ``line`` up to ``root``?"""
    digits = hashlib.sha256(("" if key is None else str(key)).encode()).hexdigest()
    if line not in bucket:
        return False
    node = hashlib.sha256("\n".join(bucket).encode()).hexdigest()
    for depth, lines in zip(range(len(above), 0, -1), above, strict=True):
        if f"{digits[:depth]}:{node}" not in lines:
            return False
        node = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return node == root


def _digits(key: Column) -> Column:
    return F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)


def _leaf(chain: str) -> Column:
    """A head as one line; a null key and an empty one differ."""
    key = F.col(chain).cast("string")
    return F.concat_ws("|", F.when(key.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), key)), *[F.col(c).cast("string") for c in HEAD])


def _ends(rows: DataFrame, chain: str, seq: str) -> DataFrame:
    return rows.groupBy(chain).agg(F.max(seq).cast("long").alias("end_seq"), F.count("*").alias("total"), F.max_by("hash", F.col(seq)).alias("hash"))


def _beside(rows: DataFrame, heads: DataFrame, chain: str) -> DataFrame:
    """``rows`` with the columns of their chain's head, each under ``_`` and its name."""
    named = heads.select(*[F.col(c).alias(f"_of_{c}" if c == chain else f"_{c}") for c in heads.columns])
    return rows.join(named, F.col(chain).eqNullSafe(F.col(f"_of_{chain}")), "left").drop(f"_of_{chain}")
