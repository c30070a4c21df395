"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row draws one child of the node it is in: every child has the draw ``-ln(u) / weight`` with ``u`` a hash
of (doc_id, child), and the least draw wins. A child's share is its weight, and when a weight changes, rows move only
within the node whose children it compares: into a child that grew, or out of one that shrank.

The tree is a rule of the shard count: shard i is in rack i mod ``racks``, rack r in region r mod ``regions``. Regions
and racks that hold a shard weigh the same whatever they hold, so one more shard changes the weights inside one rack
alone, and takes rows only into itself. doc_id and the shard count decide (law ``key``).

Defined cases: a null doc_id is a key like any other; a null text has size 16 and the crc32 of an empty text; rows with
equal doc_id share a shard and take successive slots; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGIONS, RACKS = 2, 8
OVERHEAD_BYTES = 16


def uniform(key: Column, level: str, child: int) -> Column:
    """A number in (0, 1] from the md5 of level, child and key (52 bits)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{level}{child}:"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def draw(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The child with the least weighted draw, the smaller number first among equals."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.array_min(F.array(*[F.struct((-F.ln(uniform(key, level, c)) / F.lit(float(w))).alias("at"), F.lit(c).alias("child")) for c, w in sorted(weights.items())]))["child"]


def tree(shards: int, regions: int = REGIONS, racks: int = RACKS) -> dict[int, dict[int, list[int]]]:
    """region -> rack -> shards, of those that hold a shard."""
    out: dict[int, dict[int, list[int]]] = {}
    for shard in range(shards):
        rack = shard % racks
        out.setdefault(rack % regions, {}).setdefault(rack, []).append(shard)
    return out


def descend(docs: DataFrame, key: Column, name: str, nodes: dict[int, dict[int, list[int]]], weight: dict[tuple, float] | None = None) -> DataFrame:
    """``docs`` with column ``name``: the shard reached. ``weight``: of (region,), (region, rack) or (region, rack, shard); 1 where absent."""
    weight = weight or {}

    def pick(cases: list[tuple[int, Column]], at: str) -> Column:
        out = cases[0][1]
        for value, case in cases[1:]:
            out = F.when(F.col(at) == value, case).otherwise(out)
        return out

    docs = docs.withColumn("_key", key).withColumn("_region", draw(F.col("_key"), "region", {r: weight.get((r,), 1.0) for r in nodes}))
    docs = docs.withColumn("_rack", pick([(r, draw(F.col("_key"), "rack", {k: weight.get((r, k), 1.0) for k in own})) for r, own in nodes.items()], "_region"))
    leaves = [(k, draw(F.col("_key"), "shard", {s: weight.get((r, k, s), 1.0) for s in own})) for r, of in nodes.items() for k, own in of.items()]
    return docs.withColumn(name, pick(leaves, "_rack")).drop("_key", "_region", "_rack")


def placed(docs: DataFrame, shards: int = 40, regions: int = REGIONS, racks: int = RACKS, slot_buckets: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Slots run from 0 without gaps in each shard. A shard is numbered in ``slot_buckets`` hash buckets whose counts give
    the first slot of each, so no task orders a whole shard.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("text").isNull(), 0).otherwise(F.octet_length(text)).cast("long").alias("octets"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("size", F.col("octets") + OVERHEAD_BYTES)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = descend(descend(rows, key, "shard", tree(shards, regions, racks)), key, "grown_shard", tree(shards + 1, regions, racks))
    rows = rows.withColumn("bucket", F.conv(F.substring(F.md5(F.concat(F.lit("slot:"), key, F.lit(":"), F.col("text_crc32").cast("string"))), 1, 8), 16, 10).cast("long") % slot_buckets)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    found = rows.withColumn("own", own).join(counts.select("shard", "bucket", before.alias("before")), ["shard", "bucket"])
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"), "grown_shard")
