"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is a circular stream of words: its documents in a seeded random order. Its target is cut into blocks of
``block_words`` words, a source's quota. Quotas and shard sizes are the margins of one table, drawn top down: sources are
the leaves of a tree of fan-out ``FAN``, a node holds the room that its sources have in every shard, and its children
take theirs from it one by one, each quota split down a binary tree over the shards by hypergeometric draws. So every
source gets its exact quota, every shard its exact number of blocks, and the blocks are dealt as if drawn from one urn. A
shard takes a range of each source's permuted blocks; ranges of different shards are disjoint, and what a document gives
is the sum over the blocks dealt to the shards. Rows of a shard are put in a seeded order.

The plan is a table with a row per source; the driver sees totals only. A draw from over 10^9 blocks is a rounded normal
one within the exact limits.

Defined cases: a null source is a source, last in order; null and word-free texts have size zero and are never taken;
a source without words has target zero; rows with equal doc_id are documents of their own and equal rows are
interchangeable; an empty table gives no rows; further columns are carried whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eviflow.llm.common import batch_of, packed, rows_of, word_list, work_folder, written

#: Children of a node of the tree over the sources.
FAN = 256
DEALT = pa.schema([("node", pa.int64()), ("room", pa.list_(pa.int64())), ("step", pa.int64())])


def source_targets(rows: DataFrame, folder: str, weights=(5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, s, source_size, n_docs, target, take): a row per source of ``rows (source, size)``, written under ``folder``.

    ``s`` is the source's place by code point, nulls last. Sources share ``total`` times all words by repeating weights,
    none above ``most`` times its own words; the excess goes to the others by weight until none is above.
    """
    order = F.col("source").asc_nulls_last()
    known = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranged = written(known.repartitionByRange(order).withColumn("part", F.spark_partition_id()), folder, "sources")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(order)) + F.col("before") - 1
    placed = written(ranged.join(parts, "part").withColumn("s", at.cast("long")).drop("part", "before"), folder, "places")
    size = F.col("source_size")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    share, stopped, n_stopped = None, F.lit(False), -1
    while True:  # the share of a unit of weight only grows, so sources once stopped stay so
        sums = placed.agg(
            F.sum("source_size").alias("words"),
            F.count_if(stopped).alias("n"),
            F.sum(F.when(stopped, most * size)).alias("given"),
            F.sum(F.when(~stopped & (size > 0), weight)).alias("weight"),
        ).first()
        if not sums["weight"] or sums["n"] <= n_stopped:
            break
        n_stopped = sums["n"]
        share = F.lit(total * sums["words"] - (sums["given"] or 0.0)) * weight / F.lit(sums["weight"])
        stopped = (size > 0) & (share > most * size)
    target = F.lit(0.0) if share is None else F.when(size == 0, 0.0).otherwise(F.least(share, most * size))
    return placed.withColumn("target", target).withColumn("take", F.rint("target").cast("long"))


def split_quotas(quotas: list[int], shards: int, seed, room: list[int] | None = None) -> np.ndarray:
    """[shard, source] blocks: each quota split down a binary tree over the shards, out of the ``room`` that is left.

    At a node the left half's blocks are one hypergeometric draw. Without ``room``, shards are equal up to one block.
    """
    total = sum(quotas)
    room = np.diff([total * k // shards for k in range(shards + 1)]) if room is None else np.array(room, dtype=np.int64)
    out, draw = np.zeros((shards, len(quotas)), dtype=np.int64), np.random.default_rng(seed)
    for i, quota in enumerate(quotas):
        todo = [(0, shards, quota)]
        while todo:
            lo, hi, n = todo.pop()
            if n and hi - lo == 1:
                out[lo, i] = n
            elif n:
                mid = (lo + hi) // 2
                left = _hypergeometric(draw, int(room[lo:mid].sum()), int(room[mid:hi].sum()), n)
                todo += [(lo, mid, left), (mid, hi, n - left)]
        room = room - out[:, i]
    return out


def _hypergeometric(draw, good: int, bad: int, n: int) -> int:
    if not n or not good:
        return 0
    if not bad:
        return n
    if good + bad < 10**9:
        return int(draw.hypergeometric(good, bad, n))
    all_ = good + bad
    spread = math.sqrt(n * good / all_ * bad / all_ * (all_ - n) / (all_ - 1))
    return min(max(round(draw.normal(n * good / all_, spread)), n - bad, 0), good, n)


def deal_blocks(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(node, room, step) per row of ``quotas (s, quota)``: ``room`` holds the ends of the shards' ranges in the source's
    permuted blocks, block b has place ``b * step mod quota``.

    Every draw is seeded by its node, so a task that is run again deals the same.
    """
    spark = quotas.sparkSession
    sums = quotas.agg(F.sum("quota").alias("total"), F.max("s").alias("last")).first()
    total, depth = sums["total"] or 0, 1
    while FAN**depth <= (sums["last"] or 0):
        depth += 1
    ends = [total * k // shards for k in range(shards + 1)]
    nodes = spark.createDataFrame([(0, [b - a for a, b in zip(ends, ends[1:])])], "node long, room array<long>")
    for level in range(depth - 1, -1, -1):
        child = F.floor(F.col("s") / F.lit(FAN**level))
        children = quotas.groupBy(child.alias("child")).agg(F.sum("quota").alias("quota"))
        listed = children.groupBy(F.floor(F.col("child") / FAN).alias("of")).agg(F.sort_array(F.collect_list(F.struct("child", "quota"))).alias("children"))
        met = nodes.join(listed, F.col("node") == F.col("of")).select("node", "room", "children")
        nodes = met.mapInArrow(_dealer(level, seed), "node long, room array<long>, step long")
    return nodes


def _dealer(level: int, seed: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, room, children in rows_of(batch):  # a batch per node, as rows hold a number for every shard
                quotas = [c["quota"] for c in children]
                dealt = split_quotas(quotas, len(room), [seed, level, node], room)
                steps = [_step(max(q, 1)) for q in quotas] if level == 0 else [0] * len(quotas)
                room = dealt if level else np.cumsum(dealt, axis=0)
                yield batch_of(DEALT, ([c["child"] for c in children], room.T.tolist(), steps))

    return deal


def _step(q: int) -> int:
    """A number near the golden section of ``q`` without a common divisor."""
    return next(a for a in range(int(q * 0.6180339887) + 1, 2 * q + 2) if math.gcd(a, q) == 1)


def source_plan(rows: DataFrame, folder: str, shards: int = 64, weights=(5, 2, 1), total=1.5, most=2.0, block_words=1 << 12, seed=7) -> DataFrame:
    """The targets of all sources with their quota in blocks, the shards' ``ends`` and ``step``, written under ``folder``."""
    found = source_targets(rows, folder, weights, total, most)
    found = written(found.withColumn("quota", F.floor((F.col("take") + (block_words - 1)) / F.lit(block_words))), folder, "targets")
    dealt = deal_blocks(found.select("s", "quota"), shards, seed).withColumnRenamed("room", "ends")
    return written(found.join(dealt, F.col("s") == F.col("node")).drop("node"), folder, "plan")


def mix(docs: DataFrame, folder: str | None = None, carry: list[str] | None = None, **options) -> DataFrame:
    """Every row of ``docs`` as ``doc`` (all columns, or those in ``carry``), with size, source_size, target, taken and ``draws``.

    ``draws`` holds one entry for each pass and block in which the mix takes words of the document: pass, block, shard,
    words; ``taken`` is the sum of their words. ``folder``: where the sizes are written, so that texts are read once.
    Options: those of :func:`source_plan`, and ``bucket_docs``.
    """
    return _mixed(docs, folder, carry, **options)[0]


def _mixed(docs, folder=None, carry=None, shards=64, block_words=1 << 12, bucket_docs=2000, seed=7, **options) -> tuple[DataFrame, int]:
    """The rows of :func:`mix` and the words that all sources give."""
    text = F.col("text").cast("string")
    rows = packed(docs, F.col("source").cast("string").alias("source"), F.size(word_list(text)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("h"), carry=carry)
    if folder:
        rows = written(rows, folder, "sizes")
    plan = source_plan(rows.select("source", "size"), folder or work_folder(docs.sparkSession), shards, block_words=block_words, seed=seed, **options)
    buckets = F.ceil(F.col("n_docs") / bucket_docs)
    light = plan.select("source", "s", "source_size", "target", "take", buckets.alias("buckets"))
    rows = rows.withColumnRenamed("source", "own_source")
    of = rows.join(light, F.col("own_source").eqNullSafe(F.col("source")), "inner").drop("own_source", "source")
    of = of.withColumn("bucket", F.pmod(F.col("h"), F.col("buckets")))
    sums = of.groupBy("s", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("s").alias("bs"), F.col("bucket").alias("bb"), before.alias("before"))
    own = F.coalesce(F.sum("size").over(Window.partitionBy("s", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = of.withColumn("own", own).join(starts, (F.col("s") == F.col("bs")) & (F.col("bucket") == F.col("bb")))
    placed = placed.withColumn("at", F.col("own") + F.col("before"))
    spanned = placed.withColumn("spans", _spans(block_words)).join(plan.select(F.col("s").alias("ps"), "quota", "step", "ends"), F.col("s") == F.col("ps"))
    dealt = spanned.withColumn("draws", F.filter(_with_shards(), lambda d: d["shard"] < shards))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return dealt.select("doc", "size", "source_size", "target", taken.alias("taken"), "draws"), plan.agg(F.sum("take")).first()[0] or 0


def _spans(block_words: int):
    """Per pass over the source and per block: the words of the document that the target takes."""
    size, at, words, take = F.col("size"), F.col("at"), F.col("source_size"), F.col("take")

    def of_pass(p):
        first, last = p * words + at, F.least(p * words + at + size, take)
        blocks = F.when(last > first, F.sequence(F.floor(first / block_words), F.floor((last - 1) / block_words))).otherwise(F.array().cast("array<bigint>"))

        def of_block(b):
            return F.struct(p.alias("pass"), b.alias("block"), (F.least(last, (b + 1) * block_words) - F.greatest(first, b * block_words)).alias("words"))

        return F.transform(blocks, of_block)

    passes = F.when((size > 0) & (take > 0), F.sequence(F.lit(0).cast("long"), F.floor((take - 1) / words))).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(passes, of_pass))


def _with_shards():
    """Spans with the shard whose range holds the block's permuted place (the number of shards if none does)."""

    def place(x):
        permuted = F.pmod(x["block"] * F.col("step"), F.col("quota"))
        shard = F.size(F.filter("ends", lambda end: end <= permuted))
        return F.struct(x["pass"].alias("pass"), x["block"].alias("block"), shard.alias("shard"), x["words"].alias("words"))

    return F.transform("spans", place)


def mixed_documents(docs: DataFrame, shards: int = 64, seed: int = 7, part_words: int = 1 << 24, **options) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document, whole, in its shard's random order.

    A document goes to the shard of the first block that takes it in that pass; at most one document of a source and
    pass is taken in part, and it is kept whole. A shard is written by as many tasks, one after the other in its order,
    as it has ``part_words`` words.
    """
    found, words = _mixed(docs, shards=shards, seed=seed, **options)
    parts = -(-words // (shards * part_words)) or 1
    firsts = F.filter("draws", lambda d, i: (i == 0) | (d["pass"] != F.element_at("draws", i)["pass"]))
    copies = found.select("doc", F.explode(firsts).alias("draw")).select("doc", "draw.shard", F.xxhash64(F.lit(seed + 1), "doc.doc_id", "draw.pass").alias("order"))
    part = F.floor(F.shiftrightunsigned(F.col("order"), 33) * F.lit(parts) / F.lit(1 << 31))
    place = (F.col("shard") * parts + part).cast("int")
    unsigned = F.shiftrightunsigned(F.col("order"), 1)
    return copies.repartitionById(shards * parts, place).sortWithinPartitions(unsigned, "order").select("doc.*")
