"""Connected components: within a task by label spreading, across the cluster by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.llm.common import written


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' components under the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (hop := label[label] != label).any():
            label[hop] = label[label[hop]]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the smallest node of its component.

    Large-star and small-star rounds, each written, until the edges stay as they are; sums and minima are combined in the
    map tasks, and a node of many edges is met by joins that Spark can split, never by one task.
    """
    now = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen, round_ = written(now, folder, "round-0"), None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v"))).groupBy("node").agg(F.min("label").alias("label"))
        seen, round_ = state, round_ + 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = written(pairs.filter(F.col("u") != F.col("v")).distinct(), folder, f"round-{round_}")
