"""Nearest neighbours by largest inner product with vantage-point trees, one per shard.

Inner products become distances: every vector x of a shard gets one more coordinate, sqrt(R^2 - |x|^2) with R the
shard's largest norm, and a query gets 0 there; then |q - x|^2 = |q|^2 + R^2 - 2 q.x, so that the nearest point has
the largest product. A tree node keeps a vantage point and its median distance; by the triangle inequality a query at
distance d from it can't have a point nearer than d - median inside, nor nearer than median - d outside. A leaf is
skipped when ``relax`` times its bound reaches the distance of the k-th point found: 1 is exact, more is faster.

Queries and rows meet by (shard, query block): rows of a shard are copied once per query block, queries once per shard,
so that a task holds ``shard_rows`` rows and ``block_queries`` queries at most about. Equal vectors of a shard are one
point, with its k + 1 smallest ids: no other of them can be among k nearest. Scores are added up coordinate by
coordinate in double precision, so equal vectors tie exactly.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; rows
with equal vec_id are candidates of their own, but never for the query of that id; vectors of another length than the
query's are other points that are never compared; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 256
#: Queries that look through a tree at a time; the pairs that each of them meets on the way are held until they are scored.
QUERIES = 1024


def products(queries: np.ndarray, points: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (queries[q], points[p]), added in coordinate order; vectors are not copied pair by pair."""
    total = np.zeros(len(p))
    for own, other in zip(queries.T.copy(), points.T.copy()):  # a point's further coordinate is not the query's
        total += own[q] * other[p]
    return total


class Tree:
    """Vantage-point tree over points; leaves hold at most ``LEAF`` of them."""

    def __init__(self, points: np.ndarray, seed: int = 0):
        self.points, self.leaves, self.paths, draw = points, [], [], np.random.default_rng(seed)
        todo = [(np.arange(len(points)), ())]
        self.vantages, self.medians = [], []
        while todo:
            at, path = todo.pop()
            if len(at) <= LEAF:
                self.leaves.append(at)
                self.paths.append(path)
                continue
            vantage = int(at[draw.integers(len(at))])
            far = np.linalg.norm(points[at] - points[vantage], axis=1)
            order = np.argsort(far, kind="stable")
            half = len(at) // 2
            node = len(self.medians)
            self.vantages.append(vantage)
            self.medians.append(float(far[order[half]]))
            # Inside: distances up to the median; outside: from the median on.
            todo += [(at[order[:half]], (*path, (node, True))), (at[order[half:]], (*path, (node, False)))]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """[leaf, query] lower bounds of the distance to any point of the leaf."""
        out = np.zeros((len(self.leaves), len(queries)))
        if not self.medians:
            return out
        far = np.sqrt(np.maximum(((queries**2).sum(axis=1)[:, None] + (self.points[self.vantages] ** 2).sum(axis=1)[None]) - 2 * queries @ self.points[self.vantages].T, 0))
        gap = far - np.array(self.medians)[None]
        for leaf, path in enumerate(self.paths):
            for node, inside in path:
                np.maximum(out[leaf], gap[:, node] if inside else -gap[:, node], out=out[leaf])
        return out

    def search(self, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs that hold the k nearest points of each query, all ties of the k-th included."""
        norms = (self.points**2).sum(axis=1)
        own = (queries**2).sum(axis=1)
        bound = self.bounds(queries)
        limit = np.full(len(queries), np.inf)
        best = np.full((len(queries), 0), np.inf)
        left, right = [], []
        order = np.argsort(bound, axis=0, kind="stable")  # each query visits its nearest leaves first
        slack = 1e-9 * (np.sqrt(own) + np.sqrt(norms.max(initial=0.0)) + 1) ** 2
        for turn in range(len(self.leaves)):
            leaf_of = order[turn]
            near = relax * bound[leaf_of, np.arange(len(queries))] <= np.sqrt(limit + slack)
            if not near.any():
                break
            for leaf in np.unique(leaf_of[near]):
                q = np.flatnonzero(near & (leaf_of == leaf))
                at = self.leaves[leaf]
                far = np.maximum(own[q, None] + norms[None, at] - 2 * queries[q] @ self.points[at].T, 0)
                i, j = np.nonzero(far <= (limit[q] + slack[q])[:, None])
                left.append(q[i])
                right.append(at[j])
                merged = np.sort(np.concatenate([best[q], far], axis=1), axis=1)[:, :k]
                if best.shape[1] < k:
                    wider = np.full((len(queries), k), np.inf)
                    wider[:, : best.shape[1]] = best
                    best = wider
                best[q, : merged.shape[1]] = merged
                limit[q] = best[q, k - 1] if best.shape[1] == k else np.inf
        return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def shard_search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float) -> pd.DataFrame:
    """The k best rows of one shard for each query (its own row left out), with exact scores."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, point = np.unique(vectors, axis=0, return_inverse=True)
    by_point = np.argsort(point, kind="stable")
    starts = np.searchsorted(point[by_point], np.arange(len(distinct) + 1))
    longest = (distinct**2).sum(axis=1).max()
    lifted = np.c_[distinct, np.sqrt(np.maximum(longest - (distinct**2).sum(axis=1), 0))]
    tree, found = Tree(lifted), []
    for low in range(0, len(queries), QUERIES):
        found.append(block_search(tree, ids[by_point], starts, query_ids[low : low + QUERIES], queries[low : low + QUERIES], k, relax))
    return pd.concat(found)


def block_search(tree: Tree, ids: np.ndarray, starts: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float) -> pd.DataFrame:
    """:func:`shard_search` for some queries; point i of ``tree`` is that of the rows ``ids[starts[i]:starts[i + 1]]``."""
    # One point more than k, as the query's own row may be the only one of its point.
    q, p = tree.search(np.c_[queries, np.zeros(len(queries))], k + 1, relax)
    score = products(queries, tree.points, q, p)
    keep = np.lexsort((-score, q))
    q, p, score = q[keep], p[keep], score[keep]
    # Points below the (k+1)-th best score of their query can't matter; ties of it stay.
    first = np.searchsorted(q, np.arange(len(queries)))
    last = np.searchsorted(q, np.arange(len(queries)), side="right")
    worst = score[np.minimum(first + k, np.maximum(last - 1, 0))] if len(score) else np.zeros(len(queries))
    keep = score >= worst[q]
    q, p, score = q[keep], p[keep], score[keep]
    sizes = np.minimum(starts[p + 1] - starts[p], k + 1)
    row = np.repeat(starts[p], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = pd.DataFrame({"query_id": query_ids[np.repeat(q, sizes)], "vec_id": ids[row], "score": np.repeat(score, sizes)})
    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return out.groupby("query_id", sort=False).head(k)[["query_id", "vec_id", "score"]]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad & F.exists("v", lambda x: x != 0))


def search(embeddings: DataFrame, k: int = 20, every: int = 20, relax: float = 1.0, shard_rows: int = 8192, block_queries: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every row whose vec_id is divisible by ``every``."""
    rows = usable(embeddings)
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    shards, blocks = max(1, -(-counts["n"] // shard_rows)), max(1, -(-counts["q"] // block_queries))
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    length = F.size("v")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    points = rows.select(shard.alias("shard"), numbers(blocks).alias("block"), length.alias("length"), "vec_id", "v")
    asked = rows.filter(F.col("vec_id") % every == 0).select(numbers(shards).alias("shard"), block.alias("block"), length.alias("length"), "vec_id", "v")

    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if points.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        wide = lambda frame: np.array(frame["v"].tolist(), dtype=np.float64)
        return shard_search(points["vec_id"].to_numpy(), wide(points), asked["vec_id"].to_numpy(), wide(asked), k, relax)

    key = ["shard", "block", "length"]
    found = points.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
