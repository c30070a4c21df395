"""Ranked lexical search of a stated query set, by range maxima over posting lists.

Documents are cut once and known from then on by the query terms that they hold. Tasks read them in shards of bounded
size. A shard keeps one posting list per term in doc_id order, with a sparse table that answers the largest impact of a
list in any interval of documents. The sum of a query's answers bounds every score in an interval, so intervals wait in
a heap, the best bound first: the top one is split at its document of largest impact, which is scored, and its two sides
go back with bounds of their own; intervals of ``LEAF`` documents or fewer are scored whole. A query ends where no bound
can enter its best ``k``; the best so far go from shard to shard of a task. The tasks' best are merged per query.

Query items are met in blocks of about ``BLOCK_ITEMS``, so what a task holds of them does not grow with the item table.

Scores are integers: sum over the item's terms of w * ((1000000000 * tf) div (1000 * tf + 8 * m)).

Defined cases: a null or empty text has no terms, is not counted among documents and is never found; an item without
terms finds nothing; equal scores go by ascending doc_id, a null doc_id last; repeated rows of documents are documents of
their own, repeated items are searched each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.llm.common import batch_of, binary_text, written
from eviflow.operators.common import top_k

BLOCK_ITEMS = 1000
SHARD_DOCS, SHARD_POSTINGS = 4096, 1_000_000
LEAF, BATCH = 64, 32
#: Stands for a null doc_id in orders.
LAST = (1 << 63) - 1
_KEPT = {c: c | 32 if 65 <= c <= 90 else c for c in range(256) if c >= 128 or chr(c).isalnum()}
_TABLE = bytes(_KEPT.get(c, 32) for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters and digits and of all further characters, A-Z in lower case."""
    return text.translate(_TABLE).split() if text else []


def counted(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; only terms of the broadcast ``vocabulary`` are listed."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches):
        number = vocabulary.value
        for batch in batches:
            out = ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                own = Counter(map(number.get, words))
                own.pop(None, None)
                for column, value in zip(out, (doc, len(words), list(own), list(own.values())), strict=True):
                    column.append(value)
            yield batch_of(schema, out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Posting lists of some documents, one after the other in term order, and the sparse table over them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: list, tfs: list, weights: np.ndarray, scale: tuple[int, int]):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.n = ids[order], len(ids)
        doc = np.repeat(place, [len(t) for t in terms])
        norm = np.repeat(10 + (90 * lengths * scale[0]) // scale[1], [len(t) for t in terms])
        term, tf = np.concatenate([np.zeros(0, np.int64), *terms]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *tfs]).astype(np.int64)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm))
        keys = term * self.n + doc
        order = np.argsort(keys)
        self.keys, self.impact, self.doc = keys[order], impact[order], doc[order]
        longest = int(np.bincount(term).max()) if len(term) else 0
        table = [np.arange(len(keys), dtype=np.int32)]
        while (2 << (len(table) - 1)) <= longest:
            last, step = table[-1], 1 << (len(table) - 1)
            after = np.concatenate([last[step:], last[len(last) - step :]])
            table.append(np.where(self.impact[last] >= self.impact[after], last, after))
        self.table = np.stack(table)

    def spans(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of each term (columns) in each interval (rows) begin and end."""
        base = terms[None, :] * self.n
        return np.searchsorted(self.keys, base + low[:, None]), np.searchsorted(self.keys, base + high[:, None])

    def maxima(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bound, document of largest impact) of each interval."""
        a, b = self.spans(terms, low, high)
        size = b - a
        level = np.frexp(np.maximum(size, 1))[1] - 1
        left = self.table[level, np.minimum(a, len(self.keys) - 1)]
        right = self.table[level, np.maximum(b - (1 << level), 0)]
        best = np.where(self.impact[left] >= self.impact[right], left, right)
        value = np.where(size > 0, self.impact[best], 0)
        return value.sum(axis=1), self.doc[best[np.arange(len(low)), value.argmax(axis=1)]]

    def scores(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of single documents."""
        keys = terms[None, :] * self.n + docs[:, None]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.impact[at], 0).sum(axis=1)

    def interval_scores(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of every document with a term in the intervals."""
        a, b = (x.ravel() for x in self.spans(terms, low, high))
        size = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        docs, of = np.unique(self.doc[at], return_inverse=True)
        return docs, np.bincount(of, weights=self.impact[at], minlength=len(docs)).astype(np.int64)  # exact below 2 ** 53

    def search(self, terms: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Bring ``best``, sorted (-score, doc_id), up to date with the shard's documents."""
        if not len(self.keys) or not len(terms):
            return

        def offer(docs, scores):
            if len(best) == k:
                keep = scores >= -best[-1][0]
                docs, scores = docs[keep], scores[keep]
            for entry in zip((-scores).tolist(), self.ids[docs].tolist(), strict=True):
                if entry[0] < 0 and (len(best) < k or entry < best[-1]):
                    insort(best, entry)
                    del best[k:]

        def push(low, high):
            bounds, peaks = self.maxima(terms, low, high)
            for bound, x, y, peak in zip(bounds.tolist(), low.tolist(), high.tolist(), peaks.tolist(), strict=True):
                if bound and not (len(best) == k and (-bound, int(self.ids[x])) >= best[-1]):
                    heapq.heappush(waiting, (-bound, int(self.ids[x]), x, y, peak))

        waiting: list[tuple[int, int, int, int, int]] = []
        push(np.array([0]), np.array([self.n]))
        while waiting and not (len(best) == k and waiting[0][:2] >= best[-1]):
            taken = [heapq.heappop(waiting) for _ in range(min(BATCH, len(waiting)))]
            x, y, peak = np.array([t[2:] for t in taken]).T
            small = y - x <= LEAF
            if small.any():
                offer(*self.interval_scores(terms, x[small], y[small]))
            if not small.all():
                x, y, peak = x[~small], y[~small], peak[~small]
                offer(peak, self.scores(terms, peak))
                low, high = np.r_[x, peak + 1], np.r_[peak, y]
                push(low[low < high], high[low < high])


def best_of(rows: DataFrame, queries, weights, scale: tuple[int, int], k: int) -> DataFrame:
    """(query, doc_id, score): the best ``k`` of every task for each of the broadcast ``queries`` (arrays of terms)."""
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def shards(batches):
        held, n, postings = [], 0, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            ids = columns[0].fill_null(LAST).to_numpy(zero_copy_only=False)
            for row in zip(ids, columns[1].to_numpy(), (x.values.to_numpy() for x in columns[2]), (x.values.to_numpy() for x in columns[3]), strict=True):
                held.append(row)
                n, postings = n + 1, postings + len(row[2])
                if n >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield held
                    held, n, postings = [], 0, 0
        if held:
            yield held

    def run(batches):
        asked = queries.value
        best = [[] for _ in asked]
        for held in shards(batches):
            ids, lengths, terms, tfs = zip(*held, strict=True)
            shard = Shard(np.array(ids, dtype=np.int64), np.array(lengths, dtype=np.int64), terms, tfs, weights.value, scale)
            for own, found in zip(asked, best, strict=True):
                shard.search(own, found, k)
        found = [(q, None if doc == LAST else doc, -score) for q, own in enumerate(best) for score, doc in own]
        yield batch_of(schema, zip(*found, strict=True) if found else [[]] * 3)

    return rows.mapInArrow(run, "query int, doc_id long, score long")


def search_block(docs: DataFrame, items: list[tuple], folder: str, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of the given items (item_id, text)."""
    spark = docs.sparkSession
    own = [sorted(set(terms_of(text.encode() if text is not None else None))) for _, text in items]
    number = {t: i for i, t in enumerate(sorted({t for of in own for t in of}))}
    rows = written(counted(docs, spark.sparkContext.broadcast(number)), folder, "counted")
    total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    frequency = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # one row per query term at most
    weights = np.zeros(max(len(number), 1), dtype=np.int64)
    for row in frequency:
        weights[row["term"]] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * row["df"] + 1)))
    queries = [np.array([number[t] for t in of], dtype=np.int64) for of in own]
    broadcast = spark.sparkContext.broadcast
    found = best_of(rows, broadcast(queries), broadcast(weights), (total["n"], total["l"] or 1), k)
    ranked = top_k(found, ["query"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "query int, item_id long")
    return ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")  # as many ids as the block has items


def search(docs: DataFrame, items: DataFrame, folder: str, k: int = 10, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents of highest score above 0."""
    asked = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), folder, "items")
    blocks = max(1, -(-asked.count() // block_items))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for b in range(blocks):
        own = [tuple(r) for r in asked.filter(block == b).collect()]  # about block_items rows of the query set
        if blocks == 1:
            return search_block(docs, own, f"{folder}/block-{b}", k)
        found.append(f"{folder}/found/block={b}")
        search_block(docs, own, f"{folder}/block-{b}", k).write.parquet(found[-1])
    return docs.sparkSession.read.parquet(*found)
