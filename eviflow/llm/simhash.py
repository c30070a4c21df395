"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, connected components.

64 bits are cut into ``blocks`` blocks. Fingerprints that differ in at most ``distance`` bits agree in at least
``blocks - distance`` of them, so each fingerprint is keyed by every choice of that many blocks, and only fingerprints
that share a key are compared. A key's fingerprints are compared in numpy and give a spanning star per found cluster,
never all pairs. Keys with more than ``hot`` fingerprints are keyed once more, by blocks of their other bits.

Defined cases: null, empty and word-free texts have fingerprint zero and link like any other; repeated rows and equal
fingerprints are collapsed before the search, so a group of copies costs one fingerprint; a null doc_id keeps its row
and never becomes the smallest id of a component; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.llm.common import batch_of, binary_text, written
from eviflow.llm.components import components, local_components

BITS = 64
CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """Unsigned SimHash of a text's shingles."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split() if text else []
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxh64_intdigest(b" ".join(parts), 42)]
    else:
        joined = b" ".join(parts)
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(parts) - words + 1].tolist()
        hashes = list(map(xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], repeat(42)))
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        octets = np.array(hashes[at : at + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield batch_of(schema, (batch.column(0), found))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(bits: list[int], blocks: int, shared: int) -> list[int]:
    """Masks over the given bit numbers, as signed longs: every choice of ``shared`` of ``blocks`` nearly equal blocks."""
    cuts = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), blocks)]
    masks = [sum(chosen) for chosen in combinations(cuts, shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(c, key, fp): the bits of ``fp`` under each mask."""
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("k")).select("k.c", "k.key", "fp")


def linked(batches, distance: int):
    """Batches of (key columns..., fp), sorted by key, to (a, b) stars over the fingerprints linked within a key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = None

    def stars(keys, fps):
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(fps)])
        unsigned = fps.view(np.uint64)
        left, right = [], []
        # Small groups: all members at a given shift at once.
        shift = 1
        member = np.repeat(np.where(sizes <= 64, sizes, 0), sizes)
        place = np.arange(len(fps)) - np.repeat(starts, sizes)
        while len(at := np.flatnonzero(place + shift < member)):
            near = np.bitwise_count(unsigned[at] ^ unsigned[at + shift]) <= distance
            left.append(at[near])
            right.append(at[near] + shift)
            shift += 1
        for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
            own = unsigned[s : s + n]
            root = np.arange(n)
            step = max(1, (1 << 22) // n)
            for lo in range(0, n, step):
                i, j = np.nonzero(np.bitwise_count(own[lo : lo + step, None] ^ own[None, lo:]) <= distance)
                i, j = i + lo, j + lo
                apart = root[i] != root[j]
                if apart.any():
                    root = local_components(n, np.r_[np.arange(n), i[apart]], np.r_[root, j[apart]])
            at = np.flatnonzero(root != np.arange(n))
            left.append(at + s)
            right.append(root[at] + s)
        left, right = np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
        root = local_components(len(fps), left, right)
        at = np.flatnonzero(root != np.arange(len(fps)))
        pairs = np.unique(np.stack([fps[at], fps[root[at]]]), axis=1)
        return batch_of(schema, pairs[:, pairs[0] != pairs[1]])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        held = rows if held is None else np.concatenate([held, rows])
        if not len(held):
            continue
        open_ = int(np.flatnonzero(np.r_[True, (held[1:, :-1] != held[:-1, :-1]).any(axis=1)])[-1])  # the last key may go on
        if open_:
            yield stars(held[:open_, :-1], np.ascontiguousarray(held[:open_, -1]))
            held = held[open_:]
    if held is not None and len(held):
        yield stars(held[:, :-1], np.ascontiguousarray(held[:, -1]))


def links(fps: DataFrame, distance: int = 4, blocks: int = 7, hot: int = 4096) -> DataFrame:
    """(a, b): stars over distinct fingerprints whose components are those of all pairs within ``distance`` bits."""
    shared = blocks - distance
    masks = block_masks(list(range(BITS)), blocks, shared)
    rows = keyed(fps, masks)
    crowded = rows.groupBy("c", "key").count().filter(F.col("count") > hot).select("c", "key", F.lit(True).alias("is_hot"))
    marked = rows.join(crowded, ["c", "key"], "left")
    # A crowded key is cut by choices of blocks of the bits outside its mask: with six blocks, two stay equal.
    subs = []
    for mask in masks:
        rest = [b for b in range(BITS) if not mask >> b & 1]
        subs.append(block_masks(rest, distance + 2, 2))
    sub = F.array(*[F.array(*[F.lit(m) for m in s]) for s in subs])
    cut = F.when(F.col("is_hot"), F.transform(F.element_at(sub, F.col("c") + 1), lambda m, i: F.struct(i.cast("long").alias("i"), m.bitwiseAND(F.col("fp")).alias("bits"))))
    cut = F.coalesce(cut, F.array(F.struct(F.lit(-1).cast("long").alias("i"), F.lit(0).cast("long").alias("bits"))))
    spread = marked.select("c", "key", F.explode(cut).alias("s"), "fp").select(F.col("c").cast("long").alias("c"), "key", "s.i", "s.bits", "fp")
    dealt = spread.repartition("c", "key", "i", "bits").sortWithinPartitions("c", "key", "i", "bits")
    return dealt.mapInArrow(lambda batches: linked(batches, distance), "a long, b long")


def near_duplicates(docs: DataFrame, folder: str, words: int = 4, distance: int = 4, blocks: int = 7, hot: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id): one row per document with the smallest doc_id that its fingerprint reaches."""
    marks = written(fingerprints(docs, words), folder, "fingerprints")
    classes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("smallest")), folder, "classes")
    edges = written(links(classes.select("fp"), distance, blocks, hot).distinct(), folder, "links")
    labels = components(edges, folder)
    grouped = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "smallest", F.coalesce("label", "fp").alias("label"))
    least = grouped.groupBy("label").agg(F.min("smallest").alias("component_id"))
    of_class = written(grouped.join(least, "label").select(F.col("fp").alias("class_fp"), "component_id"), folder, "class_ids")
    return marks.join(of_class, marks["fp"] == of_class["class_fp"]).select("doc_id", "fp", "component_id")
