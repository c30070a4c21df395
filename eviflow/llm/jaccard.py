"""Near copies by exact Jaccard similarity of word shingles: SimHash, prefix keys, a verifying join, connected components.

SimHash goes first: sets whose fingerprints differ in ``NEAR_BITS`` bits at most are compared as sets, and those that are
similar are linked. At a similarity of 0.8 about ten of 64 bits differ, so prefixes find the pairs that fingerprints miss.

Two sets of a and b shingles with a similarity of t or more share at least t * max(a, b) of them. So in any one order of
all shingles, their first ``n - ceil(t * n) + 1`` shingles (prefixes) share one, and texts are compared only where
prefixes meet. The order puts shingles that are frequent in a bounded sample last; it decides how many texts meet, never
which pairs are found. A pair's first common shingle has places in both orders that bound its overlap, so places too far
back don't count as meeting; in crowded keys, parities of the hashes bound how far sets differ; what is left is compared as sets.

A crowd of near copies does not meet pairwise: of ``rounds`` rounds the first is that of SimHash, in the others each key's
texts meet one of them only, and texts that are linked by then are not compared again. In crowded keys more such rounds, with
``PIVOTS`` texts to meet, go on while more pairs are apart than there are sets and a round takes a good part of them away. The last round, after these, compares
all pairs of a key that are still apart. Pairs pass parities of 512 bits, then parities as long as the sets, before sets are
sent. Links are kept as labels: a round's links lead from label to label, once each, so
components never see the many links of a crowd, nor those of earlier rounds again.

Shingles and sets are known by 64-bit hashes. Defined cases: words are cut and lower-cased as in ``simhash``; a text of
fewer words is one shingle; null, empty and word-free texts have the empty set and are copies of each other; equal sets
are collapsed before the search; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.llm import simhash
from eviflow.llm.common import batch_of, binary_text, freed, written
from eviflow.llm.components import components

SAMPLE_DOCS = 20_000
FREQUENT = 200_000
#: Bits of the filter that keeps most texts out of a join on few rows.
FILTER_BITS = 1 << 23
#: 64-bit words of a set's parities: each bit is the parity of the hashes that fall on it.
PARITIES = [f"p{i}" for i in range(8)]
#: Prefix keys are dealt in so many passes, so that one part of them is shuffled at a time.
PASSES = 4
#: Texts of a crowded key that the others meet in one of the rounds for crowds.
PIVOTS = 8
#: Another round is worth it where the last one left at most this share of the pairs apart.
WORTH = 0.7
#: Keys of more sets compare parities before a pair is made.
CROWD = 64
#: Fingerprints that differ in so many bits meet; they are cut into two blocks more, of which two are equal then.
NEAR_BITS = 3


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split() if text else []
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    of_word = np.fromiter(map(xxh64_intdigest, parts, repeat(42)), dtype=np.uint64, count=len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    x = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        x = x * np.uint64(0x9E3779B97F4A7C15) + of_word[k : k + n]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(x ^ (x >> np.uint64(31)))


def common_shingles(rows: DataFrame, words: int, sample_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, ranks): shingles of several texts of a sample, the rarest first; it steers the order only."""
    share = min(1.0, sample_docs / max(rows.count(), 1))
    place = F.pmod(F.xxhash64(F.lit(13), "row"), F.lit(1 << 20))
    schema = pa.schema([("h", pa.int64())])

    def run(batches):
        for batch in batches:
            found = [shingles(t, words) for t in batch.column(0).to_pylist()]
            yield batch_of(schema, (np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64),))

    counts = rows.filter(place < F.lit(int(share * (1 << 20)) + 1)).select(binary_text().alias("text")).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))
    often = counts.filter(F.col("n") > 2).orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    hashes = often["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], often["n"].to_numpy(dtype=np.int64)[order]


def wide_parity(items: np.ndarray) -> bytes:
    """The parities of a set's hashes in as many bits as twice the set's size and more, a power of two, 512 at least."""
    bits = max(512, 1 << (2 * len(items) - 1).bit_length()) if len(items) else 512
    return np.packbits(np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def wide_differ(a: bytes, b: bytes) -> int:
    """Bits that differ of two :func:`wide_parity`, the longer one folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(x) < len(y):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def prefixes(rows: DataFrame, words: int, percent: int, sample_docs: int) -> DataFrame:
    """(row, class, n, fp, parities, wide, prefix) of every text: the hash of its set, the set's size, SimHash, parities and first shingles.

    SimHash, wide parities and prefix are null where the same task gave those of an equal set before.
    """
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, words, sample_docs))
    schema = pa.schema([("row", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), *[(p, pa.int64()) for p in PARITIES], ("wide", pa.binary()), ("prefix", pa.list_(pa.int64()))])
    bits = np.uint64(64 * len(PARITIES) - 1)

    def run(batches):
        from xxhash import xxh3_64_intdigest

        hashes, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingles(text, words)
                sign = xxh3_64_intdigest(own.tobytes())
                parity = np.packbits(np.bincount((own & bits).astype(np.int64), minlength=64 * len(PARITIES)) & 1, bitorder="little").view("<i8").tolist()
                if sign in seen:
                    out.append((row, sign, len(own), None, *parity, None, None))
                    continue
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.add(sign)
                mark, wide = simhash.majority(own), wide_parity(own)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    own = own[np.argsort(np.where(hashes[at] == own, counts[at], 0), kind="stable")]
                size = len(own)
                first = size + (-percent * size // 100) + 1 if size else 0
                out.append((row, sign, size, mark - (mark >> 63 << 64), *parity, wide, own[:first].view(np.int64)))
            row, sign, *rest = zip(*out, strict=True) if out else [[]] * len(schema)
            yield batch_of(schema, (row, np.array(sign, dtype=np.uint64).view(np.int64), *rest))

    return rows.select("row", binary_text().alias("text")).mapInArrow(run, f"row long, class long, n long, fp long, {', '.join(f'{p} long' for p in PARITIES)}, wide binary, prefix array<long>")


def shared_keys(batches):
    """Rows (key, class, n, at), sorted by key and class, once each and without keys of one class."""
    names, held, met = ["key", "class", "n", "at"], None, False
    schema = pa.schema([(n, pa.int64()) for n in names])
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        rows = rows if held is None else np.concatenate([held, rows])
        if not len(rows):
            continue
        rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]
        same = rows[1:, 0] == rows[:-1, 0]
        keep = np.r_[met, same] | np.r_[same, False]
        held, met = rows[-1:], bool(keep[-1])  # the last key may go on
        yield batch_of(schema, rows[:-1][keep[:-1]].T)
    if held is not None and met:
        yield batch_of(schema, held.T)


def row_filter(of: DataFrame):
    """A broadcast filter on hashes of row numbers that all of ``of`` pass and few others; ``FILTER_BITS`` however large ``of`` is."""
    place = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    word = F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))")
    words = of.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(word.alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return of.sparkSession.sparkContext.broadcast(bits)


def likely(of: DataFrame):
    """:func:`row_filter` as a condition on column ``row``."""
    shared = row_filter(of)

    @F.pandas_udf("boolean")
    def passes(p: pd.Series) -> pd.Series:
        p = p.to_numpy()
        return pd.Series((shared.value[p >> 6] >> (p & 63)) & 1 == 1)

    return passes(F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS)))


def simhash_pairs(classes: DataFrame, folder: str) -> DataFrame:
    """(a, b): stars over the classes whose fingerprints (``fp``) reach each other by ``NEAR_BITS`` differing bits or fewer."""
    heads = written(classes.groupBy("fp").agg(F.min("class").alias("head")), folder, "heads")
    near = simhash.links(heads.select("fp"), NEAR_BITS, NEAR_BITS + 2).distinct()
    for side in ("a", "b"):
        near = near.join(heads.select(F.col("fp").alias(side), F.col("head").alias(f"of_{side}")), side)
    equal = classes.join(heads, "fp").filter(F.col("class") != F.col("head"))
    pairs = near.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).union(equal.select("head", "class"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def within_bounds(a: str, b: str, percent: int):
    """Can the pair be similar enough, if the shingle at ``at`` is the first in order that it shares?"""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))  # none is shared before it
    return (100 + percent) * most >= percent * (n + m)


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities allow the similarity; sets are sent for these only."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class").alias(side), F.struct("n", *PARITIES).alias(f"of_{side}")), side)
    return pairs.filter(parities_allow("of_a", "of_b", percent)).select("a", "b")


def finer(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose wide parities allow the similarity; 512 bits say little of sets as large as that."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"of_{side}")), side)

    @F.pandas_udf("long")
    def differ(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([wide_differ(x, y) for x, y in zip(a, b)], dtype="int64")

    allowed = (100 + percent) * differ("of_a", "of_b") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    return pairs.filter(allowed).select("a", "b")


def parities_allow(a: str, b: str, percent: int):
    """Can the pair be similar enough, as each parity that differs stands for a shingle of one set only?"""
    differ = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITIES), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def sets_of(asked: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(class, items) of the classes in ``asked`` (class, row), from one pass over the texts: only sets are shuffled."""
    place = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    passes = row_filter(asked)
    schema = pa.schema([("row", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        bits = passes.value
        for batch in batches:
            p = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[p >> 6] >> (p & 63)) & 1 == 1))
            yield batch_of(schema, (batch.column(0), [shingles(t, words).view(np.int64) for t in batch.column(1).to_pylist()]))

    found = rows.select("row", binary_text().alias("text"), place.alias("p")).mapInArrow(run, "row long, items array<long>")
    return found.join(asked, "row").select("class", "items")


def similar(pairs: DataFrame, classes: DataFrame, rows: DataFrame, folder: str, name: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, compared whole."""
    asked = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    asked = written(classes.join(asked, "class").select("class", F.col("first").alias("row")), folder, f"asked-{name}")
    sets = written(sets_of(asked, rows, words), folder, f"sets-{name}")
    left, right = sets.select(F.col("class").alias("a"), F.col("items").alias("of_a")), sets.select(F.col("class").alias("b"), F.col("items").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    met = pairs.join(left, "a").join(right, "b")
    return met.filter(100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def near_copies(rows: DataFrame, folder: str, words: int = 5, percent: int = 80, rounds: int = 2, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(row, first) of every row of ``rows`` (row, text): the least row that it reaches by pairs of ``percent`` or more."""
    spark = rows.sparkSession
    marks = written(prefixes(rows, words, percent, sample_docs), folder, "prefixes")
    classes = written(marks.groupBy("class").agg(F.min("row").alias("first"), *[F.min(c).alias(c) for c in ("n", "fp", *PARITIES, "wide")]), folder, "classes")
    keys = met_keys(marks, folder)
    marks = written(marks.select("row", "class"), folder, "marks")
    freed(spark, folder, "prefixes")
    tried = None
    labels = classes.select("class", F.col("class").alias("label")).limit(0)
    parities = classes.select("class", *PARITIES)
    sets, left = classes.count(), None
    for k in itertools.count():
        before, left = left, apart_pairs(keys, labels, folder, k) if k >= rounds else None
        last = k >= rounds and (left <= sets or before is not None and left > WORTH * before)
        if k == 0 < rounds:
            pairs = simhash_pairs(classes, folder)
        else:
            pairs = key_pairs(keys, labels, parities, folder, k, last, percent, PIVOTS if k >= rounds and not last else 1)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(finer(plausible(pairs, classes, percent), classes, percent), folder, f"pairs-{k}")
        if last:
            freed(spark, folder, "keys", "apart")
        found = written(similar(pairs, classes, rows, folder, str(k), words, percent), folder, f"links-{k}")
        freed(spark, folder, f"asked-{k}", f"sets-{k}")
        tried = pairs if tried is None else tried.union(pairs)
        labels = relabelled(labels, found, folder, k)
        if last:
            break
    grouped = classes.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = grouped.groupBy("label").agg(F.min("first").alias("least"))
    of_class = written(grouped.join(least, "label").select("class", F.col("least").alias("first")), folder, "firsts")
    return marks.join(of_class, "class").select("row", "first")


def met_keys(marks: DataFrame, folder: str) -> DataFrame:
    """(key, class, n, at): the prefixes' shingles that several classes share, found in ``PASSES`` parts of the keys."""
    exploded = marks.filter(F.col("prefix").isNotNull()).select("class", "n", F.posexplode("prefix").alias("at", "key"))
    exploded = exploded.select("key", "class", "n", F.col("at").cast("long").alias("at"))
    parts = []
    for i in range(PASSES):
        part = exploded.filter(F.pmod("key", F.lit(PASSES)) == i).repartition("key").sortWithinPartitions("key", "class")
        parts.append(written(part.mapInArrow(shared_keys, "key long, class long, n long, at long"), folder, f"keys/{i}"))
    return functools.reduce(DataFrame.union, parts)


def apart_pairs(keys: DataFrame, labels: DataFrame, folder: str, turn: int) -> float:
    """How many pairs of classes of different labels the crowded keys hold; a pair counts in each of its keys."""
    now = keys.join(labels, "class", "left").groupBy("key", F.coalesce("label", "class").alias("label")).agg(F.count("*").cast("double").alias("n"))
    held = now.groupBy("key").agg(F.sum("n").alias("held"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
    return written(held.filter(F.col("held") > CROWD).agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs")), folder, f"left-{turn}").first()[0]


def relabelled(labels: DataFrame, found: DataFrame, folder: str, turn: int) -> DataFrame:
    """(class, label): ``labels`` after the links ``found`` (a, b) between classes; a class without a label is its own."""
    of = {s: labels.select(F.col("class").alias(s), F.col("label").alias(f"of_{s}")) for s in ("a", "b")}
    edges = found.join(of["a"], "a", "left").join(of["b"], "b", "left")
    edges = edges.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moves = written(components(edges, f"{folder}/components-{turn}").select(F.col("node").alias("label"), F.col("label").alias("now")), folder, f"moves-{turn}")
    old = labels.join(moves, "label", "left").select("class", F.coalesce("now", "label").alias("label"))
    new = moves.join(labels, moves["label"] == labels["class"], "left_anti").select(F.col("label").alias("class"), F.col("now").alias("label"))
    return written(old.union(new), folder, f"labels-{turn}")


def key_pairs(keys: DataFrame, labels: DataFrame, parities: DataFrame, folder: str, turn: int, last: bool, percent: int, pivots: int = 1) -> DataFrame:
    """(a, b): the classes that meet in a key and are not linked yet; all of them in the last round, else with one of each key.

    With more ``pivots`` only crowded keys count, and their classes meet so many."""
    now = keys.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    ones = [F.min(F.struct(F.xxhash64(*[F.lit(x) for x in ((turn, i) if i else (turn,))], "class").alias("turn"), "class", "n", "at", "label")).alias(f"one{i}") for i in range(pivots)]
    apart = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), *ones, F.count("*").alias("held"))
    apart = apart.filter((F.col("low") != F.col("high")) & (F.col("held") > (CROWD if pivots > 1 else 0)))
    apart = apart.select("key", "held", F.explode(F.array_distinct(F.transform(F.array(*[f"one{i}" for i in range(pivots)]), lambda x: x.dropFields("turn")))).alias("one")).select("key", "held", "one.*")
    fits = (F.col("x.label") != F.col("y.label")) & within_bounds("x", "y", percent)
    pair = [F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")]
    if not last:
        return now.alias("x").join(apart.alias("y"), "key").filter(fits).select(*pair).distinct()
    left = written(now.join(apart.select("key", "held"), "key"), folder, "apart")
    few, many = left.filter(F.col("held") <= CROWD), left.filter(F.col("held") > CROWD).join(parities, "class")
    met = few.alias("x").join(few.alias("y"), "key").filter(F.col("x.class") < F.col("y.class"))
    crowd = many.alias("x").join(many.alias("y"), "key").filter((F.col("x.class") < F.col("y.class")) & parities_allow("x", "y", percent))
    return met.filter(fits).select(*pair).union(crowd.filter(fits).select(*pair)).distinct()
