"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Each document is reduced to ``STATISTICS`` numbers. Their random Fourier features approximate a Gaussian kernel; the
ridge solution needs only the sums of outer products, which every partition gives for its own rows. Raw scores of rows
kept apart from the ridge fit are binned, and pooled adjacent violators make a rising step curve of label rates, which
is the score. Statistics and predictions are over all documents and whole texts; learning takes at most ``fit_rows``
labelled rows by hash order, a parameter of the classifier.

Defined cases: null and empty texts have all-zero statistics and get a score; null labels and null doc_ids teach
nothing; a document labelled twice teaches twice; without a learned row every score is 0.5; repeated rows are scored
alike; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.llm.common import batch_of, binary_text, rows_of, written
from eviflow.llm.language import remainder

BYTE_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"", b"!", b"#*$%&", b"|<>", b"=_/\\@+~^", b" \t\x0b\f\r", b"\n", bytes(range(128, 256))]
STATISTICS = len(BYTE_CLASSES) + 11
SUM_ROWS = 8


def _classes() -> np.ndarray:
    table = np.zeros((256, len(BYTE_CLASSES)))
    for k, members in enumerate(BYTE_CLASSES):
        table[list(members), k] = 1
    return table


def statistics(text: bytes | None, classes: np.ndarray) -> np.ndarray:
    """The numbers that stand for one text."""
    out = np.zeros(STATISTICS)
    words = text.split() if text else []
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n, n_bytes = len(words), len(text)
    out[: len(BYTE_CLASSES)] = counts @ classes / n_bytes
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    share = counts[counts > 0] / n_bytes
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    capital = sum(map(bytes.isupper, words))
    out[len(BYTE_CLASSES) :] = (
        np.log1p(n) / 10, lengths.mean() / 10, min(lengths.std(), 20) / 10, min(lengths.max(), 200) / 50,
        len(set(words)) / n, len(pairs) / max(n - 1, 1), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 5,
        -(share * np.log2(share)).sum() / 5, capital / n, sum(map(bytes.isalpha, words)) / n,
    )
    return out


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, f array<double>) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.list_(pa.float64()))])

    def run(batches):
        classes = _classes()
        for batch in batches:
            found = [statistics(t, classes) for t in batch.column(1).to_pylist()]
            yield batch_of(schema, (batch.column(0), found))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("text")).mapInArrow(run, "doc_id long, f array<double>")


def matrix(column: pa.Array, width: int = STATISTICS) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # raw scores, rising
    rate: np.ndarray  # calibrated rate at each of them

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[np.sqrt(2 / len(self.phase)) * np.cos(z @ self.directions + self.phase), np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.rate) if len(self.at) else np.full(len(x), 0.5)


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Rising rates closest to ones / n at points in rising order (pooled adjacent violators)."""
    blocks: list[list[float]] = []
    for k in range(len(at)):
        blocks.append([ones[k], n[k], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.concatenate([np.zeros(0), *[np.full(int(k), o / m) for o, m, k in blocks]])


def fit(described_docs: DataFrame, labels: DataFrame, folder: str, fit_rows: int = 60_000, width: int = 300, bandwidth: float = 3.0, ridge: float = 1e-3, bins: int = 400, seed: int = 5) -> Model:
    """Model of labelled rows (doc_id, quality)."""
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("double").alias("y")).filter("labelled is not null and y is not null")
    share = min(1.0, fit_rows / max(known.count(), 1))
    place = F.pmod(F.xxhash64(F.lit(seed), "labelled"), F.lit(1 << 20))
    sample = known.filter(place < F.lit(int(share * (1 << 20)) + 1))
    rows = described_docs.join(sample, F.col("doc_id") == F.col("labelled")).select("f", "y", (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(4)) == 0).alias("apart"))
    rows = written(rows, folder, "labelled")
    sums = rows.select(F.count("*"), *[F.avg(F.col("f")[k]) for k in range(STATISTICS)], *[F.stddev_pop(F.col("f")[k]) for k in range(STATISTICS)]).first()
    draw = np.random.default_rng(seed)
    n = sums[0]
    empty = np.zeros(0)
    mean, spread = np.array(sums[1 : STATISTICS + 1], dtype=float), np.array(sums[STATISTICS + 1 :], dtype=float)
    model = Model(np.nan_to_num(mean), np.where(np.nan_to_num(spread) > 1e-9, spread, 1.0), draw.normal(size=(STATISTICS, width)) / bandwidth, draw.uniform(0, 2 * np.pi, width), np.zeros(width + 1), empty, empty)
    if not n:
        return model
    size = width + 1
    schema = pa.schema([("sums", pa.binary())])

    def outer(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(matrix(batch.column(0)))
                total += np.c_[z.T @ z, z.T @ batch.column(1).to_numpy()]
        yield batch_of(schema, ([total.tobytes()],))

    def added(batches):
        total = np.zeros(size * (size + 1))
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += np.frombuffer(value)
        yield batch_of(schema, ([total.tobytes()],))

    # One fixed-size row of sums per partition, added up in a few tasks.
    partial = rows.filter(~F.col("apart")).select("f", "y").mapInArrow(outer, "sums binary").repartition(SUM_ROWS).mapInArrow(added, "sums binary").collect()
    total = sum(np.frombuffer(r["sums"]) for r in partial).reshape(size, size + 1)
    model.weights = np.linalg.solve(total[:, :size] + ridge * max(total[-1, size - 1], 1) * np.eye(size), total[:, size])

    pairs = pa.schema([("raw", pa.float64()), ("y", pa.float64())])

    def scored(batches):
        for batch in batches:
            yield batch_of(pairs, (model.raw(matrix(batch.column(0))), batch.column(1)))

    raw = rows.filter("apart").select("f", "y").mapInArrow(scored, "raw double, y double")
    bin_ = F.round((F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0))) * bins / 3).cast("int")
    curve = raw.groupBy(bin_.alias("bin")).agg(F.avg("raw").alias("at"), F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()  # at most bins + 1 rows
    if curve:
        at, n, ones = (np.array([r[c] for r in curve], dtype=float) for c in ("at", "n", "ones"))
        model.at, model.rate = at, (isotonic(at, n, ones) * n.sum() + 0.5) / (n.sum() + 1)
    return model


def scores(described_docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of described documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            yield batch_of(schema, (batch.column(0), model.score(matrix(batch.column(1)))))

    return described_docs.select("doc_id", "f").mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame, folder: str, folds: int = 5, held: int = 0, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of rows whose crc32(doc_id) mod ``folds`` is ``held`` are not learned."""
    features = written(described(docs), folder, "described")
    model = fit(features, labels.filter(remainder(F.col("doc_id"), folds) != held), folder, **options)
    found = scores(features, model)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
