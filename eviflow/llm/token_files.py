"""Token ids as files: ids ranked by frequency, byte-aligned codes of one to four bytes, control bytes apart.

A file is a Parquet container whose rows are blocks of consecutive documents. ``control`` holds two bits per id (its
code length less one, four ids a byte, first id in the lowest bits), ``data`` the little-endian codes one after the
other. A code is the id's rank by falling frequency over the whole corpus, so that frequent ids take one byte; the rank
table is stored beside the blocks. Blocks are in ascending doc_id order over all files (``part``, ``seq``).

Defined cases: a null or empty text is a document with the end id alone; null doc_ids come first; rows with equal
doc_id are documents of their own, in the order of their ids; an empty table gives no blocks. Other columns of the
documents are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eviflow.llm.common import batch_of, binary_text, rows_of, written

BLOCK_IDS = 1 << 18
CACHED = 1_000_000
GROUP_CHARS = 1 << 20
#: Units on which the tokenizer's steps are these only (fixed values of its pattern): no normal form changes printable
#: ASCII and these letters, lower-casing is per character, and the cut is at the ends of letter runs, digits and others.
PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-ſ]*")
TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
#: The file's own steps that the two patterns above stand for (fixed values of the tokenizer).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The byte-level spelling: printable Latin-1 stands for itself, the rest follows from U+0100 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)
BLOCKS = "part int, seq int, n_ids long, doc_ids binary, null_ids binary, lengths binary, control binary, data binary"
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros((len(values) + 3) // 4 * 4, dtype=np.uint8)
    four[: len(values)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    octets = values.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), octets[np.arange(4, dtype=np.uint8) <= code[:, None]].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Inverse of :func:`encode_values`: code lengths by table, then one masked load per value."""
    code = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    start = np.cumsum(code, dtype=np.int64) + np.arange(n)  # ends less one of each code
    start -= code
    loads = np.ndarray(max(len(data), 1), dtype="<u4", buffer=data + b"\0\0\0\0", strides=(1,))
    return loads[start] & MASKS[code] if n else np.zeros(0, dtype=np.uint32)


def cut_as_here(path: str) -> bool:
    """Are the file's steps before its model those that ``PLAIN`` and ``TOKENS`` stand for?"""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != NORMALIZERS or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return False
    replaced = steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    split = cuts[0]["pattern"] == {"Regex": SPLIT} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    spelled = not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    return replaced and split and spelled and all(t["content"].startswith("<|") for t in spec["added_tokens"])


class Encoder:
    """Ids of texts by the tokenizers library, each distinct part of a text encoded once.

    A file with other steps before its model than :func:`cut_as_here` knows is left to the library, text by text.

    The tokenizer drops white space and joins nothing across it, so texts are cut at blanks and line ends; plain units
    are cut further where the tokenizer's own pattern cuts them. Both caches are emptied when they are full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts = cut_as_here(path)
        self.dtype = id_type(path)
        self.code = "H" if self.dtype == "<u2" else "I"
        self.units: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def of_token(self, token: str) -> bytes:
        """Ids of one token of the plain cut, by the tokenizer's own model over its spelling of bytes."""
        spelled = token if token.isascii() else token.encode().decode("latin-1").translate(SPELLED)
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def learn(self, units: set[str]) -> None:
        """Encode new units; any but plain ones take all steps of the library."""
        tokens = self.tokens
        for unit in units:
            if PLAIN.fullmatch(unit) and "<|" not in unit:
                own = []
                for token in TOKENS.findall(unit.lower()):
                    if (ids := tokens.get(token)) is None:
                        if len(tokens) >= CACHED:
                            tokens.clear()
                        ids = self.of_token(token)
                        if len(token) <= 64:
                            tokens[token] = ids
                    own.append(ids)
                self.units[unit] = b"".join(own)
            else:
                self.units[unit] = np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; a few texts are cut at a time, so that their new units are learned together."""
        if not self.parts:
            for text in texts:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
            return
        group, held = [], 0
        for text in [*texts, None]:
            if text is not None:
                group.append(text.replace("\n", " ").split(" "))
                held += len(text)
                if held < GROUP_CHARS:
                    continue
            seen = set().union(*group)
            new = {unit for unit in seen if unit not in self.units}
            if len(self.units) + len(new) > CACHED:
                self.units.clear()
                new = seen
            self.learn(new)
            known = self.units.__getitem__
            yield from (b"".join(map(known, units)) for units in group)
            group, held = [], 0


_encoders: dict[str, Encoder] = {}


def id_type(path: str) -> str:
    """Two bytes for ids of a vocabulary that they can hold, else four."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() < 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """(doc_id, ids) of every document, ids as little-endian unsigned integers of :func:`id_type` with the end id last."""

    def run(batches):
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))  # kept by a worker from task to task
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            texts = [text.decode("utf-8", "replace") if text else "" for text in batch.column(1).to_pylist()]
            yield batch_of(IDS, (batch.column(0), [ids + end for ids in encoder.encode(texts)]))

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids binary")


def ranks(ids: DataFrame, dtype: str) -> DataFrame:
    """(id, n, rank) of every id used: rank 0 is the most frequent, ties go to the smaller id. At most a vocabulary."""

    def counts(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            more = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=dtype), minlength=len(total))
            more[: len(total)] += total
            total = more
        used = np.flatnonzero(total)
        yield batch_of(pa.schema([("id", pa.int64()), ("n", pa.int64())]), (used, total[used]))

    summed = ids.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return summed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1)


def blocks(ids: DataFrame, dtype: str, rank_of: dict[int, int], parts: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Rows of (doc_id, ids) to coded blocks in ascending doc_id order; ``rank_of`` is one entry per vocabulary id."""
    table = np.zeros(max(rank_of, default=0) + 1, dtype=np.uint32)
    table[list(rank_of)] = list(rank_of.values())
    width = np.dtype(dtype).itemsize

    def block(part, seq, docs, values):
        lengths = np.array([len(v) // width for v in values], dtype="<i8")
        control, data = encode_values(table[np.frombuffer(b"".join(values), dtype=dtype)])
        nulls = np.array([d is None for d in docs], dtype=np.uint8)
        numbers = np.array([d or 0 for d in docs], dtype="<i8")
        return part, seq, int(lengths.sum()), numbers.tobytes(), nulls.tobytes(), lengths.tobytes(), control, data

    def code(batches):
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "null_ids", "lengths", "control", "data")]])
        seq, docs, values, held, part = 0, [], [], 0, 0
        for batch in batches:
            done = []
            for part, doc_id, value in rows_of(batch):
                docs.append(doc_id)
                values.append(value)
                held += len(value) // width
                if held >= block_ids:
                    done.append(block(part, seq, docs, values))
                    seq, docs, values, held = seq + 1, [], [], 0
            if done:
                yield batch_of(schema, zip(*done, strict=True))
        if docs:
            yield batch_of(schema, zip(block(part, seq, docs, values), strict=True))

    # Two documents of one doc_id may lie on either side of a cut, never out of order.
    ordered = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    return ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(code, BLOCKS)


def with_starts(files: DataFrame) -> DataFrame:
    """Blocks with ``start``: the number of ids in all blocks before. Sums per part first, so no window spans all blocks."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = F.coalesce(F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = files.select("part", "seq", "n_ids")
    starts = sizes.select("part", "seq", own.alias("own")).join(parts.select("part", before.alias("before")), "part")
    return files.join(starts.select("part", "seq", (F.col("own") + F.col("before")).alias("start")), ["part", "seq"])


def decoded(files: DataFrame, id_of: dict[int, int], digest: bool = False) -> DataFrame:
    """Documents read back from blocks with ``start``: doc_id, start, n_tokens and their ids, or the crc32 of the ids."""
    table = np.zeros(max(id_of, default=0) + 1, dtype="<u4")
    table[list(id_of)] = list(id_of.values())
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def read(batches):
        for batch in batches:
            for first, n, doc_ids, nulls, lengths, control, data in rows_of(batch):
                octets = memoryview(table[decode_values(control, data, n)].tobytes())
                lengths = np.frombuffer(lengths, dtype="<i8")
                ends = np.cumsum(lengths)
                cuts = [octets[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                ids = np.frombuffer(doc_ids, dtype="<i8").tolist()
                ids = [None if z else d for d, z in zip(ids, nulls, strict=True)]
                yield batch_of(schema, (ids, first + ends - lengths, lengths, [zlib.crc32(c) for c in cuts] if digest else [bytes(c) for c in cuts]))

    picked = files.select("start", "n_ids", "doc_ids", "null_ids", "lengths", "control", "data")
    return picked.mapInArrow(read, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def write_and_read(docs: DataFrame, path: str, folder: str, end_id: int = 1, digest: bool = False) -> DataFrame:
    """Encode ``docs``, write the rank table and the files under ``folder``, and return the documents read from them."""
    spark = docs.sparkSession
    ids = written(encoded(docs, path, end_id), folder, "ids")
    dtype = id_type(path)
    table = written(ranks(ids, dtype), folder, "ranks")
    pairs = [(r["id"], r["rank"]) for r in table.select("id", "rank").collect()]  # at most one row per vocabulary entry
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = written(blocks(ids, dtype, dict(pairs), parts), folder, "blocks")
    return decoded(with_starts(files), {rank: i for i, rank in pairs}, digest)
