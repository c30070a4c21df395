"""Exact substring dedup over the whole corpus with distributed suffix sorting by difference covers.

A byte goes if it is covered by a string of ``length`` bytes (a window) that also starts in a document with a smaller
doc_id. Equal windows are adjacent in the order of all suffixes, so suffixes are sorted and neighbours' prefixes compared.
The sort is dealt over the cluster by content: a window's anchor is its least 24-byte hash (leftmost among equals), so
equal windows have equal anchors, and suffixes are dealt by the hash at their anchor.

1. Documents are packed into blocks of about ``BLOCK_BYTES``; a block lists its anchors.
2. Hashes found in one document only have no partner: they are dropped before any text is sent.
3. A block sends, once each, the distinct byte strings ("snippets") that its other anchors' windows cover, with the
   smallest doc_id that holds each. A hash in over ``hot_blocks`` blocks has its windows sent one by one, dealt by
   their own hash, so a passage that a third of the corpus shares meets in many tasks, and never more than once a block.
4. A snippet that is the only one of its anchor hash shares no window with another. Each task sorts the suffixes of its
   other snippets (``dc3``), compares neighbours over ``length`` bytes and finds the smallest doc_id of each class of
   windows; a bit per window goes back to the blocks, which remove the bytes.

Defined cases: a null text is empty; texts shorter than ``length`` keep all; documents with equal doc_id don't remove
each other's bytes, nor do those with a null doc_id, which counts as the largest; an empty table gives no rows; with
``carry`` all columns come back whatever their names, ``text`` holding the bytes kept (a character cut in two is left
out).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.llm.common import batch_of, binary_text, rows_of, written
from eviflow.llm.dc3 import ranks

BLOCK_BYTES = 4 << 20
GRAM = 24
SEGMENT = 1 << 18
NO_ID = np.iinfo(np.int64).max
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * MIX[0] + b * MIX[1]
    x ^= x >> np.uint64(32)
    x *= MIX[2]
    x ^= x >> np.uint64(29)
    return x


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number."""
    n = len(text) - 7
    return np.ndarray(max(n, 0), dtype="<u8", buffer=text, strides=(1,)).copy() if n > 0 else np.zeros(0, dtype=np.uint64)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position."""
    w = words_at(text)
    n = max(len(text) - GRAM + 1, 0)
    return mixed(mixed(w[:n], w[8 : n + 8]), w[16 : n + 16])


def anchors(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window, number of windows, anchor); no run spans two documents."""
    low_bits, wide, runs = np.uint64((1 << 20) - 1), length - GRAM + 1, []
    for at in range(0, max(len(text) - length + 1, 0), SEGMENT):
        hashes = gram_hashes(text[at : at + SEGMENT + length - 1])
        # The hash's upper bits with the position below: the least value is the leftmost least hash.
        value = hashes & ~low_bits | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while 2 * span <= wide:
            value = np.minimum(value[:-span], value[span:])
            span *= 2
        if span < wide:
            value = np.minimum(value[: len(value) - (wide - span)], value[wide - span :])
        place = (value & low_bits).astype(np.int64)
        for end in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(place) + length)].tolist():
            place[max(end - length + 1 - at, 0) : end - at] = -1  # windows that leave their document
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, len(place)])
        whole = place[first] >= 0
        runs.append(np.stack([first[whole] + at, count[whole], place[first][whole] + at]))
    first, count, place = np.concatenate([np.zeros((3, 0), np.int64), *runs], axis=1)
    # A run cut by the end of a segment is made whole.
    joined = np.flatnonzero((place[1:] == place[:-1]) & (first[1:] == first[:-1] + count[:-1])) + 1
    count[joined - 1] += count[joined]
    keep = np.ones(len(first), dtype=bool)
    keep[joined] = False
    return first[keep], count[keep], place[keep]


def packed_blocks(docs: DataFrame, length: int, carry: bool) -> DataFrame:
    """Documents in blocks: ids, text lengths, text, other columns, and the runs of windows with their anchors."""
    columns = [F.col("doc_id").cast("long").alias("id"), binary_text().alias("octets")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("other"))
    schema = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("ids", "sizes", "octets", "other", "first", "count", "place")]])

    def block(ids, texts, others):
        text = b"".join(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        first, count, place = anchors(np.frombuffer(text, dtype=np.uint8), np.cumsum(sizes), length)
        sink = pa.BufferOutputStream()
        if others:
            table = pa.Table.from_batches(others)
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
        kept = [np.array([NO_ID if i is None else i for i in ids], dtype=np.int64), sizes]
        runs = [np.diff(first, prepend=0).astype("<u4"), count.astype("<u4"), (place - first).astype("<u4")]
        return (
            int(np.frombuffer(uuid.uuid4().bytes[:8], dtype=np.int64)[0]),
            *[_zip(x.tobytes()) for x in kept], _zip(text), _zip(sink.getvalue().to_pybytes()) if others else b"", *[_zip(x.tobytes()) for x in runs],
        )

    def run(batches: Iterator[pa.RecordBatch]):
        ids, texts, others, held = [], [], [], 0
        for batch in batches:
            begun = 0
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids.append(doc_id)
                texts.append(text or b"")
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    if carry:
                        others.append(pa.RecordBatch.from_arrays([batch.column(2).slice(begun, k + 1 - begun)], names=["other"]))
                    yield batch_of(schema, [[x] for x in block(ids, texts, others)])
                    ids, texts, others, held, begun = [], [], [], 0, k + 1
            if carry and begun < batch.num_rows:
                others.append(pa.RecordBatch.from_arrays([batch.column(2).slice(begun)], names=["other"]))
        if ids:
            yield batch_of(schema, [[x] for x in block(ids, texts, others)])

    return docs.select(*columns).mapInArrow(run, "block long, ids binary, sizes binary, octets binary, other binary, first binary, count binary, place binary")


class Block:
    """One block's arrays."""

    def __init__(self, ids, sizes, octets, first, count, place):
        self.ids = np.frombuffer(_unzip(ids), dtype=np.int64)
        self.sizes = np.frombuffer(_unzip(sizes), dtype=np.int64)
        self.octets = _unzip(octets)
        self.text = np.frombuffer(self.octets, dtype=np.uint8)
        self.first = np.cumsum(np.frombuffer(_unzip(first), dtype="<u4"), dtype=np.int64)
        self.count = np.frombuffer(_unzip(count), dtype="<u4").astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        place = self.first + np.frombuffer(_unzip(place), dtype="<u4")
        words = np.ndarray(max(len(self.text) - 7, 1), dtype="<u8", buffer=self.octets + b"\0" * 8, strides=(1,))
        # Anchors are small hashes: mixed once more, they spread evenly over the parts.
        gram = mixed(mixed(words[place], words[place + 8]), words[place + 16]) if len(place) else np.zeros(0, np.uint64)
        self.hash = mixed(gram, gram)
        self.doc = self.ids[np.searchsorted(self.ends, self.first, "right")]

    def local(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes in order, whether each is in several documents here, and each run's place among them."""
        order = np.lexsort((self.doc, self.hash))
        h, d = self.hash[order], self.doc[order]
        new = np.r_[True, h[1:] != h[:-1]][: len(h)]
        which = np.empty(len(h), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        several = d[firsts] != d[np.r_[firsts[1:], len(h)] - 1] if len(h) else np.zeros(0, bool)
        return h[firsts], several, which


RUNS = ("ids", "sizes", "octets", "first", "count", "place")


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash, by its upper half: rising with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def hash_rows(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, hashes): each block's distinct anchor hashes by part, their lower halves (a chance agreement only
    makes a candidate more)."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for batch in batches:
            for block, *arrays in rows_of(batch):
                distinct = Block(*arrays).local()[0]
                part = part_of(distinct, parts)
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
                own = [distinct[a:b].astype("<u4").tobytes() for a, b in zip(cut, np.r_[cut[1:], len(part)], strict=True)]
                yield batch_of(schema, (part[cut], np.full(len(cut), block), own))

    return blocks.select("block", *RUNS).mapInArrow(run, "part long, block long, hashes binary")


def shared_hashes(rows: DataFrame, hot_blocks: int) -> DataFrame:
    """(block, part, codes): per distinct hash a byte, 0 in this block only, 1 in several, 2 in over ``hot_blocks``."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("codes", pa.binary())])

    def finish(part, blocks, values):
        lengths = [len(v) // 4 for v in values]
        all_ = np.frombuffer(b"".join(values), dtype="<u4")
        ordered = np.sort(all_)
        n = np.searchsorted(ordered, all_, "right") - np.searchsorted(ordered, all_, "left")
        codes = (n > 1).astype(np.uint8) + (n > hot_blocks)
        cuts = np.cumsum([0, *lengths])
        return batch_of(schema, (blocks, [part] * len(blocks), [_zip(codes[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]))

    def run(batches):
        now, blocks, values = None, [], []
        for batch in batches:
            for part, block, value in rows_of(batch):
                if part != now and blocks:
                    yield finish(now, blocks, values)
                    blocks, values = [], []
                now = part
                blocks.append(block)
                values.append(value)
        if blocks:
            yield finish(now, blocks, values)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "block long, part long, codes binary")


def snippets(joined: DataFrame, length: int, parts: int) -> DataFrame:
    """Per block: ``found`` (runs or windows that may repeat: first window, number of windows, snippet, in its smallest
    document) and ``sent``, its distinct snippets by part with the smallest doc_id of each."""
    sent = pa.struct([("part", pa.int64()), ("sizes", pa.binary()), ("octets", pa.binary()), ("docs", pa.binary()), ("keys", pa.binary())])
    schema = pa.schema([("block", pa.int64()), ("found", pa.binary()), ("sent", pa.list_(sent))])

    def one(block, codes, arrays):
        b = Block(*arrays)
        _, several, which = b.local()
        flag = np.frombuffer(b"".join(_unzip(c["codes"]) for c in sorted(codes or [], key=lambda c: c["part"])), dtype=np.uint8)
        code = np.maximum(flag, several)[which] if len(which) else np.zeros(0, np.uint8)
        at = np.flatnonzero(code == 1)
        first, count, hashes, doc = b.first[at], b.count[at], b.hash[at], b.doc[at]
        hot = np.flatnonzero(code == 2)
        if len(hot):
            n = b.count[hot]
            windows = np.repeat(b.first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            words = words_at(b.text)
            mix = mixed(words[windows], words[windows + length - 8])
            for k in range(8, length - 8, 8):
                mix = mixed(mix, words[windows + k])
            first, count = np.r_[first, windows], np.r_[count, np.ones(len(windows), np.int64)]
            hashes, doc = np.r_[hashes, mix], np.r_[doc, np.repeat(b.doc[hot], n)]
        octets, number = b.octets, {}
        texts = [octets[a : a + c] for a, c in zip(first.tolist(), (count + length - 1).tolist(), strict=True)]
        entry = np.array([number.setdefault(t, len(number)) for t in texts], dtype=np.int64)
        least = np.full(len(number), NO_ID)
        np.minimum.at(least, entry, doc)
        key = np.zeros(len(number), dtype=np.uint64)
        key[entry] = hashes
        where = part_of(key, parts)
        order = np.argsort(where, kind="stable")  # snippets are sent, and answered, in the order of their parts
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        distinct = list(number)
        distinct = [distinct[i] for i in order.tolist()]
        where, least_sent, key = where[order], least[order], key[order].astype("<u4")
        cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1]][: len(where)]).tolist()
        out = [
            {"part": int(where[x]), "sizes": _zip(np.array([len(t) for t in distinct[x:y]], dtype="<u4").tobytes()), "octets": _zip(b"".join(distinct[x:y])), "docs": _zip(least_sent[x:y].tobytes()), "keys": key[x:y].tobytes()}
            for x, y in zip(cut, [*cut[1:], len(distinct)][: len(cut)], strict=True)
        ]
        found = _zip(np.stack([first, count, back[entry] if len(entry) else entry, doc == least[entry] if len(entry) else entry]).astype("<i4").tobytes())
        return block, found, out

    def run(batches):
        for batch in batches:
            for block, *arrays, codes in rows_of(batch):
                yield batch_of(schema, [[x] for x in one(block, codes, arrays)])

    picked = joined.select("block", *RUNS, "codes")
    return picked.mapInArrow(run, "block long, found binary, sent array<struct<part:long,sizes:binary,octets:binary,docs:binary,keys:binary>>")


def class_bits(sizes: np.ndarray, octets: bytes, docs: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """Per window of each snippet in turn: does its string also start in a document smaller than the snippet's own?

    ``keys``: equal for snippets that can share a window.
    """
    ends = np.cumsum(sizes)
    cuts = np.r_[0, ends].tolist()
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(octets[a:b], len(number)) for a, b in zip(cuts, cuts[1:], strict=False)], dtype=np.int64)
    least = np.full(len(number), NO_ID)
    np.minimum.at(least, which, docs)
    n = np.array([len(t) for t in number], dtype=np.int64) - length + 1
    begin = np.cumsum(n) - n
    of = np.repeat(least, n)
    key = np.zeros(len(number), dtype=np.uint32)
    key[which] = keys
    _, group, members = np.unique(key, return_inverse=True, return_counts=True)
    several = members[group] > 1
    at = np.flatnonzero(several[np.repeat(np.arange(len(n)), n)])  # windows whose class is to be found
    if len(at):
        of[at] = _least_of_classes(b"".join([t for t, m in zip(number, several.tolist(), strict=True) if m]), n[several], least[several], length)
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(sizes)), counts)
    at = begin[which][row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    return of[at] < docs[row]


def _least_of_classes(octets: bytes, n: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """Per window of snippets with ``n`` windows each: the smallest doc_id that holds its string."""
    starts = np.cumsum(n + length - 1) - (n + length - 1)
    owner = np.repeat(np.arange(len(n)), n)
    window = starts[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    text = np.frombuffer(octets, dtype=np.uint8)
    order = np.argsort(ranks(text.astype(np.int64) + 1, length)[window], kind="stable")
    # Neighbours in suffix order: the same string if their first ``length`` bytes agree.
    words = words_at(text)
    a = window[order]
    differ = np.zeros(max(len(a) - 1, 0), dtype=bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        w = words[a + k]
        differ |= w[1:] != w[:-1]
    new = np.flatnonzero(np.r_[True, differ])
    smallest = np.minimum.reduceat(least[owner[order]], new)
    of = np.empty(len(a), dtype=np.int64)
    of[order] = np.repeat(smallest, np.diff(np.r_[new, len(a)]))
    return of


def answers(sent: DataFrame, length: int) -> DataFrame:
    """(block, part, n, bits): per window of the snippets that the block sent to the part, one bit; ``n`` windows."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])

    def finish(part, held):
        sizes = [np.frombuffer(_unzip(s), dtype="<u4").astype(np.int64) for _, s, _, _, _ in held]
        docs = np.concatenate([np.frombuffer(_unzip(d), dtype=np.int64) for _, _, _, d, _ in held])
        keys = np.concatenate([np.frombuffer(k, dtype="<u4") for _, _, _, _, k in held])
        bits = class_bits(np.concatenate(sizes), b"".join(_unzip(o) for _, _, o, _, _ in held), docs, keys, length)
        cuts = np.cumsum([0, *[int((s - length + 1).sum()) for s in sizes]])
        own = [_zip(np.packbits(bits[a:b]).tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
        return batch_of(schema, ([h[0] for h in held], [part] * len(held), np.diff(cuts), own))

    def run(batches):
        now, held = None, []
        for batch in batches:
            for block, part, *arrays in rows_of(batch):
                if part != now and held:
                    yield finish(now, held)
                    held = []
                now = part
                held.append((block, *arrays))
        if held:
            yield finish(now, held)

    rows = sent.select("block", F.explode("sent").alias("s")).select("block", "s.part", "s.sizes", "s.octets", "s.docs", "s.keys")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "block long, part long, n long, bits binary")


def removed(joined: DataFrame, length: int, other_type: str | None) -> DataFrame:
    """Documents with the bytes left of them."""
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]

    def one(arrays, found, bits):
        b = Block(*arrays)
        first, count, entry, own = np.frombuffer(_unzip(found), dtype="<i4").reshape(4, -1).astype(np.int64) if found else np.zeros((4, 0), np.int64)
        sizes = np.zeros(int(entry.max(initial=-1)) + 1, dtype=np.int64)
        sizes[entry] = count
        flags, ends = [], np.cumsum(sizes)  # each part's bits were packed on their own
        for item in sorted(bits or [], key=lambda x: x["part"]):
            flags.append(np.unpackbits(np.frombuffer(_unzip(item["bits"]), dtype=np.uint8))[: item["n"]])
        flat = np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)
        begin = ends - sizes
        row = np.repeat(np.arange(len(first)), count)
        inside = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        gone = (own[row] == 0) | flat[begin[entry[row]] + inside]
        starts = first[row][gone] + inside[gone]
        step = np.zeros(len(b.text) + 1, dtype=np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + length, -1)
        mask = np.cumsum(step[:-1]) > 0
        begins = b.ends - b.sizes
        edge = mask.copy()
        edge[1:] &= ~mask[:-1]
        edge[begins[b.sizes > 0]] = mask[begins[b.sizes > 0]]
        n_removed = np.r_[0, np.cumsum(mask)]
        n_spans = np.r_[0, np.cumsum(edge)]
        kept = b.text[~mask].tobytes()
        kept_ends = b.ends - n_removed[b.ends]
        kept_begins = begins - n_removed[begins]
        return b, n_removed[b.ends] - n_removed[begins], n_spans[b.ends] - n_spans[begins], [kept[x:y] for x, y in zip(kept_begins.tolist(), kept_ends.tolist(), strict=True)]

    def run(batches):
        for batch in batches:
            for _, *arrays, other, found, bits in rows_of(batch):
                b, n, spans, kept = one(arrays, found, bits)
                ids = [None if i == NO_ID else i for i in b.ids.tolist()]
                out = [pa.array(ids, pa.int64()), pa.array(b.sizes), pa.array(n), pa.array(spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                if not other_type:
                    yield pa.RecordBatch.from_arrays(out, schema=pa.schema(fields))
                    continue
                others = pa.ipc.open_stream(_unzip(other)).read_all().column("other").combine_chunks()
                texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
                yield pa.RecordBatch.from_arrays([*out, texts, others], names=[*[f for f, _ in fields], "kept", "other"])

    picked = joined.select("block", *RUNS, "other", "found", "bits")
    return picked.mapInArrow(run, columns + (f", kept string, other {other_type}" if other_type else ""))


def dedup(docs: DataFrame, folder: str, length: int = 50, carry: bool = False, part_bytes: int = 1 << 20, hot_blocks: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with ``carry`` the documents' own columns instead."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"suffix_{uuid.uuid4().hex}"
    # Bucketed by block, so that what is sent back to the blocks meets them without moving their text again.
    packed_blocks(docs, length, carry).write.bucketBy(shuffles, "block").option("path", f"{folder}/blocks").saveAsTable(name)
    blocks = spark.table(name)
    total = blocks.agg(F.sum(F.octet_length("octets"))).first()[0] or 0
    parts = max(shuffles, -(-total // part_bytes))
    codes = written(shared_hashes(hash_rows(blocks, parts), hot_blocks), folder, "codes")
    of_block = codes.groupBy("block").agg(F.collect_list(F.struct("part", "codes")).alias("codes"))  # bytes of one block's anchors
    plan = written(snippets(blocks.join(of_block, "block", "left"), length, parts), folder, "snippets")
    bits = written(answers(plan.select("block", "sent"), length), folder, "bits")
    back = bits.groupBy("block").agg(F.collect_list(F.struct("part", "n", "bits")).alias("bits"))
    joined = blocks.join(plan.select("block", "found"), "block", "left").join(back, "block", "left")
    other = None
    if carry:
        other = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("other")).schema["other"].dataType.simpleString()
    found = removed(joined, length, other)
    spark.sql(f"DROP TABLE {name}")  # the catalogue's entry; the files stay for the result
    if not carry:
        return found
    return found.select(*[F.col("kept").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col("other")[c].alias(c) for c in docs.columns])
