"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is compiled from the model's pieces. Reading a normalised text it moves over characters; each piece that
spells the next characters is an arc that writes its id, and each character without a piece has an arc that writes its
UTF-8 bytes. Composed with one input it is a lattice over text positions. Weights are tropical (a path adds them, the
least path wins):

- ``kind="bpe"``: a state also keeps the last piece. An arc weighs nothing if merging the two pieces' joint text by
  rank gives back just these two pieces, else infinity. A sequence of which all neighbours agree in that sense is the
  one merging the whole text gives, so exactly one path is finite.
- ``kind="unigram"``: an arc weighs its piece's negated score.

The normaliser (blanks to U+2581, one put in front) is part of the composition. No piece has a blank after another
character, which is checked when compiling, so texts are composed word by word and each distinct word once per cache.

Defined cases: a null or empty text has no ids; a text is decoded to itself whatever it holds; repeated rows are
encoded alike; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.llm.common import batch_of, binary_text, rows_of

BLANK = "▁"
WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
CACHED = 250_000
ONE = (1,)
BYTE_WEIGHT = 1e6  # above any path of pieces over one character


def lengths_by_start(pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
    """The lengths that a piece can have, longest first, by the next three characters, or two where no longer piece starts so."""
    found: dict[str, set[int]] = {}
    for piece in pieces:
        if len(piece) > 1:
            found.setdefault(piece[:3], {1}).add(len(piece))
    for start, lengths in found.items():
        if len(start) == 3 and 2 in found.get(start[:2], ()):
            lengths.add(2)
    return {start: tuple(sorted(lengths, reverse=True)) for start, lengths in found.items()}


class Transducer:
    """Pieces, byte arcs and arc weights of one model file."""

    def __init__(self, path: str, kind: str = "bpe"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.kind, self.unknown = kind, model.unk_id()
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.octet = {i: bytes([b]) for b, i in self.bytes.items()}
        self.score = {i: model.get_score(i) for i in range(n)}
        self.ids = {p: i for i, p in enumerate(names) if not special[i] and i not in self.octet}
        self.text = {i: p for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.sizes = lengths_by_start(self.ids)
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.agree: dict[tuple[int | None, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the words known before; those met again move to ``known``
        self.spelled = [self.octet[i] if i in self.octet else self.text.get(i, "").encode() for i in range(n)]

    def normalised(self, text: str) -> str:
        return BLANK + text.replace(" ", BLANK) if text else ""

    def merged(self, text: str) -> list[str]:
        """Symbols left when the best-scored neighbours are merged until none is a piece; the leftmost first among equals."""
        symbols, after = list(text), list(range(1, len(text) + 1))
        before, alive = list(range(-1, len(text) - 1)), [True] * len(text)
        heap = []

        def offer(i):
            j = after[i]
            if j < len(symbols) and (p := self.ids.get(symbols[i] + symbols[j])) is not None:
                heap.append((-self.score[p], i, symbols[i], symbols[j])) if not started else heappush(heap, (-self.score[p], i, symbols[i], symbols[j]))

        started = False
        for i in range(len(symbols)):
            offer(i)
        heapify(heap)
        started = True
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if not alive[i] or symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, live in zip(symbols, alive, strict=True) if live]

    def weight(self, last: int | None, piece: int) -> float:
        """Weight of the arc that writes ``piece`` after ``last`` (None: a start, or a character without a piece)."""
        if self.kind == "unigram":
            return -self.score[piece]
        pair = (last, piece)
        if (ok := self.agree.get(pair)) is None:
            a, b = "" if last is None else self.text[last], self.text[piece]
            ok = self.agree[pair] = self.merged(a + b) == ([a, b] if a else [b])
        return 0.0 if ok else inf

    def finite(self, text: str) -> tuple[int, ...]:
        """Ids on the one path of ``text`` without an infinite arc: depth first, long pieces first, dead states kept."""
        n, ids, sizes, agree = len(text), self.ids, self.sizes, self.agree
        path: list[tuple[int, int | None, int]] = []  # position, piece before it, length of the arc taken
        at, last, below, dead = 0, None, n + 1, set()  # arcs of a length below that are left to try
        while at < n:
            taken = None
            for size in sizes.get(text[at : at + 3]) or sizes.get(text[at : at + 2]) or ONE:
                if size >= below:
                    continue
                piece = ids.get(text[at : at + size])
                if piece is not None:
                    if (ok := agree.get((last, piece))) is None:
                        ok = self.weight(last, piece) == 0
                    if ok and not (dead and (at + size, piece) in dead):
                        taken = piece
                        break
            if taken is None and text[at] not in ids and (at + 1, None) not in dead:
                size, fallback = 1, True
            elif taken is None:
                dead.add((at, last))
                at, last, below = path.pop()
                continue
            else:
                fallback = False
            path.append((at, last, size))
            at, last = at + size, None if fallback else taken
            below = n - at + 1
        out: list[int] = [before for _, before, _ in path[1:]]
        out.append(last)
        if None not in out:
            return tuple(out)
        out = []
        for k, (at, _, size) in enumerate(path):
            piece = path[k + 1][1] if k + 1 < len(path) else last
            out.extend([self.bytes.get(b, self.unknown) for b in text[at : at + size].encode()] if piece is None else [piece])
        return tuple(out)

    def shortest(self, text: str) -> tuple[int, ...]:
        """Ids on the least path through the lattice of ``text`` (already normalised)."""
        if self.kind == "bpe":  # all finite paths weigh nothing
            return self.finite(text)
        n = len(text)
        best: list[tuple[float, int, int | None]] = [(inf, 0, None)] * (n + 1)  # weight, position before, piece
        best[0] = (0.0, 0, None)
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = self.ids.get(text[i:j])
                total = best[i][0] + (BYTE_WEIGHT if piece is None else self.weight(None, piece))
                if (piece is not None or j == i + 1) and total < best[j][0]:
                    best[j] = (total, i, piece)
        out, at = [], n
        while at:
            _, start, piece = best[at]
            out.extend(reversed([self.bytes.get(b, self.unknown) for b in text[start:at].encode()]) if piece is None else [piece])
            at = start
        return tuple(reversed(out))

    def encode(self, text: str) -> np.ndarray:
        words = WORDS.findall(self.normalised(text)) if self.by_word else [self.normalised(text)] * bool(text)
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        if len(self.agree) > 4 * CACHED:
            self.agree.clear()
        known, older, out = self.known, self.older, []
        for word in words:
            if (ids := known.get(word)) is None:
                if (ids := older.get(word)) is None:
                    ids = array("i", self.shortest(word)).tobytes()
                if len(word) <= 64 and len(known) < 2 * CACHED:
                    known[word] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids) -> str:
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids]).decode("utf-8", "replace").replace(BLANK, " ")[1:]


_machines: dict[tuple[str, str], Transducer] = {}


def machine_of(path: str, kind: str) -> Transducer:
    """The compiled transducer, kept by a worker from task to task."""
    if (path, kind) not in _machines:
        _machines[path, kind] = Transducer(path, kind)
    return _machines[path, kind]


def encode(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, ids array<int>, round_trip): ids of every text, and whether decoding them gives the text back.

    A text that itself holds U+2581 comes back with blanks in those places, and then ``round_trip`` is false.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]):
        machine = machine_of(path, kind)
        for batch in batches:
            doc_ids, all_ids, same = [], [], []
            for doc_id, octets in rows_of(batch):
                text = octets.decode("utf-8", "replace") if octets else ""
                ids = machine.encode(text)
                doc_ids.append(doc_id)
                all_ids.append(ids)
                same.append(machine.decode(ids.tolist()) == text)
            ends = np.cumsum([0, *map(len, all_ids)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *all_ids])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists.cast(schema.field(1).type), pa.array(same, pa.bool_())], schema=schema)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        machine = machine_of(path, "bpe")
        for batch in batches:
            yield batch_of(schema, (batch.column(0), [None if ids is None else machine.decode(ids) for ids in batch.column(1).to_pylist()]))

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
