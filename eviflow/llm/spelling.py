"""Spelling variants: words that one edit turns into each other, found by PartEnum signatures over letter multisets.

A word is a binary vector with one dimension per (letter, occurrence). One inserted or deleted letter changes one
dimension, a replaced one changes two, so near words lie within a Hamming distance of two. The letters are dealt over
``PARTS`` parts. Words of one length differ in two parts at most and agree in some three of the five; a word and a longer
one differ in one part and agree in some four. Each word gives one exact signature per length and choice of parts; an
equi-join on signatures meets every near pair, and the edit distance is verified on what meets.

A signature of more than ``CROWD`` words is split again: one edit leaves the first or the last half of the shorter word as
it is, so such words meet on the signature with either half. Nothing is capped; joins are left to Spark to split.

Defined cases: a null or empty text has no words; a null doc_id is read as ``null`` where one in 31 runs loses a letter;
repeated rows count each; a word without a near word has no form and is its own root; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow.llm.common import batch_of, written

MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
PARTS = 5
CROWD = 128
#: Letters by falling frequency, dealt in turn; further ones follow in code-point order.
BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Chains of forms grow tenfold a step, so 63 bits of count allow 18 steps: five doublings.
DOUBLINGS = 5
_LETTER = {**{c: c for c in range(0x61, 0x7B)}, **{c: c + 32 for c in range(0x41, 0x5B)}, **{c: c for c in range(0xC0, 0x100)}}
_TABLE = bytes(_LETTER.get(c, 32) for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF as Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_TABLE).split() if text else []


def counted_words(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n) of all documents; where 31 divides the crc32 of ``<doc_id>:<run>``, the run has lost a letter."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        from collections import Counter
        from zlib import crc32

        held: Counter[bytes] = Counter()

        def out():
            words = list(held)
            found = batch_of(schema, ([w.decode("latin-1") for w in words], [held[w] for w in words]))
            held.clear()
            return found

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = crc32(f"{doc}:".encode())
                for word, n in Counter(runs(text)).items():
                    size = len(word)
                    if size < min_length:
                        continue
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % 31 == 0:
                        at = h % size
                        word = word[:at] + word[at + 1 :]
                        if size == min_length:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    doc = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    rows = docs.select(doc.alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_parts() -> list[str]:
    """The letters of each part."""
    letters = BY_FREQUENCY + "".join(map(chr, range(0xC0, 0x100)))
    return [letters[i::PARTS] for i in range(PARTS)]


def projections(word: Column) -> list[Column]:
    """The word's letters of each part, sorted."""
    letters = F.array_join(F.array_sort(F.split(word, "")), "")
    parts = letter_parts()
    return [F.translate(letters, "".join(p for p in parts if p != own), "") for own in parts]


def signatures(words: DataFrame) -> DataFrame:
    """(sig, role, short, word, n): signatures of each word.

    Role 0 meets role 0 (words of one length), role 1 meets role 2 (a word and one that is a letter longer). ``short`` is
    the length of the shorter word.
    """
    named = [f"p{i}" for i in range(PARTS)]
    rows = words.select("word", "n", F.length("word").alias("len"), *[p.alias(name) for p, name in zip(projections(F.col("word")), named, strict=True)])

    def sig(role: int, short: Column, kept: int) -> list[Column]:
        kind = 0 if role == 0 else 1
        of = [F.xxhash64(F.lit(kind), short, F.lit(i), *chosen) for i, chosen in enumerate(combinations(named, kept))]
        return [F.struct(s.alias("sig"), F.lit(role).alias("role"), short.alias("short")) for s in of]

    size = F.col("len")
    every = F.array(*sig(0, size, PARTS - 2), *sig(1, size, PARTS - 1), *sig(2, size - 1, PARTS - 1))
    return rows.select("word", "n", F.inline(every)).select("sig", "role", "short", "word", "n")


def split_crowds(sigs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``sigs`` with signatures of over ``crowd`` words split by either half of the shorter word."""
    crowded = sigs.groupBy("sig").agg(F.count("*").alias("held")).filter(F.col("held") > crowd).select("sig", F.lit(True).alias("crowded"))
    half = F.floor(F.col("short") / 2).cast("int")
    ends = F.array(F.xxhash64("sig", F.lit("first"), F.substring(F.col("word"), F.lit(1), half)), F.xxhash64("sig", F.lit("last"), F.substring(F.col("word"), -half, half)))
    keys = F.when(F.col("crowded"), ends).otherwise(F.array("sig"))
    return sigs.join(crowded, "sig", "left").select(F.explode(keys).alias("sig"), "role", "word", "n")


def near_pairs(words: DataFrame, folder: str, crowd: int = CROWD) -> DataFrame:
    """(word, n, near, near_n) both ways of all words (word, n) that one edit turns into each other."""
    keys = written(split_crowds(written(signatures(words), folder, "signatures"), crowd), folder, "keys")

    def side(role: int, word: str, n: str) -> DataFrame:
        return keys.filter(F.col("role") == role).select("sig", F.col("word").alias(word), F.col("n").alias(n))

    one_edit = F.levenshtein("word", "near", 1) == 1
    same = side(0, "word", "n").join(side(0, "near", "near_n"), "sig").filter((F.col("word") < F.col("near")) & one_edit)
    longer = side(1, "word", "n").join(side(2, "near", "near_n"), "sig").filter(one_edit)
    pairs = written(same.unionByName(longer).drop("sig").distinct(), folder, "pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def forms(words: DataFrame, folder: str, factor: int = FACTOR, crowd: int = CROWD) -> DataFrame:
    """(word, n, n_near, form, form_n) of each word: the near word of largest n, where that is ``factor`` times the word's."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_pairs(words, folder, crowd).groupBy("word").agg(F.count("*").alias("n_near"), best)
    met = words.join(near, "word", "left")
    chosen = -F.col("best.less") >= factor * F.col("n")
    return met.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")
    )


def grouped(docs: DataFrame, folder: str, min_count: int = MIN_COUNT, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word found ``min_count`` times or more."""
    words = written(counted_words(docs).filter(F.col("n") >= min_count), folder, "words")
    found = written(forms(words, folder, crowd=crowd), folder, "forms")
    up = found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for k in range(DOUBLINGS):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = written(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), folder, f"roots-{k}")
    return found.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
