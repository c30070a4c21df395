"""Exact line dedup across documents, in DataFrame functions only.

A line's key is the line without the white space at its ends, A-Z in lower case. A key of ``min_chars`` code points or
more that is found in ``min_docs`` documents or more keeps its lines in the largest doc_id that holds it; all its other
lines go.

Lines are known by 128 bits of hashes. Hashes are range-partitioned and sorted by hash, document (largest first) and
position, so one pass over a hash meets its first occurrence first and numbers its documents. A hash with a large share
of all lines does not get a task of its own: up to ``HOT_KEYS`` of the most frequent ones in a sample are answered by
partial aggregates and met by a broadcast of that many rows. The sample decides the way only, never the result.

The result is not text but a bitmap per document that loses lines: 64-bit words of kept lines, where words that keep all
their lines are left out.

Defined cases: a null or empty text is one empty line; a line without key characters stays; rows with equal doc_id are one
document, and each row loses its own lines; a null doc_id is a document below all others; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eviflow.llm.common import SPACES, written

MIN_CHARS, MIN_DOCS = 40, 5
#: At most this many keys are broadcast (24 bytes each).
HOT_KEYS = 50_000
#: One line in so many is sampled; a key is hot with so many sampled lines.
SAMPLE, HOT_LINES = 16, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = 64
DOC = ["doc_id", "text_key"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line as it is compared; ``lower`` serves for lines of ASCII, where it is the same."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc_id, text_key, text): the two keys tell rows apart wherever their lines differ."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def long_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(h, g, doc_id, text_key, at) of every line that may go."""
    found = rows.select(*DOC, F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    found = found.filter(F.length(F.btrim("line", F.lit(SPACES))) >= min_chars).select(*DOC, "at", line_key(F.col("line")).alias("key"))
    return found.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), F.col("key")).alias("g"), *DOC, "at")


def hot_keys(lines: DataFrame) -> DataFrame:
    """(h, g) of the most frequent keys of a sample, ``HOT_KEYS`` at most."""
    sample = lines.filter(F.pmod(F.xxhash64(F.lit(2), *DOC, "at"), F.lit(SAMPLE)) == 0)
    often = sample.groupBy("h", "g").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_LINES)
    return often.orderBy(F.desc("n"), "h", "g").limit(HOT_KEYS).select("h", "g")


def first_occurrences(lines: DataFrame) -> DataFrame:
    """``lines`` with ``turn`` (1 in the key's largest document) and ``n_docs``, streamed in key order."""
    ordered = lines.repartitionByRange("h", "g").sortWithinPartitions("h", "g", F.desc_nulls_last("doc_id"), "at")
    own = Window.partitionBy("h", "g")
    return ordered.withColumn("turn", F.dense_rank().over(own.orderBy(F.desc_nulls_last("doc_id")))).withColumn("n_docs", F.max("turn").over(own))


def dropped_lines(rows: DataFrame, folder: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, at) of every line of ``rows`` that goes."""
    lines = written(long_lines(rows, min_chars), folder, "lines")
    hot = F.broadcast(written(hot_keys(lines), folder, "hot"))
    streamed = first_occurrences(lines.join(hot, ["h", "g"], "left_anti"))
    cold = streamed.filter((F.col("n_docs") >= min_docs) & (F.col("turn") > 1)).select(*DOC, "at")

    of_hot = lines.join(hot, ["h", "g"])
    docs = of_hot.groupBy("h", "g", "doc_id").agg(F.lit(1).alias("one")).groupBy("h", "g").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    many = written(docs.filter(F.col("n_docs") >= min_docs), folder, "hot-keys")  # HOT_KEYS rows at most
    hit = of_hot.join(F.broadcast(many), ["h", "g"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return cold.unionByName(hit.select(*DOC, "at"))


def keep_bitmaps(rows: DataFrame, folder: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, n_dropped, keep) of every row of ``keyed`` documents that loses lines.

    ``keep`` is an array of (word, bits), sorted: bit b of ``bits`` tells whether line 64 * word + b stays; lines of absent
    words stay. Rows of equal doc_id and text share a bitmap.
    """
    at = F.col("at")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(WORD)))
    words = dropped_lines(rows, folder, min_chars, min_docs).groupBy(*DOC, F.floor(at / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("gone"))
    kept = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy(*DOC).agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(kept)).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` that the bitmap keeps."""
    words = F.map_from_entries(keep)
    dense = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(words))), lambda w: F.coalesce(F.try_element_at(words, w), F.lit(-1).cast("long")))

    def stays(at, of):
        bits = F.coalesce(F.get(of, F.floor(at / WORD).cast("int")), F.lit(-1).cast("long"))
        return F.call_function("getbit", bits, F.pmod(at, F.lit(WORD))) == 1

    cut = F.transform(F.array(F.struct(lines_of(text).alias("lines"), dense.alias("of"))), lambda x: F.array_join(F.filter(x["lines"], lambda line, at: stays(at, x["of"])), "\n"))
    return F.when(keep.isNull(), text).otherwise(cut[0])


def dedup(docs: DataFrame, folder: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every document, ``text`` being what its bitmap keeps."""
    rows = keyed(docs)
    maps = keep_bitmaps(rows, folder, min_chars, min_docs).select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "n_dropped", "keep")
    met = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
    return met.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        kept_text(F.col("text"), F.col("keep")).alias("text"),
    )
