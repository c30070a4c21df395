"""Quality rules per document and per host, in DataFrame functions only.

Every document is judged by base rules over its own text. A host (``source``) is judged by the share of its documents
that break a rule: the share is shrunk towards that of all hosts by a beta prior whose strength is fitted to how much
hosts differ (moments of the host counts), and a host whose shrunk share passes ``host_limit`` loses all its documents.
Counts per host are combined before the shuffle; verdicts come back by a join on the host that Spark may split.

Windows of eight words are compared by 64-bit hashes within one text.

Defined cases: null and empty texts have no words and fail; a null source is a host of its own; repeated rows count each;
an empty table gives no rows; further columns are carried whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow.llm.common import SPACES, packed, word_list, written

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside windows that are found twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

        def step(a, p):
            end = p + WINDOW
            return F.struct((a["n"] + end - F.greatest(p, a["end"])).cast("long").alias("n"), end.cast("long").alias("end"))

        return F.aggregate(F.array_sort(F.transform(same, lambda x: x["i"])), start, step)["n"]

    def of(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, covered))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, of))


def counters(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text column."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    of_words = let(word_list(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def measured(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, host, counters, base_failed and rule_failed; with ``carry`` also ``doc``, null where base rules fail."""
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), counters(F.col("text")).alias("c"))
    rows = rows.select("doc", "doc_id", "host", "c.w.*", "c.l.*", "c.word_chars", "c.n_symbols")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    failed = base | (2 * F.col("n_symbols") > F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("n_lines"))
    rows = rows.withColumn("rule_failed", failed)
    return rows.withColumn("doc", F.when(~F.col("base_failed"), F.col("doc"))) if carry else rows.drop("doc")


def hosts(rows: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """(host, n_docs, n_failed, shrunk, host_rejected) of every host."""
    counts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("rule_failed").cast("long")).alias("n_failed"))
    n, f = F.col("n_docs"), F.col("n_failed")
    all_ = counts.agg(F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("q")).first()  # one row of sums
    alpha, beta = beta_prior(all_["h"], all_["n"] or 0, all_["f"] or 0, all_["q"] or 0.0)
    shrunk = (f + F.lit(alpha)) / (n + F.lit(alpha + beta))
    return counts.withColumn("shrunk", shrunk).withColumn("host_rejected", shrunk > host_limit)


def beta_prior(n_hosts: int, n_docs: int, n_failed: int, squares: float) -> tuple[float, float]:
    """(alpha, beta) by moments; ``squares`` is the sum over hosts of failed * failed / documents.

    Where hosts differ no more than chance, or there is one host, the prior is as strong as 1e6 documents.
    """
    if not n_docs:
        return 0.5, 0.5
    mean = n_failed / n_docs
    chance = mean * (1 - mean)
    between = squares / n_docs - mean * mean
    excess = between - chance * n_hosts / n_docs
    strength = min(max((chance - between) / excess, 1.0), 1e6) if excess > 0 else 1e6
    mean = (n_failed + 0.5) / (n_docs + 1)
    return mean * strength, (1 - mean) * strength


def judged(docs: DataFrame, folder: str, host_limit: float = 0.5, carry: bool = False) -> DataFrame:
    """Every document with its counters, base_failed, host_rejected and kept (and ``doc`` where it passes the base rules)."""
    rows = written(measured(docs, carry), folder, "measured")
    verdicts = hosts(rows, host_limit).select(F.col("host").alias("verdict_host"), "host_rejected")
    found = rows.join(verdicts, rows["host"].eqNullSafe(verdicts["verdict_host"]), "left").drop("verdict_host")
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
