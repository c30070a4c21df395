"""Passage retrieval per (case, rule): term weighting inside each case, or given dense vectors.

Chunks are rows ``(case_id, chunk_id, text)``, rules are rows ``(ruleset_id, rule_id, title, quote)`` and
``case_sets`` maps case_id to ruleset_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eviflow.functions import text as tx
from eviflow.operators.common import computed, join_keyed, top_k

TOKEN = r"(?U)\b\w\w+\b"


def tokens_of(text: Column) -> Column:
    """Lower-case words of two letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def term_array(tokens: Column) -> Column:
    """The words and their bigrams."""
    n = F.size(tokens)
    pairs = F.arrays_zip(
        F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))).alias("b")
    )
    return F.concat(tokens, F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"])))


def term_counts(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, term, tf weight 1 + ln tf)."""
    return (
        computed(df.select(*keys, text), tokens_of(F.col(text)).alias("_tokens"))
        .select(*keys, F.explode(term_array(F.col("_tokens"))).alias("term"))
        .groupBy(*keys, "term")
        .agg((F.lit(1.0) + F.log(F.count("*"))).alias("tf"))
    )


def tfidf_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term weights per chunk, idf per (case, term), vector length per chunk)."""
    tf = term_counts(chunks, ["case_id", "chunk_id"])
    n = chunks.groupBy("case_id").agg(F.count("*").alias("n"))
    df = tf.groupBy("case_id", "term").agg(F.count("*").alias("df"))
    idf = df.join(n, "case_id").select(
        "case_id", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")
    )
    weights = tf.join(idf, ["case_id", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("case_id", "chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.select("case_id", "chunk_id", "term", "w"), idf, norms


def rule_query(rules: DataFrame) -> DataFrame:
    return rules.select(
        "ruleset_id", "rule_id", F.concat_ws(" — ", F.coalesce("title", F.lit("")), F.coalesce("quote", F.lit(""))).alias("text")
    )


def retrieve(chunks: DataFrame, case_sets: DataFrame, rules: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` chunks per (case, rule) by cosine, ties by chunk id; chunks without a shared term score 0.

    Scores come from joins on (case, term): no case meets a rule it shares no term with, except through its first
    ``k`` chunks, which are all the zero-score rows a top ``k`` can hold. Terms meet their rules where they lie by chunk,
    so they are summed per (chunk, rule) at once; only the sums are dealt by rule.
    """
    counted = term_counts(chunks, ["case_id", "chunk_id"])
    n = chunks.groupBy("case_id").agg(F.count("*").alias("n"))
    sets = case_sets.select("case_id", "ruleset_id")
    df = F.count("*").over(Window.partitionBy("case_id", "term"))
    weighed = counted.withColumn("df", df).join(n, "case_id").withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    w = F.col("tf") * F.col("idf")
    weighed = weighed.select("case_id", "chunk_id", "term", "df", "idf", w.alias("w")).repartition("case_id", "chunk_id")
    asked = term_counts(rule_query(rules), ["ruleset_id", "rule_id"]).withColumnRenamed("tf", "q_tf")
    asked = asked.withColumn("_asked", F.count("*").over(Window.partitionBy("ruleset_id", "term")))
    sets_of = sets.withColumn("_sets", F.count("*").over(Window.partitionBy("case_id")))
    met = join_keyed(join_keyed(weighed, sets_of, ["case_id"]), asked, ["ruleset_id", "term"], "left")
    q, w = F.col("q_tf") * F.col("idf"), F.col("w")
    # A term stands in a row per rule that asks for it, or in one without a rule; each gives its share of the chunk's length.
    length = F.sum(w * w / (F.coalesce("_asked", F.lit(1)) * F.col("_sets")))
    # A term of the case stands in ``df`` rows per rule; each gives its share of the query's length.
    summed = met.groupBy("case_id", "chunk_id", "rule_id", F.col("q_tf").isNull().alias("_rest")).agg(
        F.sum(q * w).alias("dot"), F.sum(q * q / F.col("df")).alias("q_share"), length.alias("share")
    )
    norm = F.sqrt(F.sum("share").over(Window.partitionBy("case_id", "chunk_id")))
    scored = summed.withColumn("norm", norm).filter(~F.col("_rest")).select("case_id", "rule_id", "chunk_id", "dot", "q_share", "norm")
    first = top_k(chunks.select("case_id", "chunk_id"), ["case_id"], [F.asc("chunk_id")], k).drop("rank")
    blank = join_keyed(first.join(sets, "case_id"), rules.select("ruleset_id", "rule_id"), ["ruleset_id"]).select(
        "case_id", "rule_id", "chunk_id", F.lit(0.0).alias("dot"), F.lit(0.0).alias("q_share"), F.lit(None).cast("double").alias("norm")
    )
    # One exchange by (case, rule) serves the merge with the blank rows, the query's length and the ranks.
    best = scored.unionByName(blank).repartition("case_id", "rule_id").groupBy("case_id", "rule_id", "chunk_id").agg(
        F.sum("dot").alias("dot"), F.sum("q_share").alias("q_share"), F.max("norm").alias("norm")
    )
    q_norm = F.sqrt(F.sum("q_share").over(Window.partitionBy("case_id", "rule_id")))
    best = best.withColumn("q_norm", q_norm).withColumn("raw", F.coalesce(F.col("dot") / (F.col("norm") * F.col("q_norm")), F.lit(0.0)))
    ranked = top_k(
        best.withColumn("_order", F.round("raw", 10)),
        ["case_id", "rule_id"],
        [F.desc("_order"), F.asc("chunk_id")],
        k,
    )
    return ranked.select("case_id", "rule_id", "chunk_id", "rank", F.round("raw", 4).alias("score"))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` vectors (case_id, chunk_id, vector) per query (case_id, query_id, query) of the same case by inner
    product. Queries are few per case; they are sent to the vectors when their count allows."""
    joined = join_keyed(vectors, queries.select("case_id", "query_id", "query"), ["case_id"])
    products = F.zip_with("query", "vector", lambda a, b: a.cast("double") * b.cast("double"))
    scored = joined.select(
        "case_id", "query_id", "chunk_id", F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x).alias("raw")
    )
    ranked = top_k(
        scored.withColumn("_order", F.round("raw", 10)),
        ["case_id", "query_id"],
        [F.desc("_order"), F.asc("chunk_id")],
        k,
    )
    return ranked.select("case_id", "query_id", "chunk_id", "rank", F.round("raw", 4).alias("score"))
