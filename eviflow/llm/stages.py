"""Pipeline stages: each takes (spark, docs, sf_dir) and returns documents, the last one token ids.

A stage works on any table with doc_id, text and source; further columns are carried whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eviflow.llm import jaccard, mixture, pieces, quality_rules, suffix
from eviflow.llm.common import SPACES, packed, session, work_folder, written

_folders: list[tuple[str, str]] = []
#: Shared passages of this many bytes or more go, as in op6.
PASSAGE_BYTES = 50


def stage_folder(spark: SparkSession, docs: DataFrame, stage: str) -> str:
    """A fresh folder for one stage's own tables.

    The caller writes a stage's result before the next stage begins, so the tables of other stages are freed here (by
    writing an empty table over their folder), except where ``docs`` still reads them.
    """
    folder, read = work_folder(session(spark)), docs.inputFiles()
    for entry in [e for e in _folders if e[0] != stage and not any(e[1].rsplit("/", 1)[1] in f for f in read)]:
        spark.createDataFrame([], "freed int").write.mode("overwrite").parquet(entry[1])
        _folders.remove(entry)
    _folders.append((stage, folder))
    return folder


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    found = quality_rules.judged(docs, stage_folder(spark, docs, "quality_rules"), carry=True)
    return found.filter("kept").select("doc.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest doc_id. Repeated rows and null ids are rows of their own.

    Documents are linked where the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. SimHash
    fingerprints of the sets give the first pairs, which are checked exactly; at 0.8 about ten of 64 bits differ, so
    ``jaccard`` finds the pairs that fingerprints miss by prefixes. A null doc_id is above all others; among equal ones the text's hash decides, and then the table's order. An empty table stays empty.
    """
    folder = stage_folder(spark, docs, "simhash")
    rows = written(packed(docs, F.monotonically_increasing_id().alias("row")), folder, "numbered", "zstd")
    found = written(jaccard.near_copies(rows.select("row", F.col("doc.text").alias("text")), folder), folder, "groups")
    many = found.filter(F.col("row") != F.col("first")).select("first").distinct()
    members = found.join(many, "first").join(rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.xxhash64("doc.text").alias("hash")), "row")
    kept = members.groupBy("first").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "row")).alias("kept"))
    dropped = written(members.join(kept, "first").filter(F.col("row") != F.col("kept.row")).select("row", F.lit(True).alias("dropped")), folder, "dropped")
    unsure = jaccard.likely(dropped)
    doubtful = rows.filter(unsure).join(dropped, "row", "left").filter(F.col("dropped").isNull())
    return rows.filter(~unsure).select("doc.*").union(doubtful.select("doc.*"))


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller doc_id also holds; one left without words goes."""
    kept = suffix.dedup(docs, stage_folder(spark, docs, "suffix_array"), length=PASSAGE_BYTES, carry=True)
    kept = kept.filter(F.btrim("text", F.lit(SPACES)) != "")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken."""
    stage_folder(spark, docs, "mixture")
    return mixture.mixed_documents(docs, shards=64)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, round_trip) of every document."""
    stage_folder(spark, docs, "sentencepiece")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
