"""Registered queries of the operators; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eviflow.llm import language, lexical, line_dedup, mixture, oracles, pieces, quality_model, quality_rules, sharding, simhash, spelling, suffix, token_files, vptree
from eviflow.llm.common import session, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, table: str = "documents", sql: str | None = None):
    """Register ``fn(table, folder)``, called with the whole table and a fresh shared folder."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(session(spark).read.parquet(f"{sf_dir}/{table}.parquet"), work_folder(spark))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


@query("op1_mixture")
def op1(documents, folder):
    found = mixture.mix(documents, folder, carry=["doc_id"])
    return found.select("doc.doc_id", "size", "source_size", "target", "taken", "draws")


@query("op2_vptree", table="embeddings", sql=oracles.NEAREST)
def op2(embeddings, folder):
    return vptree.search(embeddings, k=20, every=20)


@query("op3_sharding", sql=oracles.sharding_sql())
def op3(documents, folder):
    return sharding.placed(documents, shards=40)


@query("op4_sentencepiece")
def op4(documents, folder):
    return pieces.encode(documents, public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_simhash")
def op5(documents, folder):
    found = simhash.near_duplicates(documents, folder)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_suffix_array", sql=oracles.suffix_sql())
def op6(documents, folder):
    return suffix.dedup(documents, folder, length=50)


@query("op7_quality_rules", sql=oracles.QUALITY)
def op7(documents, folder):
    found = quality_rules.judged(documents, folder)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_token_files")
def op8(documents, folder):
    return token_files.write_and_read(documents, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1, digest=True)


@query("op9_language")
def op9(documents, folder):
    return language.identified(documents, folder)


def op10(spark, sf_dir):
    tables = session(spark).read
    return quality_model.scored(tables.parquet(f"{sf_dir}/documents.parquet"), tables.parquet(f"{sf_dir}/labels.parquet"), work_folder(spark))


QUERIES["op10_quality_model"] = op10


@query("op11_line_dedup", sql=oracles.LINES)
def op11(documents, folder):
    return line_dedup.dedup(documents, folder).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12(spark, sf_dir):
    tables = session(spark).read
    return lexical.search(tables.parquet(f"{sf_dir}/documents.parquet"), tables.parquet(f"{sf_dir}/benchmark.parquet"), work_folder(spark))


QUERIES["op12_lexical_search"], SQL["op12_lexical_search"] = op12, oracles.LEXICAL


@query("op13_spelling", sql=oracles.SPELLING)
def op13(documents, folder):
    return spelling.grouped(documents, folder)
