"""Segmentation of dossiers into documents, paragraphs, sentences and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.functions import text as tx

PARAGRAPH_BREAK = r"(?U)\n\s*\n"


def sentences(df: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """(key, sent_ord, sentence), verbatim and without blanks."""
    return df.select(key, F.posexplode(tx.sentence_array(text)).alias("sent_ord", "sentence"))


def _chunk_array(text: Column) -> Column:
    pieces = F.split(text, PARAGRAPH_BREAK)
    breaks = F.regexp_extract_all(text, F.lit(PARAGRAPH_BREAK), F.lit(0))
    spans = F.arrays_zip(pieces.alias("piece"), breaks.alias("gap"))
    steps = F.transform(spans, lambda s: F.length(s["piece"]) + F.coalesce(F.length(s["gap"]), F.lit(0)))
    offsets = F.aggregate(
        steps,
        F.array(F.lit(0)),
        lambda acc, step: F.array_append(acc, F.element_at(acc, -1) + step),
    )
    placed = F.transform(
        F.arrays_zip(pieces.alias("piece"), F.slice(offsets, 1, F.size(pieces)).alias("offset")),
        lambda p: F.struct(
            (p["offset"] + F.length(F.regexp_extract(p["piece"], rf"(?U)^{tx.SPACE}*", 0))).alias("start"),
            tx.trim_space(p["piece"]).alias("text"),
        ),
    )
    return F.filter(placed, lambda p: p["text"] != "")


def chunks(df: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """Paragraphs with exact character offsets, ids dense over the non-blank ones."""
    return df.select(key, F.posexplode(_chunk_array(F.col(text))).alias("chunk_id", "c")).select(
        key,
        "chunk_id",
        F.col("c.start").alias("start"),
        (F.col("c.start") + F.length("c.text")).alias("end"),
        F.col("c.text").alias("text"),
    )


def document_array(text: Column | str) -> Column:
    """Documents of a dossier as an array of (doc, body); non-blank text before the first marker comes first."""
    text = tx._c(text)
    names = F.concat(
        F.array(F.lit(fv.MAIN_DOC)),
        F.transform(F.regexp_extract_all(text, F.lit(fv.DOC_MARKER), F.lit(1)), tx.trim_space),
    )
    docs = F.arrays_zip(names.alias("doc"), F.split(text, fv.DOC_MARKER).alias("body"))
    return F.filter(docs, lambda d, i: (i > 0) | (tx.trim_space(d["body"]) != ""))


def split_documents(df: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """(key, doc_ord, doc, body): one row per document of a dossier."""
    return df.select(key, F.posexplode(document_array(text)).alias("doc_ord", "d")).select(
        key, "doc_ord", F.col("d.doc").alias("doc"), F.col("d.body").alias("body")
    )


def table_blocks(documents: DataFrame) -> DataFrame:
    """Table blocks of the documents, the marker lines included."""
    blocks = F.arrays_zip(
        F.regexp_extract_all("body", F.lit(fv.TABLE_BLOCK), F.lit(1)).alias("table_no"),
        F.regexp_extract_all("body", F.lit(fv.TABLE_BLOCK), F.lit(0)).alias("block"),
    )
    return documents.select("case_id", "doc_ord", "doc", F.posexplode(blocks).alias("block_ord", "b")).select(
        "case_id", "doc_ord", "doc", "block_ord", F.col("b.table_no").cast("bigint").alias("table_no"), "b.block"
    )


def tables_to_pipe(rows: DataFrame) -> DataFrame:
    """Table rows ``(doc_id, table_no, row_no, cells array)`` as pipe lines; rows of blank cells are dropped.

    One line per table row, so a table of any length stays spread over tasks; the block markers are lines as well.
    """
    clean = F.transform("cells", lambda c: tx.collapse_space(F.coalesce(c, F.lit(""))))
    lines = (
        rows.withColumn("_cells", clean)
        .filter(F.exists("_cells", lambda c: c != ""))
        .select(
            "doc_id",
            "table_no",
            "row_no",
            F.concat(F.lit("| "), F.array_join("_cells", " | "), F.lit(" |")).alias("line"),
        )
    )
    edges = rows.groupBy("doc_id", "table_no").agg(F.min("row_no").alias("lo"), F.max("row_no").alias("hi"))
    marks = edges.select(
        "doc_id",
        "table_no",
        F.inline(
            F.array(
                F.struct((F.col("lo") - 1).alias("row_no"), F.format_string("[TABLE %d]", "table_no").alias("line")),
                F.struct((F.col("hi") + 1).alias("row_no"), F.format_string("[/TABLE %d]", "table_no").alias("line")),
            )
        ),
    )
    return lines.unionByName(marks)


def attach_documents(cases: DataFrame, verdicts: DataFrame, attachments: DataFrame) -> tuple[DataFrame, ...]:
    """Attach documents ``(case_id, name, text)`` to cases; several of one case follow each other by ``ord`` where the
    column is given, else by name and text.

    Returns (cases with the document appended and the state reset, verdicts still valid, refused attachments).
    Signed cases and texts under ten words are refused.
    """
    body = tx.trim_space(F.replace("text", F.lit("\r\n"), F.lit("\n")))
    order = F.col("ord").cast("long") if "ord" in attachments.columns else F.lit(0).cast("long")
    offered = attachments.select(
        "case_id", order.alias("_ord"), F.col("name").alias("_name"), body.alias("_body"), tx.word_count(body).alias("_words")
    )
    state = cases.select("case_id", "status")
    judged = offered.join(state, "case_id", "left").withColumn(
        "reason",
        F.when(F.col("status").isNull(), "unknown_case")
        .when(F.col("status").isin(fv.SIGNED_OR_LATER), "signed")
        .when(F.col("_words") < fv.MIN_WORDS["attachment"], "too_short"),
    )
    section = F.concat(F.lit("\n\n=== DOCUMENT: "), tx.trim_space("_name"), F.lit(" ===\n\n"), F.col("_body"))
    # One row per case, or a case would come back once per attachment.
    sections = F.transform(F.array_sort(F.collect_list(F.struct("_ord", "_name", section.alias("s")))), lambda a: a["s"])
    accepted = judged.filter(F.col("reason").isNull()).groupBy("case_id").agg(F.array_join(sections, "").alias("_sections"))
    hit = F.col("_sections").isNotNull()
    appended = F.concat(F.regexp_replace("text", rf"(?U){tx.SPACE}+$", ""), F.col("_sections"))
    reset = ["officer", "review_started_at", "spot_rule", "spot_answer", "spot_ai"]
    merged = cases.join(accepted, "case_id", "left").select(
        *[
            F.when(hit, appended).otherwise(F.col("text")).alias("text")
            if c == "text"
            else F.when(hit, F.lit("new")).otherwise(F.col("status")).alias("status")
            if c == "status"
            else F.when(~hit, F.col(c)).alias(c)
            if c in reset
            else F.col(c)
            for c in cases.columns
        ]
    )
    valid = verdicts.join(accepted.select("case_id"), "case_id", "left_anti")
    refused = judged.filter(F.col("reason").isNotNull()).select("case_id", F.col("_name").alias("name"), "reason")
    return merged, valid, refused
