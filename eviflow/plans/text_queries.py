"""Queries over the text and cross-check operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.functions import text as tx
from eviflow.operators import crosscheck as xck
from eviflow.operators import segment as sg
from eviflow.plans import views as v
from eviflow.plans.registry import Tables, query
from eviflow.sources.readers import intake_text

AS_OF = "1998-06-30"


def _documents(t: Tables) -> DataFrame:
    return sg.split_documents(v.money_dossiers(t))


# --- cross-check ---------------------------------------------------------------------------------
MISMATCH = """
v_mismatch AS (
  SELECT case_id, 'budget_total' AS category, 'Total budget' AS label, 'high' AS severity,
    CAST(2 AS BIGINT) AS n_values, CAST(2 AS BIGINT) AS n_distinct, least(declared, attached) AS low_value,
    greatest(declared, attached) AS high_value
  FROM v_money WHERE attached <> declared
  UNION ALL
  SELECT case_id, 'phd_year', 'PhD year', 'medium', 2, 2, year - 10, phd_year FROM v_money
  WHERE attached IS NOT NULL AND phd_year <> year - 10)
"""


@query("crosscheck_mismatch", v.ctes(v.V_MONEY, MISMATCH, body="SELECT * FROM v_mismatch"))
def crosscheck_mismatch(t: Tables) -> DataFrame:
    findings, _ = xck.crosscheck(v.money_dossiers(t), AS_OF)
    keep = ["case_id", "category", "label", "severity", "n_values", "n_distinct", "low_value", "high_value"]
    return findings.filter(F.col("n_values").isNotNull()).select(*keep)


@query("crosscheck_document_rows", v.ctes(v.V_MONEY, MISMATCH, body="SELECT * FROM v_mismatch"))
def crosscheck_document_rows(t: Tables) -> DataFrame:
    """The same findings from dossiers kept as document rows."""
    return xck.discrepancies(xck.extract_values(_documents(t)))


@query(
    "crosscheck_values",
    v.ctes(
        v.V_MONEY,
        body="""
SELECT case_id, 'budget_total' AS category, declared AS value, 'Main form' AS source FROM v_money
UNION ALL SELECT case_id, 'revenue', revenue, 'Main form' FROM v_money WHERE revenue IS NOT NULL
UNION ALL SELECT case_id, 'phd_year', year - 10, 'Main form' FROM v_money
UNION ALL SELECT case_id, 'pd_pages', pages, 'Main form' FROM v_money
UNION ALL SELECT case_id, 'budget_total', attached, 'Cost plan · TABLE 1' FROM v_money WHERE attached IS NOT NULL
UNION ALL SELECT case_id, 'phd_year', phd_year, 'Cost plan' FROM v_money WHERE attached IS NOT NULL
UNION ALL SELECT case_id, 'letter_pages', pages, 'Cost plan' FROM v_money WHERE attached IS NOT NULL
""",
    ),
)
def crosscheck_values(t: Tables) -> DataFrame:
    return xck.extract_values(_documents(t)).select("case_id", "category", "value", "source")


@query(
    "crosscheck_dates",
    v.ctes(
        v.V_MONEY,
        body="""
SELECT case_id, 'date_future' AS category, 'medium' AS severity, '15/03/' || CAST(year + 2 AS VARCHAR) AS value
FROM v_money WHERE attached IS NOT NULL AND year + 2 > 1999
UNION ALL
SELECT case_id, 'date_order', 'high', CAST(year AS VARCHAR) || ' → ' || CAST(end_year AS VARCHAR)
FROM v_money WHERE attached IS NOT NULL AND end_year < year
""",
    ),
)
def crosscheck_dates(t: Tables) -> DataFrame:
    return xck.date_findings(_documents(t), AS_OF).select("case_id", "category", "severity", "value")


@query(
    "crosscheck_risk",
    v.ctes(
        v.V_MONEY,
        body="""
SELECT case_id, CASE WHEN attached IS NULL THEN 1 ELSE 2 END::BIGINT AS n_docs,
  (3 + CASE WHEN revenue IS NULL THEN 0 ELSE 1 END + CASE WHEN attached IS NULL THEN 0 ELSE 3 END)::BIGINT AS n_checked,
  (CASE WHEN attached IS NULL THEN 1 ELSE 2 END)::BIGINT AS checked_budget_total,
  (CASE WHEN revenue IS NULL THEN 0 ELSE 1 END)::BIGINT AS checked_revenue,
  (CASE WHEN attached IS NULL THEN 1 ELSE 2 END)::BIGINT AS checked_phd_year,
  1::BIGINT AS checked_pd_pages, (CASE WHEN attached IS NULL THEN 0 ELSE 1 END)::BIGINT AS checked_letter_pages,
  CASE WHEN attached IS NULL THEN 0 ELSE (attached <> declared)::INT + (phd_year <> year - 10)::INT
    + (year + 2 > 1999)::INT + (end_year < year)::INT END::BIGINT AS n_findings,
  CASE WHEN attached IS NULL THEN 'consistent' WHEN attached <> declared OR end_year < year THEN 'mismatch_high'
    WHEN phd_year <> year - 10 OR year + 2 > 1999 THEN 'mismatch' ELSE 'consistent' END AS risk
FROM v_money
""",
    ),
)
def crosscheck_risk(t: Tables) -> DataFrame:
    return xck.crosscheck(v.money_dossiers(t), AS_OF)[1]


@query(
    "money_parse",
    """
SELECT o_orderkey AS case_id, CAST(floor(o_totalprice) AS BIGINT) AS amount,
  CAST(floor(o_totalprice) AS BIGINT) * 1000 AS dotted FROM orders
""",
)
def money_parse(t: Tables) -> DataFrame:
    thousands = F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(".000"))
    return t.orders.select(
        F.col("o_orderkey").alias("case_id"),
        tx.parse_money(F.format_number("o_totalprice", 2)).alias("amount"),
        tx.parse_money(thousands).alias("dotted"),
    )


# --- segmentation --------------------------------------------------------------------------------
@query(
    "documents_split",
    v.ctes(
        v.V_MONEY,
        v.V_MONEY_TEXT,
        body="""
SELECT case_id, 0 AS doc_ord, 'Main form' AS doc, main AS body FROM v_money_text
UNION ALL SELECT case_id, 1, 'Cost plan', plan FROM v_money_text WHERE attached IS NOT NULL
""",
    ),
)
def documents_split(t: Tables) -> DataFrame:
    return _documents(t).withColumn("body", tx.trim_space("body"))


@query(
    "table_blocks",
    v.ctes(
        v.V_MONEY,
        body="""
SELECT case_id, CAST(1 AS BIGINT) AS table_no, '[TABLE 1]' || chr(10) || '| Item | Cost |' || chr(10)
  || '| Grand total | $' || format('{:,}', attached) || ' |' || chr(10) || '[/TABLE 1]' AS block
FROM v_money WHERE attached IS NOT NULL
""",
    ),
)
def table_blocks(t: Tables) -> DataFrame:
    return sg.table_blocks(_documents(t)).select("case_id", "table_no", "block")


CHUNK_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
placed AS (
  SELECT *, coalesce(sum(length(line) + 6) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, trim(line) AS body FROM lines)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_id,
  CAST(base + 2 + length(line) - length(ltrim(line)) AS INTEGER) AS start,
  CAST(base + 2 + length(line) - length(ltrim(line)) + length(body) AS INTEGER) AS "end", body AS text
FROM placed WHERE body <> ''
"""


@query("chunks_with_offsets", CHUNK_SQL)
def chunks_with_offsets(t: Tables) -> DataFrame:
    """Every line of a document as a padded paragraph of its own."""
    padded = F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit(" \n \n  ")), F.lit(" "))
    return sg.chunks(t.spread("documents").select("doc_id", padded.alias("text")), key="doc_id")


SENTENCES = """
v_sentences AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(
    regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ss FROM documents)
"""


@query(
    "sentences",
    v.ctes(
        SENTENCES,
        body="SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS sent_ord, unnest(ss) AS sentence FROM v_sentences",
    ),
)
def sentences(t: Tables) -> DataFrame:
    return sg.sentences(t.spread("documents"), key="doc_id")


@query(
    "sentence_patterns",
    v.ctes(
        SENTENCES,
        body="""
SELECT doc_id, CAST(len(list_filter(ss, lambda s: regexp_matches(lower(s), '(^|[^\\p{L}\\p{N}_])(the|der|que)($|[^\\p{L}\\p{N}_])'))) AS BIGINT) AS n_hits,
  len(list_filter(ss, lambda s: regexp_matches(lower(s), 'ent') AND regexp_matches(lower(s), 'on')
    AND NOT regexp_matches(lower(s), '(^|[^\\p{L}\\p{N}_])(no|not|none|without)($|[^\\p{L}\\p{N}_])'))) > 0 AS alt_ok
FROM v_sentences
""",
    ),
)
def sentence_patterns(t: Tables) -> DataFrame:
    text = tx.trim_space("text")
    return t.spread("documents").select(
        "doc_id",
        F.size(tx.sentences_matching(text, r"(?iuU)\b(the|der|que)\b")).cast("bigint").alias("n_hits"),
        tx.alt_satisfied(text, "(?iu)ent", "(?iu)on").alias("alt_ok"),
    )


@query(
    "pipe_tables",
    v.ctes(
        v.V_LINES,
        body="""
SELECT l_orderkey AS doc_id, l_suppkey AS table_no, CAST(l_partkey * 10 + l_linenumber AS BIGINT) AS row_no,
  '| ' || l_returnflag || ' | ' || CAST(l_linenumber AS VARCHAR) || ' pcs | |' AS line
FROM v_lines
UNION ALL SELECT l_orderkey, l_suppkey, min(l_partkey * 10 + l_linenumber) - 1, '[TABLE ' || l_suppkey || ']'
FROM v_lines GROUP BY 1, 2
UNION ALL SELECT l_orderkey, l_suppkey, max(l_partkey * 10 + l_linenumber) + 1, '[/TABLE ' || l_suppkey || ']'
FROM v_lines GROUP BY 1, 2
""",
    ),
)
def pipe_tables(t: Tables) -> DataFrame:
    """Latest lines as table rows: one table per (order, supplier)."""
    cells = F.array(
        F.concat(F.lit("  "), "l_returnflag"), F.concat(F.col("l_linenumber").cast("string"), F.lit(" \t pcs")), F.lit(None).cast("string")
    )
    rows = v.lines(t).select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_suppkey").alias("table_no"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("row_no"),
        cells.alias("cells"),
    )
    return sg.tables_to_pipe(rows).withColumn("line", F.regexp_replace("line", r"\|  \|$", "| |"))


ATTACH = """
v_attach AS (
  SELECT l_orderkey AS case_id, CAST(max(l_quantity) AS INTEGER) AS words FROM lineitem GROUP BY l_orderkey)
"""


def _attachments(t: Tables) -> DataFrame:
    most = t.lineitem.groupBy("l_orderkey").agg(F.max("l_quantity").cast("int").alias("words"))
    return most.select(
        F.col("l_orderkey").alias("case_id"), F.lit(" Receipt ").alias("name"), F.concat(F.lit("\r\n"), F.repeat(F.lit("paid "), F.col("words"))).alias("text")
    )


@query(
    "attach_documents",
    v.ctes(
        v.V_CASES,
        ATTACH,
        body="""
SELECT c.case_id, CASE WHEN (a.words >= 10 OR c.case_id % 3 = 0) AND a.words IS NOT NULL AND c.status <> 'signed' THEN 'new' ELSE c.status END AS status,
  CASE WHEN (a.words >= 10 OR c.case_id % 3 = 0) AND a.words IS NOT NULL AND c.status <> 'signed' THEN NULL ELSE c.officer END AS officer,
  'form of ' || c.applicant
    || CASE WHEN a.words IS NOT NULL AND c.case_id % 3 = 0 AND c.status <> 'signed' THEN chr(10) || chr(10)
    || '=== DOCUMENT: Annex ===' || chr(10) || chr(10) || trim(repeat('due ', a.words + 10)) ELSE '' END
    || CASE WHEN a.words >= 10 AND c.status <> 'signed' THEN chr(10) || chr(10)
    || '=== DOCUMENT: Receipt ===' || chr(10) || chr(10) || trim(repeat('paid ', a.words)) ELSE '' END AS text
FROM v_cases c LEFT JOIN v_attach a ON a.case_id = c.case_id
""",
    ),
)
def attach_documents(t: Tables) -> DataFrame:
    cases = v.cases(t).withColumn("text", F.concat(F.lit("form of "), "applicant"))
    receipts = _attachments(t)
    annexes = receipts.filter("case_id % 3 = 0").select(
        "case_id", F.lit("Annex").alias("name"), F.regexp_replace(F.concat("text", F.repeat(F.lit("paid "), F.lit(10))), "paid", "due").alias("text")
    )
    both = receipts.withColumn("ord", F.lit(2)).unionByName(annexes.withColumn("ord", F.lit(1)))
    merged, _, _ = sg.attach_documents(cases, v.verdicts(t), both)
    return merged.select("case_id", "status", "officer", "text")


@query(
    "attachments_refused",
    v.ctes(
        v.V_CASES,
        ATTACH,
        body="""
SELECT a.case_id, 'Receipt' AS name, CASE WHEN c.status IS NULL THEN 'unknown_case' WHEN c.status = 'signed' THEN 'signed'
  ELSE 'too_short' END AS reason
FROM v_attach a LEFT JOIN v_cases c ON a.case_id = c.case_id
WHERE c.status IS NULL OR c.status = 'signed' OR a.words < 10
""",
    ),
)
def attachments_refused(t: Tables) -> DataFrame:
    cases = v.cases(t).withColumn("text", F.lit("form"))
    _, _, refused = sg.attach_documents(cases, v.verdicts(t), _attachments(t))
    return refused.withColumn("name", F.trim("name"))


# --- normalisation -------------------------------------------------------------------------------
@query(
    "name_norm_sorted",
    """
WITH n AS (SELECT p_name || ', ' || p_type AS name FROM part UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier
  UNION SELECT array_to_string(string_split(text, ' ')[1:3], ' ') FROM documents),
k AS (SELECT name, trim(regexp_replace(upper(strip_accents(replace(name, 'ß', 'ss'))), '[^A-Z0-9]+', ' ', 'g')) AS norm FROM n)
SELECT name, norm, array_to_string(list_sort(string_split(norm, ' ')), ' ') AS sorted FROM k
""",
)
def name_norm_sorted(t: Tables) -> DataFrame:
    head = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    names = (
        t.spread("part").select(F.concat("p_name", F.lit(", "), "p_type").alias("name"))
        .union(t.customer.select("c_name"))
        .union(t.supplier.select("s_name"))
        .union(t.spread("documents").select(head))
        .distinct()
    )
    return names.withColumn("norm", tx.name_norm("name")).withColumn("sorted", tx.token_sort("norm"))


@query(
    "guard_text",
    """
SELECT o_orderkey AS case_id, 'It''s paid: $' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' - and $'
  || CAST(o_custkey AS VARCHAR) || ' or $' || CAST(o_orderkey + 10 AS VARCHAR) || '. Not owned.' AS text FROM orders
""",
)
def guard_text(t: Tables) -> DataFrame:
    raw = F.concat(
        F.lit("It’s  **paid**: A$ "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" — and AUD "), "o_custkey",
        F.lit(" or "), F.col("o_orderkey") + 10, F.lit(" Australian dollars. `Not`\towned."),
    )
    return t.orders.select(F.col("o_orderkey").alias("case_id"), tx.guard_norm(raw).alias("text"))


@query(
    "compare_text",
    """
SELECT conv_id, turn, rtrim(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '.') AS text FROM conversations
""",
)
def compare_text(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit('"'), "text", F.lit('" '))
    return t.spread("conversations").select("conv_id", "turn", F.regexp_replace(tx.cmp_norm(quoted), r"\.+$", "").alias("text"))


@query(
    "words_and_limits",
    """
SELECT doc_id, CAST(len(string_split_regex(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+')) AS BIGINT) AS n_words,
  len(string_split_regex(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+')) >= 40 AS accepted,
  CASE WHEN len(string_split_regex(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+')) > 45
    THEN array_to_string(string_split_regex(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+')[1:45], ' ') || ' ...'
    ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS short
FROM documents
""",
)
def words_and_limits(t: Tables) -> DataFrame:
    got = intake_text(t.spread("documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "accepted", tx.first_words("text", 45).alias("short"))


@query(
    "verbatim_contains",
    """
WITH k AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM conversations)
SELECT a.conv_id, a.turn, contains(b.n, array_to_string(string_split(a.n, ' ')[1:2], ' ')) AS found
FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
""",
)
def verbatim_contains(t: Tables) -> DataFrame:
    """Does each turn repeat the first two words of the turn before it?"""
    c = t.conversations
    phrase = c.select("conv_id", "turn", F.array_join(F.slice(tx.words("text"), 1, 2), "\n").alias("phrase"))
    answer = c.select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return phrase.join(answer, ["conv_id", "turn"]).select("conv_id", "turn", tx.contains_norm("text", "phrase").alias("found"))


@query(
    "contexts",
    r"""
WITH d AS (SELECT doc_id, text, strpos(text, 'en') AS p FROM documents)
SELECT doc_id, trim(regexp_replace(substr(text, greatest(p - 56, 0) + 1, p + 56 - greatest(p - 56, 0)),
  '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS context FROM d WHERE p > 0
""",
)
def contexts(t: Tables) -> DataFrame:
    """The text around the first place of a syllable in every document that holds it."""
    at = F.col("at")
    found = t.spread("documents").select("doc_id", "text", (F.locate("en", "text") - 1).alias("at")).filter(at >= 0)
    return found.select("doc_id", tx.context("text", at, at + 2).alias("context"))
