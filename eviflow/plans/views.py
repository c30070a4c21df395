"""Case, verdict, rule, name, audit and dossier tables derived from the star-schema tables, in Spark and in SQL.

Each ``V_*`` string is one common table expression equal to the function of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow.operators.common import latest_by_key
from eviflow.plans.registry import Tables

AS_OF = "2001-06-30"


def ctes(*views: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(v.strip() for v in views) + "\n" + body.strip()


# --- cases and verdicts --------------------------------------------------------------------------
def cases(t: Tables) -> DataFrame:
    """Orders as cases."""
    signed = F.col("o_orderstatus") == "F"
    opened = F.col("o_orderdate").cast("timestamp_ntz")
    seconds = F.make_interval(secs=F.col("o_orderkey") % 600)
    return t.orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.format_string("Customer#%09d", "o_custkey").alias("applicant"),
        F.concat(F.lit("org "), F.col("o_custkey") % 11).alias("org"),
        F.when(signed, "signed").when(F.col("o_orderstatus") == "P", "in_review").otherwise("assessed").alias("status"),
        F.concat(F.lit("officer "), F.col("o_custkey") % 7).alias("officer"),
        opened.alias("review_started_at"),
        F.when(signed, opened + seconds).alias("signed_at"),
        F.concat(F.lit("R"), F.col("o_custkey") % 7 + 1).alias("spot_rule"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.substring("o_orderpriority", 1, 1)).alias("spot_answer"),
        F.when(F.col("o_totalprice") > 250000, "2").otherwise("3").alias("spot_ai"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Hugo Brandt").alias("countersigned_by"),
        F.when(F.col("o_totalprice") > 400000, "fund-a").when(F.col("o_totalprice") > 100000, "fund-b").alias("ruleset_id"),
    )


V_CASES = """
v_cases AS (
  SELECT o_orderkey AS case_id,
    'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS applicant,
    'org ' || CAST(o_custkey % 11 AS VARCHAR) AS org,
    CASE o_orderstatus WHEN 'F' THEN 'signed' WHEN 'P' THEN 'in_review' ELSE 'assessed' END AS status,
    'officer ' || CAST(o_custkey % 7 AS VARCHAR) AS officer,
    o_orderdate AS review_started_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 600) END AS signed_at,
    'R' || CAST(o_custkey % 7 + 1 AS VARCHAR) AS spot_rule,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN substr(o_orderpriority, 1, 1) END AS spot_answer,
    CASE WHEN o_totalprice > 250000 THEN '2' ELSE '3' END AS spot_ai,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'Hugo Brandt' END AS countersigned_by,
    CASE WHEN o_totalprice > 400000 THEN 'fund-a' WHEN o_totalprice > 100000 THEN 'fund-b' END AS ruleset_id
  FROM orders)
"""

LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_ORDER = [
    "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]


def lines(t: Tables) -> DataFrame:
    """Latest line per (order, line number)."""
    return latest_by_key(t.lineitem, LINE_KEYS, LINE_ORDER)


V_LINES = """
v_lines AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
      l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_discount DESC, l_tax DESC,
      l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1)
"""


def verdicts(t: Tables) -> DataFrame:
    """Latest lines as verdicts."""
    ai = F.when(F.col("l_returnflag") == "A", "met").when(F.col("l_returnflag") == "N", "unclear").otherwise("not_met")
    done = F.col("l_linestatus") == "F"
    final = F.when(done, F.when(F.col("l_discount") >= 0.08, "met").otherwise(ai))
    return lines(t).select(
        F.col("l_orderkey").alias("case_id"),
        F.concat(F.lit("R"), "l_linenumber").alias("rule_id"),
        ai.alias("ai_verdict"),
        F.when(F.col("l_tax") >= 0.06, "low").when(F.col("l_tax") >= 0.03, "medium").otherwise("high").alias("ai_confidence"),
        F.when(F.col("l_quantity") < 17, "code-guarded")
        .when(F.col("l_quantity") < 34, "needs-manual-guard")
        .otherwise("llm-only")
        .alias("guard_level"),
        F.when(F.col("l_tax") == 0, "").otherwise(F.concat(F.lit("part "), "l_partkey", F.lit(" is listed."))).alias("aq"),
        (F.col("l_discount") < 0.09).alias("cite_ok"),
        F.when(F.col("l_discount") == 0.1, "[SUSPECTED FALSE PASS] figure").otherwise("plain").alias("note"),
        final.alias("final_verdict"),
        F.when(done, F.when(F.col("l_discount") < 0.05, "").otherwise(F.concat(F.lit("Checked  part "), "l_partkey"))).alias(
            "officer_reason"
        ),
        F.when(done, F.concat(F.lit("officer "), F.col("l_suppkey") % 7)).alias("confirmed_by"),
        F.when(done, F.col("l_shipdate").cast("timestamp_ntz")).alias("confirmed_at"),
        "l_partkey",
        "l_tax",
    )


V_VERDICTS = V_LINES.strip() + """,
v_verdicts0 AS (
  SELECT *, CASE l_returnflag WHEN 'A' THEN 'met' WHEN 'N' THEN 'unclear' ELSE 'not_met' END AS ai FROM v_lines),
v_verdicts AS (
  SELECT l_orderkey AS case_id, 'R' || CAST(l_linenumber AS VARCHAR) AS rule_id, ai AS ai_verdict,
    CASE WHEN l_tax >= 0.06 THEN 'low' WHEN l_tax >= 0.03 THEN 'medium' ELSE 'high' END AS ai_confidence,
    CASE WHEN l_quantity < 17 THEN 'code-guarded' WHEN l_quantity < 34 THEN 'needs-manual-guard'
      ELSE 'llm-only' END AS guard_level,
    CASE WHEN l_tax = 0 THEN '' ELSE 'part ' || CAST(l_partkey AS VARCHAR) || ' is listed.' END AS aq,
    l_discount < 0.09 AS cite_ok,
    CASE WHEN l_discount = 0.1 THEN '[SUSPECTED FALSE PASS] figure' ELSE 'plain' END AS note,
    CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_discount >= 0.08 THEN 'met' ELSE ai END END AS final_verdict,
    CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_discount < 0.05 THEN ''
      ELSE 'Checked  part ' || CAST(l_partkey AS VARCHAR) END END AS officer_reason,
    CASE WHEN l_linestatus = 'F' THEN 'officer ' || CAST(l_suppkey % 7 AS VARCHAR) END AS confirmed_by,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS confirmed_at,
    l_partkey, l_tax
  FROM v_verdicts0)
"""


def post_audits(t: Tables) -> DataFrame:
    """Post-audit records: every latest line taxed at 7 percent or more."""
    return lines(t).filter("l_tax >= 0.07").select(
        F.col("l_orderkey").alias("case_id"),
        F.concat(F.lit("R"), "l_linenumber").alias("rule_id"),
        F.concat(F.lit("officer "), F.col("l_suppkey") % 5).alias("auditor"),
        F.when(F.col("l_quantity") > 40, "disagree").otherwise("agree").alias("outcome"),
        F.when(F.col("l_quantity") > 45, "wrong quotation").otherwise("").alias("note"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("audited_at"),
    )


V_POST = """
v_post AS (
  SELECT l_orderkey AS case_id, 'R' || CAST(l_linenumber AS VARCHAR) AS rule_id,
    'officer ' || CAST(l_suppkey % 5 AS VARCHAR) AS auditor,
    CASE WHEN l_quantity > 40 THEN 'disagree' ELSE 'agree' END AS outcome,
    CASE WHEN l_quantity > 45 THEN 'wrong quotation' ELSE '' END AS note, l_shipdate AS audited_at
  FROM v_lines WHERE l_tax >= 0.07)
"""


# --- dossiers with figures -----------------------------------------------------------------------
def _money(col: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(col, 0))


def money_figures(t: Tables) -> DataFrame:
    """Declared and attached totals per order, in whole dollars; small line totals repeat the declared one."""
    attached = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.floor("l_extendedprice")).alias("lines"))
    declared = F.floor("o_totalprice")
    joined = t.spread("orders").join(attached, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_custkey").alias("custkey"),
        declared.alias("declared"),
        F.when(F.col("lines") < 100000, declared).otherwise(F.col("lines")).alias("attached"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.floor(F.col("o_totalprice") * 3)).alias("revenue"),
        F.year("o_orderdate").alias("year"),
        (F.year("o_orderdate") + F.when(F.col("o_orderstatus") == "O", -1).otherwise(1)).alias("end_year"),
        (F.year("o_orderdate") - F.when(F.col("o_orderpriority") == "2-HIGH", 9).otherwise(10)).alias("phd_year"),
        (F.col("o_custkey") % 20 + 1).alias("pages"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "BIO").otherwise("CISE").alias("directorate"),
    )


V_MONEY = """
v_money AS (
  SELECT o_orderkey AS case_id, o_custkey AS custkey, CAST(floor(o_totalprice) AS BIGINT) AS declared,
    CASE WHEN lines < 100000 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE lines END AS attached,
    CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(floor(o_totalprice * 3) AS BIGINT) END AS revenue,
    year(o_orderdate) AS year,
    year(o_orderdate) + CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END AS end_year,
    year(o_orderdate) - CASE WHEN o_orderpriority = '2-HIGH' THEN 9 ELSE 10 END AS phd_year,
    o_custkey % 20 + 1 AS pages,
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'BIO' ELSE 'CISE' END AS directorate
  FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS lines
    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)
"""


def money_dossiers(t: Tables) -> DataFrame:
    """Dossier texts that state the figures of :func:`money_figures`."""
    main = F.concat(
        F.lit("APPLICATION "), "case_id", F.lit("\n\nThe lead earned a Ph.D. in "), F.col("year") - 10,
        F.lit(". The Project Description has "), "pages",
        F.lit(" pages.\n\nThe applicant asks for support. The total requested budget is "), _money(F.col("declared")),
        F.lit(" over two years."),
        F.coalesce(
            F.concat(
                F.lit(" The work is planned with two partners and will be reported to the office every quarter. "
                      "Annual turnover was "),
                _money(F.col("revenue")), F.lit("."),
            ),
            F.lit(""),
        ),
    )
    plan = F.concat(
        F.lit("\n\n=== DOCUMENT: Cost plan ===\n\nItems are listed below.\n[TABLE 1]\n| Item | Cost |\n| Grand total | "),
        _money(F.col("attached")),
        F.lit(" |\n[/TABLE 1]\nWork started in "), "year", F.lit(" and ended in "), "end_year",
        F.lit(". The letter has "), "pages", F.lit(" pages. A report is due on 15/03/"), F.col("year") + 2,
        F.lit(". The lead holds a PhD since "), "phd_year", F.lit("."),
    )
    return money_figures(t).select(
        "case_id", "custkey", "directorate", F.concat(main, F.coalesce(plan, F.lit(""))).alias("text")
    )


V_MONEY_TEXT = """
v_money_text AS (
  SELECT *, 'APPLICATION ' || case_id || chr(10) || chr(10) || 'The lead earned a Ph.D. in ' || (year - 10)
    || '. The Project Description has ' || pages || ' pages.' || chr(10) || chr(10)
    || 'The applicant asks for support. The total requested budget is $' || format('{:,}', declared)
    || ' over two years.'
    || coalesce(' The work is planned with two partners and will be reported to the office every quarter. Annual turnover was $'
      || format('{:,}', revenue) || '.', '') AS main,
  'Items are listed below.' || chr(10) || '[TABLE 1]' || chr(10) || '| Item | Cost |' || chr(10)
    || '| Grand total | $' || format('{:,}', attached) || ' |' || chr(10) || '[/TABLE 1]' || chr(10)
    || 'Work started in ' || year || ' and ended in ' || end_year || '. The letter has ' || pages
    || ' pages. A report is due on 15/03/' || (year + 2) || '. The lead holds a PhD since ' || phd_year || '.' AS plan
  FROM v_money)
"""


# --- evaluation ----------------------------------------------------------------------------------
def predictions(t: Tables) -> DataFrame:
    """Predicted verdict per document, from its length and language."""
    verdict = (
        F.when(F.col("n_chars") < 400, "unclear").when(F.col("n_chars") < 2500, "met").otherwise("not_met")
    )
    return t.documents.select(
        F.col("source").alias("case_id"),
        F.concat(F.lit("D"), "doc_id").alias("rule_id"),
        verdict.alias("pred"),
        F.when(F.col("lang") == "en", "high").when(F.col("lang") == "fr", "medium").otherwise("low").alias("confidence"),
        F.when(F.col("n_chars") > 1000, F.substring("text", 1, 20)).otherwise("").alias("aq"),
        (F.col("lang") != "de").alias("cite_ok"),
    )


def truths(t: Tables) -> DataFrame:
    """Labels of the labelled documents."""
    joined = t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    return joined.select(
        F.col("source").alias("case_id"),
        F.concat(F.lit("D"), "doc_id").alias("rule_id"),
        F.when(F.col("quality") == 1, "met").otherwise("not_met").alias("truth"),
        F.when(F.col("toxic") == 1, "quantitative").otherwise("qualitative").alias("type"),
    )


V_PRED = """
v_pred AS (
  SELECT source AS case_id, 'D' || CAST(doc_id AS VARCHAR) AS rule_id,
    CASE WHEN n_chars < 400 THEN 'unclear' WHEN n_chars < 2500 THEN 'met' ELSE 'not_met' END AS pred,
    CASE lang WHEN 'en' THEN 'high' WHEN 'fr' THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN n_chars > 1000 THEN substr(text, 1, 20) ELSE '' END AS aq, lang <> 'de' AS cite_ok
  FROM documents),
v_truth AS (
  SELECT source AS case_id, 'D' || CAST(d.doc_id AS VARCHAR) AS rule_id,
    CASE WHEN quality = 1 THEN 'met' ELSE 'not_met' END AS truth,
    CASE WHEN toxic = 1 THEN 'quantitative' ELSE 'qualitative' END AS type
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


# --- audit log -----------------------------------------------------------------------------------
def audit_rows(t: Tables) -> DataFrame:
    """Events as audit rows, one chain per user."""
    return t.events.select(
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.concat(F.lit("U"), "user_id").alias("case_id"),
        F.col("event_type").alias("actor"),
        F.when(F.col("value") > 10, "system").alias("role"),
        F.concat(F.lit("did "), "event_type").alias("action"),
        F.col("props").alias("detail"),
    )


V_AUDIT = """
v_audit AS (
  SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, 'U' || CAST(user_id AS VARCHAR) AS case_id,
    event_type AS actor, CASE WHEN value > 10 THEN 'system' END AS role, 'did ' || event_type AS action,
    props AS detail
  FROM events)
"""
