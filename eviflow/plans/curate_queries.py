"""Queries over test-set curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.operators import curate as cu
from eviflow.operators.common import cut
from eviflow.plans import views as v
from eviflow.plans.registry import Tables, query, work_folder


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


COMMENT = "This meets all criteria."


def _texts(t: Tables) -> DataFrame:
    """Documents as generated texts of their language; French ones comment on the rules, Spanish ones keep a marker."""
    tail = F.when(F.col("lang") == "fr", " Fin. " + COMMENT).when(F.col("lang") == "es", " [[FACT]] ").otherwise("")
    return t.spread("documents").select(F.col("lang").alias("ruleset_id"), F.col("doc_id").alias("case_id"), F.concat("text", tail).alias("text"))


def _rules(t: Tables) -> DataFrame:
    """First words of the benchmark passages as rule ids of the English set."""
    first = t.benchmark.select(F.regexp_extract("text", r"^[A-Za-z]+", 0).alias("rule_id")).filter("rule_id <> ''").distinct()
    return first.select(F.lit("en").alias("ruleset_id"), "rule_id")


TEXTS = f"""
v_text AS (SELECT lang AS ruleset_id, doc_id AS case_id, text || CASE lang WHEN 'fr' THEN ' Fin. {COMMENT}' WHEN 'es' THEN ' [[FACT]] ' ELSE '' END AS text FROM documents),
v_rid AS (SELECT DISTINCT 'en' AS ruleset_id, regexp_extract(text, '^[A-Za-z]+') AS rule_id FROM benchmark WHERE regexp_extract(text, '^[A-Za-z]+') <> ''),
v_leak AS (SELECT t.ruleset_id, t.case_id, coalesce(n, 0) AS n_ids, first_id, nullif(regexp_extract(text, '{_re(fv.RULE_COMMENTARY.replace("(?iu)", "(?i)"))}'), '') AS comment,
  contains(text, '[[FACT]]') AS marker_left
  FROM v_text t LEFT JOIN (SELECT w.case_id, count(*) AS n, min(r.rule_id) AS first_id FROM
    (SELECT DISTINCT ruleset_id, case_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS w FROM v_text) w
    JOIN v_rid r ON r.ruleset_id = w.ruleset_id AND r.rule_id = w.w GROUP BY 1) k ON k.case_id = t.case_id)
"""


@query("leak_problems", v.ctes(TEXTS, body="SELECT * FROM v_leak WHERE n_ids > 0 OR comment IS NOT NULL OR marker_left"))
def leak_problems(t: Tables) -> DataFrame:
    return cu.leak_problems(_texts(t), _rules(t))


@query(
    "doc_problems",
    f"""
WITH k AS (SELECT doc_id, len(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS n_words,
  list_sort(list_distinct(list_transform(regexp_extract_all(CASE WHEN source = 'src3' THEN 'Okay, let me write. ' ELSE '' END || text, '{_re(fv.MODEL_MONOLOGUE.replace("(?imu)", "(?im)"))}'), lambda s: lower(trim(s))))) AS ph FROM documents)
SELECT doc_id, array_to_string(ph[1:4], ', ') AS phrases, CAST(CASE WHEN doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3') THEN n_words + 4 ELSE n_words END AS BIGINT) AS n_words,
  CASE WHEN doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3') THEN n_words + 4 ELSE n_words END NOT BETWEEN 120 AND 520 AS abnormal_length FROM k
WHERE len(ph) > 0 OR CASE WHEN doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3') THEN n_words + 4 ELSE n_words END NOT BETWEEN 120 AND 520
""",
)
def doc_problems(t: Tables) -> DataFrame:
    talk = F.when(F.col("source") == "src3", "Okay, let me write. ").otherwise("")
    return cu.doc_problems(t.spread("documents").select("doc_id", F.concat(talk, F.col("text")).alias("text")))


@query(
    "insert_fact",
    """
WITH k AS (SELECT doc_id, 'Farm ' || doc_id || ' has no stock.' AS fact, text, position(chr(10) IN text) AS p FROM documents)
SELECT doc_id, CASE WHEN p > 0 THEN 'marker' ELSE 'appended' END AS placement, regexp_replace(CASE WHEN p > 0
  THEN substr(text, 1, p - 1) || fact || replace(substr(text, p + 1), chr(10), '') ELSE rtrim(text) || chr(10) || chr(10) || 'Additional Details' || chr(10) || fact END,
  '[ \\t]{2,}', ' ', 'g') AS text FROM k
""",
)
def insert_fact(t: Tables) -> DataFrame:
    """Line breaks become markers, and the last one a copy of the fact."""
    fact = F.concat(F.lit("Farm "), "doc_id", F.lit(" has no stock."))
    df = t.spread("documents").select("doc_id", fact.alias("fact"), F.replace("text", F.lit("\n"), F.lit("[[FACT]]")).alias("text"))
    return cu.insert_fact(df).select("doc_id", "placement", "text")


def _repaired(t: Tables) -> DataFrame:
    fact = F.when(F.col("case_id") < 300, COMMENT)
    return cu.repair_meta(_texts(t).withColumn("fact", fact), _rules(t).filter("false"))


REPAIRED = f"""
v_lines0 AS (SELECT ruleset_id, case_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM v_text),
v_line1 AS (SELECT *, list_transform(string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s) AS ss FROM v_lines0),
v_rep AS (SELECT ruleset_id, case_id, string_agg(regexp_replace(array_to_string(list_filter(ss, lambda s: NOT (ruleset_id = 'fr' AND case_id >= 300 AND s = '{COMMENT}')), ' '), '\\s+$', ''), chr(10) ORDER BY i) AS text,
  CASE WHEN ruleset_id = 'fr' AND case_id >= 300 THEN 1 ELSE 0 END AS n_removed FROM v_line1 GROUP BY 1, 2)
"""


@query("repair_meta", v.ctes(TEXTS, REPAIRED, body="SELECT * FROM v_rep"))
def repair_meta(t: Tables) -> DataFrame:
    """Comments are cut out of the French texts, unless the comment is the fact to keep."""
    return _repaired(t).select("ruleset_id", "case_id", "text", F.size("removed").alias("n_removed"))


@query(
    "gate_texts",
    v.ctes(
        TEXTS,
        body="""
SELECT t.ruleset_id, t.case_id, CASE WHEN t.case_id < 300 AND t.ruleset_id <> 'fr' THEN 'fact_missing' WHEN l.n_ids > 0 THEN 'leak'
  WHEN t.ruleset_id = 'fr' AND t.case_id < 300 THEN 'leak' END AS problem FROM v_text t JOIN v_leak l ON l.case_id = t.case_id
""",
    ),
)
def gate_texts(t: Tables) -> DataFrame:
    return cu.gate_texts(_repaired(t), _rules(t)).select("ruleset_id", "case_id", "problem")


# --- votes, labels and edits from verdict rows ---------------------------------------------------
def _sheet(t: Tables) -> DataFrame:
    segment = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("case_id"), F.col("c_mktsegment").alias("ruleset_id"),
        F.when(F.col("o_orderpriority") != "1-URGENT", "R1").alias("target"),
    )
    lines = v.lines(t).select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("R"), "l_linenumber").alias("rule_id"), "l_quantity", "l_tax", "l_discount", "l_partkey",
    )
    return lines.join(segment, "case_id")


SHEET = v.V_LINES.strip() + """,
v_sheet AS (SELECT c_mktsegment AS ruleset_id, l_orderkey AS case_id, 'R' || l_linenumber AS rule_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'R1' END AS target,
  l_quantity, l_tax, l_discount, l_partkey FROM v_lines JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
v_votes AS (SELECT *, CASE WHEN l_quantity < 20 THEN 'yes' WHEN l_quantity < 35 THEN 'no' WHEN l_quantity < 45 THEN 'unclear' ELSE 'error' END AS v1,
  CASE WHEN l_tax < 0.03 THEN 'yes' WHEN l_tax < 0.06 THEN 'no' ELSE 'unclear' END AS v2 FROM v_sheet),
v_class AS (SELECT ruleset_id, case_id, rule_id, CASE WHEN l_discount = 0.1 THEN 'weak' WHEN v1 = 'yes' AND v2 = 'yes' THEN 'ok' WHEN v1 = 'yes' OR v2 = 'yes' THEN 'disagree' ELSE 'weak' END AS label_class FROM v_votes)
"""


def _votes(t: Tables) -> DataFrame:
    q, tax = F.col("l_quantity"), F.col("l_tax")
    raw = _sheet(t).withColumn("answer", F.when(q < 20, "yes").when(q < 35, "no").when(q < 45, "unclear")).withColumn(
        "answer_violation", F.when(tax < 0.03, "no").when(tax < 0.06, "yes").otherwise("unclear")
    )
    return cu.map_votes(raw)


@query("map_votes", v.ctes(SHEET, body="SELECT case_id, rule_id, v1 || ',' || v2 AS votes FROM v_votes"))
def map_votes(t: Tables) -> DataFrame:
    return _votes(t).select("case_id", "rule_id", F.array_join("votes", ",").alias("votes"))


def _classes_of(votes: DataFrame) -> DataFrame:
    return cu.classify_labels(votes, votes.filter("l_discount = 0.1"))


@query("classify_labels", v.ctes(SHEET, body="SELECT * FROM v_class"))
def classify_labels(t: Tables) -> DataFrame:
    return _classes_of(_votes(t))


def _label_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every case is labelled against the seven line numbers."""
    # The sheet with its votes is read five times, so it is made once.
    sheet = cut(_votes(t).select("ruleset_id", "case_id", "rule_id", "target", "votes", "l_discount"), work_folder(t))
    rules = sheet.select("ruleset_id", "rule_id").distinct()
    return cu.label_cases(sheet.select("ruleset_id", "case_id", "target").distinct(), rules, sheet, _classes_of(sheet))


LABELLED = """
v_case AS (SELECT DISTINCT ruleset_id, case_id, target FROM v_sheet),
v_label AS (SELECT c.ruleset_id, c.case_id, r.rule_id, CASE WHEN r.rule_id = c.target THEN 'not_met' ELSE 'met' END AS truth,
  coalesce(r.rule_id IS DISTINCT FROM c.target AND k.label_class = 'weak', false) AS weak, coalesce(c.target IS NULL AND o.v1 = 'yes' AND o.v2 = 'yes', false) AS control,
  r.rule_id = c.target AND o.v1 = 'no' AND o.v2 = 'no' AS clear
  FROM v_case c JOIN (SELECT DISTINCT ruleset_id, rule_id FROM v_sheet) r ON r.ruleset_id = c.ruleset_id
  LEFT JOIN v_class k ON k.case_id = c.case_id AND k.rule_id = r.rule_id LEFT JOIN v_votes o ON o.case_id = c.case_id AND o.rule_id = r.rule_id),
v_case2 AS (SELECT c.*, CASE WHEN target IS NOT NULL THEN coalesce((SELECT bool_or(clear) FROM v_label l WHERE l.case_id = c.case_id), false) END AS target_label_clear FROM v_case c)
"""


@query("label_rows", v.ctes(SHEET, LABELLED, body="SELECT ruleset_id, case_id, rule_id, truth, weak, control FROM v_label"))
def label_rows(t: Tables) -> DataFrame:
    return _label_tables(t)[1]


@query(
    "label_cases",
    v.ctes(
        SHEET, LABELLED,
        body="""
SELECT ruleset_id, case_id, target, target_label_clear, CASE WHEN target IS NOT NULL AND NOT target_label_clear THEN 'needs_review' ELSE 'pending_review' END AS status FROM v_case2
""",
    ),
)
def label_cases(t: Tables) -> DataFrame:
    return _label_tables(t)[0]


@query(
    "guard_crosscheck",
    v.ctes(
        SHEET,
        body="""
SELECT ruleset_id, case_id, count(*) FILTER (WHERE l_discount >= 0.08 AND rule_id IS DISTINCT FROM target) AS n_wrong,
  count(*) FILTER (WHERE l_discount >= 0.08 AND rule_id IS DISTINCT FROM target) = 0 AS clean,
  count(*) FILTER (WHERE l_discount >= 0.08 AND rule_id IS NOT DISTINCT FROM target) > 0 AS target_fired FROM v_sheet GROUP BY 1, 2
""",
    ),
)
def guard_crosscheck(t: Tables) -> DataFrame:
    sheet = _sheet(t)
    decided = sheet.select(
        "ruleset_id", "case_id", "rule_id", F.when(F.col("l_discount") >= 0.08, "flag").when(F.col("l_discount") >= 0.05, "confirm").alias("action")
    )
    return cu.guard_crosscheck(decided, sheet.select("ruleset_id", "case_id", "target").distinct())


@query(
    "select_targets",
    """
WITH r AS (SELECT p_brand AS ruleset_id, p_partkey AS rule_id, p_partkey AS ord, p_brand <> 'Brand#7' AND (p_size > 40 OR p_type = 'PROMO') AS good FROM part),
a AS (SELECT *, row_number() OVER (PARTITION BY ruleset_id ORDER BY ord) AS k FROM r WHERE good)
SELECT ruleset_id, rule_id FROM a WHERE k <= 4
UNION ALL SELECT ruleset_id, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY ruleset_id ORDER BY ord) AS k FROM r WHERE ruleset_id NOT IN (SELECT ruleset_id FROM a)) WHERE k <= 4
""",
)
def select_targets(t: Tables) -> DataFrame:
    rules = t.spread("part").select(F.col("p_brand").alias("ruleset_id"), F.col("p_partkey").alias("rule_id"), F.col("p_partkey").alias("ord"), "p_size", "p_type")
    known = rules.filter("ruleset_id <> 'Brand#7'")
    picked = cu.select_targets(rules, known.filter("p_type = 'PROMO'"), known.filter("p_size > 40"), 4)
    return picked.select("ruleset_id", "rule_id")


# Reviewer edits: events act on the case and rule of the order with their number.
EDITS = """
v_edit AS (SELECT c_mktsegment AS ruleset_id, event_id AS case_id, 'R' || (user_id % 7 + 1) AS rule_id, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'dispute' WHEN 'view' THEN 'confirm_target' WHEN 'error' THEN 'flag_weak' ELSE 'confirm_control' END AS action,
  'reviewer ' || (user_id % 3) AS "by" FROM events JOIN orders ON o_orderkey = event_id JOIN customer ON c_custkey = o_custkey)
"""


def _edits(t: Tables) -> DataFrame:
    action = (
        F.when(F.col("event_type") == "click", "dispute").when(F.col("event_type") == "view", "confirm_target")
        .when(F.col("event_type") == "error", "flag_weak").otherwise("confirm_control")
    )
    joined = t.events.join(t.orders, F.col("event_id") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("c_mktsegment").alias("ruleset_id"), F.col("event_id").alias("case_id"), F.concat(F.lit("R"), F.col("user_id") % 7 + 1).alias("rule_id"),
        F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("reviewer "), F.col("user_id") % 3).alias("by"),
    )


@query(
    "edited_cases",
    v.ctes(
        SHEET, LABELLED, EDITS,
        body="""
SELECT c.ruleset_id, c.case_id, c.target, coalesce(c.target_label_clear, false) OR (e.action = 'confirm_target' AND c.target IS NOT NULL) IS TRUE AS target_label_clear,
  CASE WHEN e.action = 'dispute' THEN 'disputed' WHEN e.action = 'confirm_target' AND c.target IS NOT NULL THEN 'pending_review'
    WHEN target IS NOT NULL AND NOT target_label_clear THEN 'needs_review' ELSE 'pending_review' END AS status
FROM v_case2 c LEFT JOIN v_edit e ON e.case_id = c.case_id
""",
    ),
)
def edited_cases(t: Tables) -> DataFrame:
    cases, labels = _label_tables(t)
    return cu.apply_edits(cases, labels, _edits(t))[0]


@query(
    "edited_labels",
    v.ctes(
        SHEET, LABELLED, EDITS,
        body="""
SELECT l.ruleset_id, l.case_id, l.rule_id, l.truth, l.weak OR coalesce(e.action = 'flag_weak', false) AS weak,
  CASE WHEN e.action = 'flag_weak' THEN false WHEN e.action = 'confirm_control' AND c.target IS NULL THEN true ELSE l.control END AS control
FROM v_label l JOIN v_case c ON c.case_id = l.case_id LEFT JOIN v_edit e ON e.case_id = l.case_id AND e.rule_id = l.rule_id
""",
    ),
)
def edited_labels(t: Tables) -> DataFrame:
    cases, labels = _label_tables(t)
    return cu.apply_edits(cases, labels, _edits(t))[1]


@query(
    "approval_report",
    v.ctes(
        TEXTS,
        """
v_tc AS (SELECT lang AS ruleset_id, doc_id AS case_id, CASE WHEN n_chars > 300 THEN 'T' END AS target,
  CASE WHEN source = 'src1' THEN 'disputed' WHEN source = 'src2' AND lang = 'de' THEN 'needs_review' ELSE 'pending_review' END AS status FROM documents),
v_ask AS (SELECT l.doc_id, d.lang AS ruleset_id, 'reviewer ' || (CASE WHEN quality = 1 THEN 1 ELSE 9 END) AS approver FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
v_open AS (SELECT ruleset_id, count(*) FILTER (WHERE status = 'needs_review') AS n_open, count(*) FILTER (WHERE status <> 'disputed') AS n_live FROM v_tc GROUP BY 1),
v_bad AS (SELECT t.ruleset_id, count(*) AS n_leaky FROM v_tc t JOIN v_leak l ON l.case_id = t.case_id
  WHERE target IS NOT NULL AND status <> 'disputed' AND (n_ids > 0 OR comment IS NOT NULL OR marker_left) GROUP BY 1)""",
        body="""
SELECT DISTINCT a.ruleset_id, a.approver, n_open, coalesce(n_leaky, 0) AS n_leaky, n_live,
  CASE WHEN a.ruleset_id = 'en' AND a.approver = 'reviewer 1' THEN 'approver_is_reviewer' WHEN n_open > 0 THEN 'cases_need_review'
    WHEN coalesce(n_leaky, 0) > 0 THEN 'answers_leak' ELSE 'approved' END AS outcome
FROM v_ask a JOIN v_open o ON o.ruleset_id = a.ruleset_id LEFT JOIN v_bad b ON b.ruleset_id = a.ruleset_id
""",
    ),
)
def approval_report(t: Tables) -> DataFrame:
    cases = t.spread("documents").select(
        F.col("lang").alias("ruleset_id"), F.col("doc_id").alias("case_id"), F.when(F.col("n_chars") > 300, "T").alias("target"),
        F.when(F.col("source") == "src1", "disputed").when((F.col("source") == "src2") & (F.col("lang") == "de"), "needs_review").otherwise("pending_review").alias("status"),
    )
    edits = t.documents.filter("source = 'src1' AND lang = 'en'").select(
        F.col("lang").alias("ruleset_id"), F.col("doc_id").alias("case_id"), F.lit("dispute").alias("action"), F.lit("reviewer 1").alias("by")
    )
    asked = t.labels.join(t.spread("documents").select("doc_id", "lang"), "doc_id").select(
        F.col("lang").alias("ruleset_id"), F.when(F.col("quality") == 1, "reviewer 1").otherwise("reviewer 9").alias("approver")
    ).distinct()
    return cu.approval_report(asked, cases, edits, _texts(t), _rules(t))


@query(
    "confirm_facts",
    v.ctes(
        TEXTS,
        """
v_fact AS (SELECT c.conv_id, c.turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f, role FROM conversations c),
v_hit AS (SELECT *, len(list_intersect(regexp_extract_all(f, '[\\p{L}\\p{M}\\p{N}_]+'), (SELECT list(rule_id) FROM v_rid))) > 0 AS leak FROM v_fact)""",
        body="""
SELECT conv_id::VARCHAR AS case_id, 'T' || turn AS rule_id, CASE WHEN len(string_split(f, ' ')) < 6 THEN 'too_short' WHEN leak THEN 'leak' WHEN role = 'user' THEN 'not_a_violation' END AS problem,
  CASE WHEN len(string_split(f, ' ')) >= 6 AND NOT leak THEN CASE role WHEN 'assistant' THEN 'code' WHEN 'system' THEN 'verifier' END END AS confirmed_by FROM v_hit
""",
    ),
)
def confirm_facts(t: Tables) -> DataFrame:
    """Turns as planted facts: guards fire on the assistant's, the verifiers deny the system's."""
    facts = t.spread("conversations").select(
        F.lit("en").alias("ruleset_id"), F.col("conv_id").cast("string").alias("case_id"), F.concat(F.lit("T"), "turn").alias("rule_id"), F.col("text").alias("fact"), "role",
        F.when(F.col("role") == "system", F.array(F.lit("no"), F.lit("no"))).otherwise(F.array(F.lit("no"), F.lit("unclear"))).alias("votes"),
    )
    hits = facts.filter("role = 'assistant'").select("ruleset_id", "case_id", "rule_id")
    return cu.confirm_facts(facts, _rules(t), hits).select("case_id", "rule_id", "problem", "confirmed_by")


@query(
    "contradiction_gate",
    """
WITH k AS (SELECT conv_id, turn, role, text, split_part(text, ' ', 1) AS fact FROM conversations)
SELECT conv_id, turn, regexp_replace(replace(text, fact, ' '), '[ \\t]{2,}', ' ', 'g') AS rest,
  CASE role WHEN 'system' THEN 'guard_lost' WHEN 'assistant' THEN 'self_contradictory' END AS problem FROM k
""",
)
def contradiction_gate(t: Tables) -> DataFrame:
    df = t.spread("conversations").select(
        "conv_id", "turn", "text", F.substring_index("text", " ", 1).alias("fact"), F.when(F.col("role") == "system", "code").otherwise("verifier").alias("confirmed_by"),
        F.when(F.col("role") == "user", F.array(F.lit("yes"), F.lit("no"))).otherwise(F.array(F.lit("yes"), F.lit("yes"))).alias("rest_votes"), F.lit(False).alias("guard_on_text"),
    )
    return cu.contradiction_gate(df).select("conv_id", "turn", "rest", "problem")
