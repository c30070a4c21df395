"""Queries over review, audit and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.operators import audit as au
from eviflow.operators import evaluate as ev
from eviflow.operators import review as rv
from eviflow.operators.common import cut, latest_by_key
from eviflow.plans import views as v
from eviflow.plans.registry import Tables, query, work_folder
from eviflow.operators.asof import rules_in_force
from eviflow.sources import audit_log
from eviflow.sources.writers import upsert_cases, upsert_verdicts

AUDITOR = "officer 3"
AS_OF = "1999-12-31 12:00:00"


def _view(*views: str, body: str) -> str:
    return v.ctes(*views, body=body)


# --- keyed upserts -------------------------------------------------------------------------------
@query("latest_verdicts", _view(v.V_LINES, body="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax FROM v_lines"))
def latest_verdicts(t: Tables) -> DataFrame:
    return v.lines(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")


@query(
    "upsert_cases",
    """
WITH cur AS (SELECT o_orderkey AS case_id, 'old ' || o_custkey AS applicant, 'text ' || o_orderkey AS text, 'signed' AS status
  FROM orders WHERE o_orderstatus <> 'O'),
chg AS (SELECT l_orderkey AS case_id, max(l_partkey * 100 + l_linenumber) AS last, min(l_partkey * 100 + l_linenumber) AS first
  FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(cur.case_id, chg.case_id) AS case_id,
  CASE WHEN chg.last IS NULL THEN cur.applicant ELSE 'new ' || chg.last END AS applicant,
  CASE WHEN cur.case_id IS NULL THEN 'text ' || chg.first ELSE cur.text END AS text,
  CASE WHEN cur.case_id IS NULL THEN 'new' ELSE cur.status END AS status
FROM cur FULL JOIN chg ON cur.case_id = chg.case_id
""",
)
def upsert_cases_query(t: Tables) -> DataFrame:
    current = t.orders.filter("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("case_id"), F.concat(F.lit("old "), "o_custkey").alias("applicant"),
        F.concat(F.lit("text "), "o_orderkey").alias("text"), F.lit("signed").alias("status"),
    )
    seq = F.col("l_partkey") * 100 + F.col("l_linenumber")
    changes = t.lineitem.select(
        F.col("l_orderkey").alias("case_id"), seq.alias("seq"), F.concat(F.lit("new "), seq).alias("applicant"),
        F.concat(F.lit("text "), seq).alias("text"),
    )
    return upsert_cases(current, changes)


@query(
    "upsert_verdicts",
    _view(
        v.V_VERDICTS,
        body="""
SELECT case_id, rule_id, CASE WHEN l_tax >= 0.05 THEN 'unclear' ELSE ai_verdict END AS ai_verdict,
  CASE WHEN l_tax >= 0.05 THEN NULL ELSE final_verdict END AS final_verdict,
  CASE WHEN l_tax >= 0.05 THEN NULL ELSE confirmed_by END AS confirmed_by FROM v_verdicts
""",
    ),
)
def upsert_verdicts_query(t: Tables) -> DataFrame:
    """Verdicts of the higher tax bands are assessed again."""
    rows = v.verdicts(t)
    current = rows.select("case_id", "rule_id", "ai_verdict", "final_verdict", "confirmed_by")
    changes = rows.filter("l_tax >= 0.05").select(
        "case_id", "rule_id", F.lit("unclear").alias("ai_verdict"), F.col("l_partkey").alias("seq")
    )
    return upsert_verdicts(current, changes)


# --- queue and dashboard -------------------------------------------------------------------------
QUEUE_COUNTS = """
  count(v.case_id) AS n_rules, count(v.confirmed_at) AS n_confirmed,
  count(*) FILTER (WHERE v.ai_verdict = 'not_met') AS ai_not_met,
  count(*) FILTER (WHERE v.ai_verdict IN ('unclear', 'not_addressed')) AS ai_attention,
  count(*) FILTER (WHERE v.final_verdict = 'not_met') AS final_not_met
"""


@query(
    "case_queue",
    _view(
        v.V_CASES, v.V_VERDICTS,
        body=f"SELECT c.case_id, c.applicant, c.status, {QUEUE_COUNTS} FROM v_cases c LEFT JOIN v_verdicts v ON c.case_id = v.case_id GROUP BY 1, 2, 3",
    ),
)
def case_queue(t: Tables) -> DataFrame:
    return rv.case_queue(v.cases(t).select("case_id", "applicant", "status"), v.verdicts(t))


@query("status_counts", _view(v.V_CASES, body="SELECT status, count(*) AS n FROM v_cases GROUP BY 1"))
def status_counts(t: Tables) -> DataFrame:
    return rv.status_counts(v.cases(t))


ELIGIBLE = """
v_eligible AS (
  SELECT v.*, c.applicant FROM v_verdicts v JOIN v_cases c ON v.case_id = c.case_id
  WHERE v.final_verdict = 'met' AND v.guard_level IN ('needs-manual-guard', 'llm-only')
    AND v.confirmed_at IS NOT NULL AND c.signed_at IS NOT NULL)
"""


@query(
    "dashboard",
    _view(
        v.V_CASES, v.V_VERDICTS, v.V_POST, ELIGIBLE,
        body="""
SELECT (SELECT count(*) FROM v_cases) AS cases_total,
  (SELECT count(*) FROM v_verdicts WHERE confirmed_at IS NOT NULL) AS confirmed_verdicts,
  round((SELECT count(*) FROM v_verdicts WHERE confirmed_at IS NOT NULL AND final_verdict <> ai_verdict)::DOUBLE
    / (SELECT count(*) FROM v_verdicts WHERE confirmed_at IS NOT NULL), 6) AS override_rate,
  round((SELECT count(*) FROM v_verdicts WHERE aq <> '' AND cite_ok)::DOUBLE
    / (SELECT count(*) FROM v_verdicts WHERE aq <> ''), 6) AS citation_ok_rate,
  round((SELECT avg(epoch(signed_at) - epoch(review_started_at)) FROM v_cases WHERE signed_at IS NOT NULL), 6) AS avg_review_seconds,
  (SELECT count(*) FROM v_cases WHERE spot_answer IS NOT NULL) AS spot_n,
  (SELECT count(*) FROM v_cases WHERE spot_answer = spot_ai) AS spot_agree,
  (SELECT count(*) FROM v_verdicts WHERE confirmed_at IS NOT NULL AND final_verdict = 'met'
    AND guard_level = 'needs-manual-guard') AS unguarded_met_confirmations,
  (SELECT count(*) FROM v_eligible) AS eligible, (SELECT count(*) FROM v_post) AS audited,
  (SELECT count(*) FROM v_post WHERE outcome = 'disagree') AS disagree,
  round((SELECT count(*) FROM v_post)::DOUBLE / (SELECT count(*) FROM v_eligible), 6) AS coverage
""",
    ),
)
def dashboard(t: Tables) -> DataFrame:
    out = rv.dashboard(v.cases(t), v.verdicts(t), v.post_audits(t))
    rounded = ["override_rate", "citation_ok_rate", "avg_review_seconds", "coverage"]
    return out.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in out.columns])


@query(
    "verdict_summary",
    _view(
        v.V_VERDICTS,
        body="""
SELECT case_id, count(*) FILTER (WHERE ai_verdict = 'met') AS met, count(*) FILTER (WHERE ai_verdict = 'not_met') AS not_met,
  count(*) FILTER (WHERE ai_verdict = 'unclear') AS unclear, count(*) FILTER (WHERE ai_verdict = 'not_addressed') AS not_addressed
FROM v_verdicts GROUP BY case_id
""",
    ),
)
def verdict_summary(t: Tables) -> DataFrame:
    return rv.verdict_summary(v.verdicts(t))


# --- post-audit ----------------------------------------------------------------------------------
CANDIDATES = f"""
v_pool AS (
  SELECT e.case_id, e.rule_id, e.confirmed_by, e.applicant FROM v_eligible e LEFT JOIN v_post p
    ON p.case_id = e.case_id AND p.rule_id = e.rule_id
  WHERE p.case_id IS NULL AND coalesce(e.confirmed_by, '') <> '{AUDITOR}')
"""


def _pool(t: Tables) -> DataFrame:
    return rv.post_audit_candidates(v.cases(t), v.verdicts(t), v.post_audits(t), AUDITOR).select(
        "case_id", "rule_id", "confirmed_by", "applicant"
    )


@query("post_audit_candidates", _view(v.V_CASES, v.V_VERDICTS, v.V_POST, ELIGIBLE, CANDIDATES, body="SELECT * FROM v_pool"))
def post_audit_candidates(t: Tables) -> DataFrame:
    return _pool(t)


@query(
    "post_audit_sample",
    _view(
        v.V_CASES, v.V_VERDICTS, v.V_POST, ELIGIBLE, CANDIDATES,
        body="SELECT * FROM v_pool ORDER BY md5('11|' || case_id || '|' || rule_id), case_id, rule_id LIMIT 50",
    ),
)
def post_audit_sample(t: Tables) -> DataFrame:
    return rv.post_audit_sample(_pool(t), 50, seed=11, by_hash=True)


@query(
    "post_audit_stats",
    _view(
        v.V_CASES, v.V_VERDICTS, v.V_POST, ELIGIBLE,
        body="""
SELECT (SELECT count(*) FROM v_eligible) AS eligible, (SELECT count(*) FROM v_post) AS audited,
  (SELECT count(*) FROM v_post WHERE outcome = 'disagree') AS disagree,
  round((SELECT count(*) FROM v_post)::DOUBLE / (SELECT count(*) FROM v_eligible), 6) AS coverage
""",
    ),
)
def post_audit_stats(t: Tables) -> DataFrame:
    return rv.post_audit_stats(v.cases(t), v.verdicts(t), v.post_audits(t)).withColumn("coverage", F.round("coverage", 6))


@query(
    "post_audit_checks",
    _view(
        v.V_VERDICTS, v.V_POST,
        body="""
SELECT p.case_id, p.rule_id, CASE WHEN v.final_verdict IS NULL OR v.final_verdict <> 'met' THEN 'not_met_confirmation'
  WHEN coalesce(v.confirmed_by, '') = p.auditor THEN 'own_confirmation'
  WHEN p.outcome = 'disagree' AND length(trim(p.note)) < 8 THEN 'reason_too_short' END AS problem
FROM v_post p LEFT JOIN v_verdicts v ON v.case_id = p.case_id AND v.rule_id = p.rule_id
""",
    ),
)
def post_audit_checks(t: Tables) -> DataFrame:
    return rv.validate_post_audit(v.post_audits(t), v.verdicts(t)).select("case_id", "rule_id", "problem")


@query(
    "latest_post_audits",
    _view(
        v.V_LINES, v.V_POST,
        body="""
SELECT case_id, rule_id, auditor, strftime(audited_at, '%Y-%m-%d') AS audited FROM v_post
ORDER BY audited_at DESC, case_id, rule_id LIMIT 100
""",
    ),
)
def latest_post_audits(t: Tables) -> DataFrame:
    newest = rv.latest(v.post_audits(t), [F.desc("audited_at"), F.asc("case_id"), F.asc("rule_id")], 100)
    return newest.select("case_id", "rule_id", "auditor", F.date_format("audited_at", "yyyy-MM-dd").alias("audited"))


@query(
    "latest_audit_events",
    _view(
        v.V_AUDIT,
        body="""
SELECT case_id, seq, actor, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq DESC) AS rank
FROM v_audit) WHERE rank <= 5
""",
    ),
)
def latest_audit_events(t: Tables) -> DataFrame:
    return rv.audit_events_per_case(v.audit_rows(t), 5).select("case_id", "seq", "actor", "rank")


# --- signing -------------------------------------------------------------------------------------
@query(
    "needs_countersign",
    _view(
        v.V_CASES, v.V_VERDICTS,
        body="""
SELECT c.case_id FROM v_cases c WHERE c.status = 'signed' AND c.countersigned_by IS NULL AND EXISTS (
  SELECT 1 FROM v_verdicts v WHERE v.case_id = c.case_id AND (v.final_verdict IS NULL OR v.final_verdict <> 'met'))
""",
    ),
)
def needs_countersign(t: Tables) -> DataFrame:
    return rv.needs_countersign(v.cases(t), v.verdicts(t))


@query(
    "sign_report",
    _view(
        v.V_CASES, v.V_VERDICTS,
        body=f"""
SELECT c.case_id, count(v.case_id) AS n_rules, count(*) FILTER (WHERE v.case_id IS NOT NULL AND v.confirmed_at IS NULL) AS n_missing,
  count(*) FILTER (WHERE v.case_id IS NOT NULL AND v.final_verdict IS DISTINCT FROM v.ai_verdict) AS overrides,
  coalesce(bool_or(v.final_verdict IS DISTINCT FROM 'met') FILTER (WHERE v.case_id IS NOT NULL), false) AS rejection,
  CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(c.review_started_at) AS BIGINT) AS elapsed, count(v.case_id) * 15 AS min_expected,
  epoch(TIMESTAMP '{AS_OF}') - epoch(c.review_started_at) < count(v.case_id) * 15 AS fast,
  count(*) FILTER (WHERE v.case_id IS NOT NULL AND v.confirmed_at IS NULL) = 0 AS ready
FROM v_cases c LEFT JOIN v_verdicts v ON c.case_id = v.case_id WHERE c.status = 'in_review' GROUP BY c.case_id, c.review_started_at
""",
    ),
)
def sign_report(t: Tables) -> DataFrame:
    return rv.sign_report(v.cases(t), v.verdicts(t), AS_OF)


@query(
    "missing_confirmations",
    _view(
        v.V_CASES, v.V_VERDICTS,
        body="""
SELECT v.case_id, v.rule_id FROM v_verdicts v JOIN v_cases c ON c.case_id = v.case_id
WHERE c.status = 'in_review' AND v.confirmed_at IS NULL
""",
    ),
)
def missing_confirmations(t: Tables) -> DataFrame:
    return rv.missing_confirmations(v.cases(t), v.verdicts(t))


REASONS = """
v_conf AS (
  SELECT *, length(typed) AS n, final_verdict = 'met' AND guard_level IN ('needs-manual-guard', 'llm-only') AS attest,
    count(*) OVER (PARTITION BY case_id, typed) AS same
  FROM (SELECT * EXCLUDE (officer_reason), CASE WHEN officer_reason = '' THEN ''
    WHEN l_tax > 0.04 THEN 'here the list has part ' || l_partkey || ' in full'
    ELSE 'here the form lists part ' || l_partkey || ' in full' END AS typed
  FROM v_verdicts WHERE confirmed_at IS NOT NULL))
"""


@query(
    "confirmation_audit",
    _view(
        v.V_VERDICTS, REASONS,
        body="""
SELECT case_id, rule_id, CASE WHEN problem IS NULL AND attest THEN 'officer_quote' END AS attestation, problem
FROM (SELECT *, CASE
  WHEN (final_verdict <> ai_verdict OR ai_verdict = 'unclear' OR final_verdict = 'unclear') AND n < 8 THEN 'reason_required'
  WHEN note LIKE '[SUSPECTED%' AND final_verdict = 'met' AND n < 8 THEN 'guard_reason_required'
  WHEN attest AND n < CASE WHEN guard_level = 'needs-manual-guard' THEN 25 ELSE 15 END THEN 'attestation_too_short'
  WHEN attest AND l_tax > 0.04 THEN 'no_verbatim_quote'
  WHEN attest AND same > 1 THEN 'duplicate_attestation' END AS problem FROM v_conf)
""",
    ),
)
def confirmation_audit(t: Tables) -> DataFrame:
    """Officers type where the form lists the part; those of the higher tax bands do not quote it."""
    typed = F.when(F.col("officer_reason") == "", "").otherwise(
        F.concat(
            F.when(F.col("l_tax") > 0.04, "here the list has part ").otherwise("here the form lists part "),
            "l_partkey",
            F.lit(" in full"),
        )
    )
    texts = v.cases(t).select("case_id", F.lit("Here THE form lists\npart of the goods.").alias("text"))
    # The audit reads the verdicts three times, so the latest lines are found once.
    asked = ["case_id", "rule_id", "ai_verdict", "final_verdict", "note", "guard_level", "aq", "officer_reason", "confirmed_at"]
    rows = cut(v.verdicts(t).withColumn("officer_reason", typed).select(*asked), work_folder(t))
    return rv.confirmation_audit(rows, texts)


@query(
    "duplicate_attestations",
    _view(
        v.V_VERDICTS,
        body="""
SELECT * FROM (SELECT case_id, rule_id, reason_norm, count(*) OVER (PARTITION BY case_id, reason_norm) AS n_same
  FROM (SELECT case_id, rule_id, lower(trim(regexp_replace(coalesce(officer_reason, ''), '\\s+', ' ', 'g'))) AS reason_norm FROM v_verdicts)
  WHERE reason_norm <> '') WHERE n_same > 1
""",
    ),
)
def duplicate_attestations(t: Tables) -> DataFrame:
    return rv.duplicate_attestations(v.verdicts(t))


# --- state machine -------------------------------------------------------------------------------
EVENT_STATES = {"signup": "new", "view": "assessed", "click": "in_review", "purchase": "signed", "error": "letter_drafted"}
_CASE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in EVENT_STATES.items()) + " END"
_ALLOWED_SQL = ", ".join(f"('{a}', '{b}')" for a, b in rv.fv.ALLOWED_TRANSITIONS)


@query(
    "transition_violations",
    f"""
WITH h AS (SELECT user_id AS case_id, event_id AS seq, {_CASE_SQL} AS status, props AS reason FROM events),
l AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY case_id ORDER BY seq), 'new') AS from_status FROM h),
a(from_status, status) AS (VALUES {_ALLOWED_SQL})
SELECT l.case_id, l.seq, l.from_status, l.status,
  CASE WHEN a.status IS NULL THEN 'edge_not_allowed' ELSE 'reason_required' END AS problem
FROM l LEFT JOIN a ON a.from_status = l.from_status AND a.status = l.status
WHERE a.status IS NULL OR (l.from_status IN ('signed', 'letter_drafted', 'letter_approved') AND l.status = 'in_review' AND length(trim(l.reason)) < 8)
""",
)
def transition_violations(t: Tables) -> DataFrame:
    states = F.create_map(*[F.lit(x) for kv in EVENT_STATES.items() for x in kv])
    history = t.events.select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), states[F.col("event_type")].alias("status"),
        F.col("props").alias("reason"),
    )
    return rv.transition_violations(history, rv.state_machine(t.spark))


SLA = {"assessed": 300, "in_review": 500, "signed": 700}


@query(
    "sla_overdue",
    _view(
        v.V_CASES,
        body="""
SELECT *, age_days - limit_days AS overdue_days FROM (
  SELECT case_id, status, CAST(date_diff('day', CAST(review_started_at AS DATE), DATE '2000-01-01') AS BIGINT) AS age_days,
    CAST(CASE status WHEN 'assessed' THEN 300 WHEN 'in_review' THEN 500 ELSE 700 END AS BIGINT) AS limit_days FROM v_cases)
WHERE age_days > limit_days
""",
    ),
)
def sla_overdue(t: Tables) -> DataFrame:
    return rv.sla_overdue(v.cases(t), SLA, "2000-01-01")


@query(
    "supplement_deadlines",
    """
WITH r AS (SELECT user_id AS case_id, event_id AS seq, 'please send ' || event_type AS items,
  CAST(floor(value) AS BIGINT) AS d, CAST(ts AS DATE) AS day FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS round,
  greatest(1, least(CASE WHEN d = 0 THEN 15 ELSE d END, 90)) AS days FROM r)
SELECT case_id, seq, round, items, days, CAST(day + CAST(days AS INTEGER) AS VARCHAR) AS deadline,
  day + CAST(days AS INTEGER) < DATE '2024-01-20' AS overdue FROM k
""",
)
def supplement_deadlines(t: Tables) -> DataFrame:
    requests = t.events.select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"),
        F.concat(F.lit(" please send "), "event_type").alias("items"), F.floor("value").alias("days"),
        F.col("ts").alias("requested_at"),
    )
    got = rv.supplement_deadlines(requests, "2024-01-20")
    return got.withColumn("deadline", F.col("deadline").cast("string"))


# --- rules of a case -----------------------------------------------------------------------------
def _fund_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two funds in two versions each; every part is a rule of one fund, its brand decides the version."""
    rules = t.spread("part").select(
        F.when(F.col("p_size") < 25, "fund-a").otherwise("fund-b").alias("ruleset_id"),
        F.when(F.length("p_brand") == 7, "1").otherwise("2").alias("version"),
        F.col("p_type"),
    ).groupBy("ruleset_id", "version", "p_type").agg(F.count("*").alias("n_parts"))
    sets = rules.select("ruleset_id", "version").distinct().select(
        "*", (F.col("ruleset_id") == "fund-b").alias("is_default"), (F.col("version") == "2").alias("is_current")
    )
    return rules.withColumnRenamed("p_type", "rule_id"), sets


@query(
    "case_rules",
    _view(
        v.V_CASES,
        body="""
SELECT c.case_id, c.ruleset_id, c.version, c.locked, r.rule_id, r.n_parts FROM (
  SELECT case_id, coalesce(ruleset_id, 'fund-b') AS ruleset_id,
    CASE WHEN status = 'signed' THEN '1' ELSE '2' END AS version, status = 'signed' AS locked FROM v_cases) c
JOIN (SELECT CASE WHEN p_size < 25 THEN 'fund-a' ELSE 'fund-b' END AS ruleset_id,
  CASE WHEN length(p_brand) = 7 THEN '1' ELSE '2' END AS version, p_type AS rule_id, count(*) AS n_parts FROM part GROUP BY ALL) r
ON r.ruleset_id = c.ruleset_id AND r.version = c.version
""",
    ),
)
def case_rules(t: Tables) -> DataFrame:
    rules, sets = _fund_tables(t)
    cases = v.cases(t).select("case_id", "ruleset_id", F.when(F.col("status") == "signed", "1").alias("locked_version"))
    return rv.case_rules(cases, rules, sets).select("case_id", "ruleset_id", "version", "locked", "rule_id", "n_parts")


@query(
    "lock_rulesets",
    """
SELECT user_id AS case_id, arg_min(event_type, event_id) AS ruleset_id, arg_min(props, event_id) AS locked_version
FROM events GROUP BY user_id
""",
)
def lock_rulesets(t: Tables) -> DataFrame:
    runs = t.events.select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("ruleset_id"), F.col("props").alias("version"),
        F.col("event_id").alias("assessed_at"),
    )
    return rv.lock_rulesets(runs)


# --- blind view, spot-checks, voiding, letters, history ------------------------------------------
PENDING = "(c.status = 'in_review' AND coalesce(c.spot_answer, '') = '')"


@query(
    "mask_pending",
    _view(
        v.V_CASES, v.V_VERDICTS,
        body=f"""
SELECT v.case_id, v.rule_id, CASE WHEN NOT coalesce({PENDING}, false) THEN v.ai_verdict END AS ai_verdict,
  CASE WHEN NOT coalesce({PENDING}, false) THEN v.aq END AS aq, v.final_verdict, coalesce({PENDING}, false) AS ai_masked
FROM v_verdicts v LEFT JOIN v_cases c ON c.case_id = v.case_id
""",
    ),
)
def mask_pending(t: Tables) -> DataFrame:
    return rv.mask_pending(v.cases(t), v.verdicts(t)).select("case_id", "rule_id", "ai_verdict", "aq", "final_verdict", "ai_masked")


@query(
    "pick_spot",
    _view(
        v.V_VERDICTS,
        body="""
SELECT case_id, arg_min(rule_id, md5('7|' || case_id || '|' || rule_id)) AS spot_rule,
  arg_min(ai_verdict, md5('7|' || case_id || '|' || rule_id)) AS spot_ai FROM v_verdicts GROUP BY case_id
""",
    ),
)
def pick_spot(t: Tables) -> DataFrame:
    return rv.pick_spot(v.verdicts(t), seed=7)


@query(
    "spot_agreement",
    _view(v.V_CASES, body="SELECT case_id, spot_rule, spot_answer, spot_ai, spot_answer = spot_ai AS agree FROM v_cases WHERE spot_answer IS NOT NULL"),
)
def spot_agreement(t: Tables) -> DataFrame:
    return rv.spot_agreement(v.cases(t))


@query(
    "void_cases",
    _view(v.V_CASES, v.V_VERDICTS, body="SELECT case_id, rule_id FROM v_verdicts WHERE case_id NOT IN (SELECT case_id FROM v_cases WHERE status = 'assessed')"),
)
def void_cases(t: Tables) -> DataFrame:
    ids = v.cases(t).filter("status = 'assessed'").select("case_id")
    return rv.void_cases(v.verdicts(t), ids).select("case_id", "rule_id")


@query(
    "reset_cases",
    _view(
        v.V_CASES,
        body="""
SELECT c.case_id, CASE WHEN h.k IS NOT NULL AND status <> 'signed' THEN 'new' ELSE status END AS status,
  CASE WHEN h.k IS NOT NULL AND status <> 'signed' THEN NULL ELSE officer END AS officer
FROM v_cases c LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_tax = 0.08) h ON h.k = c.case_id
""",
    ),
)
def reset_cases(t: Tables) -> DataFrame:
    ids = t.lineitem.filter("l_tax = 0.08").select(F.col("l_orderkey").alias("case_id"))
    return rv.reset_cases(v.cases(t), ids).select("case_id", "status", "officer")


@query(
    "letter_edits",
    """
WITH l AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT conv_id || '-' || turn AS case_id, regexp_replace(CASE WHEN nxt IS NULL THEN text ELSE nxt END, '^\\s+|\\s+$', '', 'g') AS letter,
  nxt IS NOT NULL AND regexp_replace(nxt, '^\\s+|\\s+$', '', 'g') <> regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS edited
FROM l
""",
)
def letter_edits(t: Tables) -> DataFrame:
    c = t.conversations
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.concat(F.col("text"), F.lit(" \n")).alias("edited_text"))
    letters = c.join(following, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.col("text").alias("draft"), "edited_text"
    )
    return rv.letter_edits(letters)


@query(
    "current_confirmations",
    """
WITH e AS (SELECT user_id AS case_id, event_type AS rule_id, event_id AS seq, value < 10 AS confirmed, props FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, rule_id ORDER BY seq DESC) AS rn FROM e) WHERE rn = 1)
SELECT case_id, rule_id, CASE WHEN confirmed THEN 'met' END AS final_verdict, CASE WHEN confirmed THEN props END AS officer_reason,
  CASE WHEN confirmed THEN 'officer' END AS confirmed_by, CASE WHEN confirmed THEN seq END AS confirmed_at FROM l
""",
)
def current_confirmations(t: Tables) -> DataFrame:
    e = t.events.select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("rule_id"), F.col("event_id").alias("seq"),
        F.when(F.col("value") < 10, "confirm").otherwise("unconfirm").alias("action"), F.lit("met").alias("final_verdict"),
        F.col("props").alias("officer_reason"), F.lit("officer").alias("confirmed_by"), F.col("event_id").alias("confirmed_at"),
    )
    return rv.current_confirmations(e)


# --- catalogue -----------------------------------------------------------------------------------
@query(
    "ruleset_catalogue",
    """
SELECT 'N' || n_nationkey AS ruleset_id, n_name AS name, '1' AS version, r_name AS region,
  (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_rules,
  CASE WHEN n_regionkey = 2 THEN 'draft' ELSE 'approved' END AS status, n_nationkey = 0 AS is_default
FROM nation JOIN region ON n_regionkey = r_regionkey
""",
)
def ruleset_catalogue(t: Tables) -> DataFrame:
    sets = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("N"), "n_nationkey").alias("ruleset_id"), F.col("n_name").alias("name"), F.lit("1").alias("version"),
        F.col("r_name").alias("region"), F.when(F.col("n_regionkey") == 2, "draft").alias("status"),
        (F.col("n_nationkey") == 0).alias("is_default"),
    )
    rules = t.customer.select(F.concat(F.lit("N"), "c_nationkey").alias("ruleset_id"))
    return rv.ruleset_catalogue(sets, rules)


# --- audit log -----------------------------------------------------------------------------------
CHAIN_SQL = """
v_list AS (SELECT case_id, list(struct_pack(seq := seq, p := ts || '|' || case_id || '|' || actor || '|' || coalesce(role, '') || '|' || action || '|' || detail)
  ORDER BY seq) AS rows FROM v_audit GROUP BY case_id),
v_hashes AS (SELECT case_id, rows, list_reduce(list_prepend(['GENESIS'], list_transform(rows, lambda r: [r.p])),
  lambda acc, x: list_append(acc, sha256(acc[len(acc)] || '|' || x[1]))) AS hs FROM v_list),
v_chain AS (SELECT case_id, unnest(rows).seq AS seq, unnest(hs[1:len(rows)]) AS prev_hash, unnest(hs[2:]) AS hash FROM v_hashes)
"""


def _chain(t: Tables) -> DataFrame:
    return au.build_chain(v.audit_rows(t), "case_id")


@query("chain_build", _view(v.V_AUDIT, CHAIN_SQL, body="SELECT * FROM v_chain"))
def chain_build(t: Tables) -> DataFrame:
    return _chain(t).select("case_id", "seq", "prev_hash", "hash")


@query("chain_heads", _view(v.V_AUDIT, CHAIN_SQL, body="SELECT case_id, arg_max(hash, seq) AS hash FROM v_chain GROUP BY case_id"))
def chain_heads(t: Tables) -> DataFrame:
    return au.chain_heads(_chain(t), "case_id")


@query(
    "chain_verify",
    _view(
        v.V_AUDIT, CHAIN_SQL,
        """
v_stored AS (SELECT c.*, a.actor = 'error' AND length(a.detail) = 8 AND a.role IS NULL AS edited FROM v_chain c JOIN v_audit a ON a.seq = c.seq)""",
        body="""
SELECT case_id, min(seq) FILTER (WHERE edited) IS NULL AS ok, min(seq) FILTER (WHERE edited) AS broken_at_seq, count(*) AS total,
  CASE WHEN min(seq) FILTER (WHERE edited) IS NULL THEN arg_max(hash, seq) END AS head FROM v_stored GROUP BY case_id
""",
    ),
)
def chain_verify(t: Tables) -> DataFrame:
    """Logs in which short details of low-valued errors were changed after hashing."""
    edited = (F.col("actor") == "error") & (F.length("detail") == 8) & F.col("role").isNull()
    log = _chain(t).withColumn("detail", F.when(edited, "{}").otherwise(F.col("detail")))
    return au.verify_chain(log, "case_id", width=2000)


@query(
    "chain_tail_verify",
    _view(
        v.V_AUDIT, CHAIN_SQL,
        """
v_cut AS (SELECT max(seq) // 2 AS half FROM v_audit)""",
        """
v_stored AS (SELECT c.*, c.seq > (SELECT half FROM v_cut) AND a.actor = 'error' AND length(a.detail) = 8 AND a.role IS NULL AS edited FROM v_chain c JOIN v_audit a ON a.seq = c.seq)""",
        body="""
SELECT case_id, min(seq) FILTER (WHERE edited) IS NULL AS ok, min(seq) FILTER (WHERE edited) AS broken_at_seq, count(*) AS total,
  CASE WHEN min(seq) FILTER (WHERE edited) IS NULL THEN arg_max(hash, seq) END AS head FROM v_stored GROUP BY case_id
""",
    ),
)
def chain_tail_verify(t: Tables) -> DataFrame:
    """A log appended in two epochs, edited after the first and verified from the last good checkpoint before the edits."""
    log, folder = v.audit_rows(t), work_folder(t)
    cut = F.lit((log.agg(F.max("seq")).first()[0] or 0) // 2)
    audit_log.append(log.filter(F.col("seq") <= cut), folder)
    start = audit_log.last_good(t.spark, folder)
    audit_log.append(log.filter(F.col("seq") > cut), folder)
    edited = (F.col("actor") == "error") & (F.length("detail") == 8) & F.col("role").isNull()
    rows = audit_log.tail(t.spark, folder, start).withColumn("detail", F.when(edited, "{}").otherwise(F.col("detail")))
    return audit_log.verify_tail(rows, audit_log.heads_at(t.spark, folder, start), width=2000)


# --- evaluation ----------------------------------------------------------------------------------
SCORED = "v_scored AS (SELECT p.*, t.truth, t.type FROM v_pred p JOIN v_truth t ON p.case_id = t.case_id AND p.rule_id = t.rule_id)"


@query(
    "eval_accuracy",
    _view(
        v.V_PRED, SCORED,
        body="""
SELECT CASE WHEN GROUPING(type, confidence) = 3 THEN 'overall' WHEN GROUPING(type, confidence) = 1 THEN 'type' ELSE 'confidence' END AS slice,
  coalesce(type, confidence, 'all') AS value, count(*) FILTER (WHERE pred = truth) AS correct, count(*) AS total,
  round(count(*) FILTER (WHERE pred = truth)::DOUBLE / count(*), 4) AS pct
FROM v_scored GROUP BY GROUPING SETS ((), (type), (confidence))
""",
    ),
)
def eval_accuracy(t: Tables) -> DataFrame:
    return ev.accuracy(v.predictions(t), v.truths(t))


@query("eval_confusion", _view(v.V_PRED, SCORED, body="SELECT truth, pred, count(*) AS n FROM v_scored GROUP BY 1, 2"))
def eval_confusion(t: Tables) -> DataFrame:
    return ev.confusion(v.predictions(t), v.truths(t))


@query("eval_errors", _view(v.V_PRED, SCORED, body="SELECT case_id, rule_id, pred, truth, confidence FROM v_scored WHERE pred <> truth"))
def eval_errors(t: Tables) -> DataFrame:
    return ev.errors(v.predictions(t), v.truths(t)).select("case_id", "rule_id", "pred", "truth", "confidence")


@query(
    "eval_false_pass",
    _view(
        v.V_PRED,
        body="""
SELECT count(*) FILTER (WHERE t.truth = 'not_met' AND p.pred = 'met') AS false_pass, count(*) FILTER (WHERE t.truth = 'not_met') AS violations
FROM v_truth t LEFT JOIN (SELECT * FROM v_pred WHERE confidence <> 'low') p ON p.case_id = t.case_id AND p.rule_id = t.rule_id
WHERE t.case_id IN (SELECT case_id FROM v_pred WHERE confidence <> 'low')
""",
    ),
)
def eval_false_pass(t: Tables) -> DataFrame:
    return ev.false_pass(v.predictions(t).filter("confidence <> 'low'"), v.truths(t))


@query(
    "citation_rate",
    _view(v.V_PRED, body="SELECT count(*) FILTER (WHERE aq <> '' AND cite_ok) AS ok, count(*) FILTER (WHERE aq <> '') AS total FROM v_pred"),
)
def citation_rate(t: Tables) -> DataFrame:
    return ev.citation_rate(v.predictions(t))


PAIRS = """
v_user AS (SELECT user_id, event_type AS rule_id, arg_max(CASE WHEN value < 10 THEN 'met' ELSE 'not_met' END, event_id) AS pred FROM events GROUP BY 1, 2),
v_pairs AS (SELECT DISTINCT user_id AS a, user_id + 1 AS b FROM events WHERE user_id % 2 = 0),
v_both AS (SELECT * FROM v_pairs WHERE a IN (SELECT user_id FROM v_user) AND b IN (SELECT user_id FROM v_user))
"""


def _pair_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each user's last verdict per event type; neighbours are the bias pairs."""
    verdict = F.when(F.col("value") < 10, "met").otherwise("not_met")
    pred = t.events.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("rule_id"), verdict.alias("pred"), "event_id")
    pred = latest_by_key(pred, ["case_id", "rule_id"], ["event_id"])
    even = t.events.filter(F.col("user_id") % 2 == 0).select("user_id").distinct()
    return pred, even.select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b"))


@query(
    "bias_pairs",
    _view(
        PAIRS,
        body="""
SELECT p.a, p.b, count(*) FILTER (WHERE x.pred IS NOT DISTINCT FROM y.pred) AS match, count(*) AS total
FROM v_both p JOIN v_user x ON x.user_id = p.a LEFT JOIN v_user y ON y.user_id = p.b AND y.rule_id = x.rule_id GROUP BY 1, 2
""",
    ),
)
def bias_pairs(t: Tables) -> DataFrame:
    return ev.bias_pairs(*_pair_tables(t))


@query(
    "bias_differences",
    _view(
        PAIRS,
        body="""
SELECT p.a, p.b, x.rule_id, x.pred AS pred_a, y.pred AS pred_b FROM v_both p JOIN v_user x ON x.user_id = p.a
LEFT JOIN v_user y ON y.user_id = p.b AND y.rule_id = x.rule_id WHERE x.pred IS DISTINCT FROM y.pred
""",
    ),
)
def bias_differences(t: Tables) -> DataFrame:
    return ev.bias_rows(*_pair_tables(t)).filter("NOT same").drop("same")


# Test sets: an order is a test case of its customer's segment, its lines are the labels; the first line is the target
# unless the order is urgent (a clean case).
TESTSET = """
v_sets AS (SELECT c_mktsegment AS ruleset_id, CASE WHEN c_mktsegment < 'F' THEN 'target' ELSE 'full' END AS label_scope,
  c_mktsegment <> 'HOUSEHOLD' AS approved, strftime(max(o_orderdate), '%Y-%m-%d') AS generated_at,
  strftime(min(o_orderdate), '%Y-%m-%d') AS approved_at, 'Petra' AS approved_by
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
v_tcases AS (SELECT c_mktsegment AS ruleset_id, o_orderkey AS case_id,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN 'R1' END AS target,
  CASE WHEN o_totalprice > 450000 THEN 'disputed' WHEN o_totalprice < 30000 AND c_mktsegment = 'BUILDING' THEN 'needs_review' ELSE 'approved' END AS status,
  o_totalprice > 60000 AS target_label_clear, o_orderstatus = 'F' AS guard_agree
  FROM orders JOIN customer ON o_custkey = c_custkey),
v_tlabels AS (SELECT c.ruleset_id, v.case_id, v.rule_id, CASE WHEN v.rule_id = c.target THEN 'not_met' ELSE 'met' END AS truth,
  v.l_tax >= 0.06 AS weak, v.guard_level = 'code-guarded' AND c.target IS NULL AS control
  FROM v_verdicts v JOIN v_tcases c ON c.case_id = v.case_id)
"""


def _testset_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    sets = joined.groupBy(F.col("c_mktsegment").alias("ruleset_id")).agg(
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("generated_at"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("approved_at"),
    ).select(
        "ruleset_id",
        F.when(F.col("ruleset_id") < "F", "target").otherwise("full").alias("label_scope"),
        (F.col("ruleset_id") != "HOUSEHOLD").alias("approved"),
        "generated_at",
        "approved_at",
        F.lit("Petra").alias("approved_by"),
    )
    cases = joined.select(
        F.col("c_mktsegment").alias("ruleset_id"),
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_orderpriority") != "1-URGENT", "R1").alias("target"),
        F.when(F.col("o_totalprice") > 450000, "disputed")
        .when((F.col("o_totalprice") < 30000) & (F.col("c_mktsegment") == "BUILDING"), "needs_review")
        .otherwise("approved")
        .alias("status"),
        (F.col("o_totalprice") > 60000).alias("target_label_clear"),
        (F.col("o_orderstatus") == "F").alias("guard_agree"),
    )
    labels = v.verdicts(t).join(cases.select("ruleset_id", "case_id", "target"), "case_id").select(
        "ruleset_id", "case_id", "rule_id",
        F.when(F.col("rule_id").eqNullSafe(F.col("target")), "not_met").otherwise("met").alias("truth"),
        (F.col("l_tax") >= 0.06).alias("weak"),
        ((F.col("guard_level") == "code-guarded") & F.col("target").isNull()).alias("control"),
    )
    return sets, cases, labels


EVALUATED = """
v_live AS (SELECT *, status = 'disputed' AS disputed, status <> 'disputed' AND (status = 'needs_review' OR (target IS NOT NULL AND NOT target_label_clear)) AS flagged FROM v_tcases),
v_bucket AS (SELECT l.ruleset_id, l.truth, v.ai_verdict AS pred,
  CASE WHEN s.label_scope = 'target' THEN CASE WHEN l.rule_id = c.target THEN 'target' WHEN c.target IS NULL AND l.control AND NOT l.weak THEN 'control' END
    ELSE CASE WHEN l.rule_id = c.target THEN 'target' WHEN l.weak THEN 'excluded' ELSE 'secondary' END END AS bucket
  FROM v_tlabels l JOIN v_live c ON c.case_id = l.case_id AND NOT c.disputed AND NOT c.flagged
  JOIN v_verdicts v ON v.case_id = l.case_id AND v.rule_id = l.rule_id JOIN v_sets s ON s.ruleset_id = l.ruleset_id),
v_eval AS (SELECT ruleset_id,
  count(*) FILTER (WHERE bucket = 'target') AS target_total, count(*) FILTER (WHERE bucket = 'target' AND pred = truth) AS target_correct,
  count(*) FILTER (WHERE bucket = 'target' AND truth = 'not_met' AND pred = 'met') AS target_false_pass,
  count(*) FILTER (WHERE bucket = 'control') AS control_total, count(*) FILTER (WHERE bucket = 'control' AND pred = truth) AS control_correct,
  count(*) FILTER (WHERE bucket = 'control' AND pred <> truth AND pred = 'not_met') AS false_alarm,
  count(*) FILTER (WHERE bucket = 'secondary') AS secondary_total, count(*) FILTER (WHERE bucket = 'secondary' AND pred = truth) AS secondary_correct,
  count(*) FILTER (WHERE bucket = 'secondary' AND truth = 'not_met' AND pred = 'met') AS secondary_false_pass,
  count(*) FILTER (WHERE bucket = 'excluded') AS excluded_weak FROM v_bucket GROUP BY 1),
v_result AS (SELECT s.ruleset_id, s.label_scope AS scope, NOT s.approved AS provisional, e.* EXCLUDE (ruleset_id),
  target_total - target_correct - target_false_pass AS routed_to_officer,
  round(excluded_weak::DOUBLE / greatest(target_total + secondary_total + excluded_weak, 1), 3) AS excluded_rate,
  s.label_scope = 'full' AND excluded_weak::DOUBLE / greatest(target_total + secondary_total + excluded_weak, 1) > 0.3 AS low_quality,
  target_total < 10 AS small_sample,
  (SELECT count(*) FROM v_live l WHERE l.ruleset_id = s.ruleset_id AND disputed) AS disputed_cases,
  (SELECT count(*) FROM v_live l WHERE l.ruleset_id = s.ruleset_id AND flagged) AS flagged_unresolved
  FROM v_sets s JOIN v_eval e ON e.ruleset_id = s.ruleset_id)
"""


def _evaluated(t: Tables) -> DataFrame:
    sets, cases, labels = _testset_tables(t)
    pred = v.verdicts(t).select("case_id", "rule_id", F.col("ai_verdict").alias("pred"))
    return ev.evaluate_testset(pred, sets, cases, labels)


@query("testset_eval", _view(v.V_VERDICTS, TESTSET, EVALUATED, body="SELECT * FROM v_result"))
def testset_eval(t: Tables) -> DataFrame:
    return _evaluated(t)


@query(
    "testset_status",
    _view(
        v.V_VERDICTS, TESTSET,
        body="""
SELECT c.ruleset_id, c.case_id, c.target, c.status, coalesce(w.n, 0) AS n_weak, c.guard_agree, s.approved, s.approved_by
FROM v_tcases c JOIN v_sets s ON s.ruleset_id = c.ruleset_id
LEFT JOIN (SELECT case_id, count(*) AS n FROM v_tlabels WHERE weak GROUP BY 1) w ON w.case_id = c.case_id
""",
    ),
)
def testset_status(t: Tables) -> DataFrame:
    return ev.testset_status(*_testset_tables(t))


@query(
    "measurement_status",
    _view(
        v.V_VERDICTS, TESTSET, EVALUATED,
        """
v_named AS (SELECT DISTINCT c_mktsegment AS ruleset_id FROM customer UNION SELECT DISTINCT p_brand FROM part),
v_stage AS (SELECT n.ruleset_id, coalesce((SELECT count(*) FROM v_tcases c WHERE c.ruleset_id = n.ruleset_id), 0) AS n_cases,
  CASE WHEN s.ruleset_id IS NULL THEN 'no test set yet'
    WHEN EXISTS (SELECT 1 FROM v_tcases c WHERE c.ruleset_id = n.ruleset_id AND c.status = 'needs_review') THEN 'test set exists, verifier-flagged cases still unreviewed'
    WHEN NOT s.approved THEN 'test set exists, labels not approved'
    WHEN n.ruleset_id = 'MACHINERY' THEN 'evaluation is stale — does not match the current labels'
    ELSE 'measured through the full chain' END AS stage
  FROM v_named n LEFT JOIN v_sets s ON s.ruleset_id = n.ruleset_id)""",
        body="""
SELECT g.ruleset_id, 'Fund ' || g.ruleset_id AS name, '1' AS version, 'approved' AS ruleset_status, g.n_cases,
  g.stage LIKE 'measured%' AS measured, g.stage,
  CASE WHEN g.stage LIKE 'measured%' THEN r.target_correct END AS target_correct, CASE WHEN g.stage LIKE 'measured%' THEN r.target_total END AS target_total,
  CASE WHEN g.stage LIKE 'measured%' THEN r.target_false_pass END AS target_false_pass,
  CASE WHEN g.stage LIKE 'measured%' THEN r.control_total END AS control_total, CASE WHEN g.stage LIKE 'measured%' THEN r.false_alarm END AS false_alarm
FROM v_stage g LEFT JOIN v_result r ON r.ruleset_id = g.ruleset_id
""",
    ),
)
def measurement_status(t: Tables) -> DataFrame:
    sets, cases, _ = _testset_tables(t)
    named = t.customer.select(F.col("c_mktsegment").alias("ruleset_id")).union(t.spread("part").select("p_brand")).distinct()
    rulesets = named.select(
        "ruleset_id", F.concat(F.lit("Fund "), "ruleset_id").alias("name"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("status")
    )
    stamps = sets.select(
        "ruleset_id", F.col("generated_at").alias("labels_generated_at"),
        F.when(F.col("ruleset_id") != "MACHINERY", F.col("approved_at")).alias("labels_approved_at"),
    )
    evals = _evaluated(t).join(stamps, "ruleset_id").select(
        "ruleset_id", "labels_generated_at", "labels_approved_at", "provisional", "target_correct", "target_total",
        "target_false_pass", "control_total", "false_alarm",
    )
    return ev.measurement_status(rulesets, sets.select("ruleset_id", "approved", "generated_at", "approved_at"), cases, evals)


# --- rulesets over time --------------------------------------------------------------------------
@query(
    "rules_in_force",
    """
WITH o AS (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN 'fund 0' ELSE 'fund ' || (o_custkey % 11 + 1) END AS ruleset_id FROM orders),
ver AS (SELECT ruleset_id, o_orderdate + to_hours(o_orderkey % 24) AS valid_from, max(o_orderkey) AS version FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT o.o_orderkey AS case_id, o.ruleset_id, ver.version, ver.valid_from FROM o ASOF LEFT JOIN ver ON o.ruleset_id = ver.ruleset_id AND o.o_orderdate >= ver.valid_from
""",
)
def rules_in_force_query(t: Tables) -> DataFrame:
    """Orders as cases, urgent ones as new versions of their ruleset; one ruleset has a third of both."""
    ruleset = F.when(F.col("o_custkey") % 3 == 0, "fund 0").otherwise(F.concat(F.lit("fund "), F.col("o_custkey") % 11 + 1)).alias("ruleset_id")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    cases = t.orders.select(F.col("o_orderkey").alias("case_id"), ruleset, at.alias("assessed_at"))
    begins = at + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    versions = t.orders.filter("o_orderpriority = '1-URGENT'").select(ruleset, F.col("o_orderkey").alias("version"), begins.alias("valid_from"))
    return rules_in_force(cases, versions, width=90 * 86_400).select("case_id", "ruleset_id", "version", "valid_from")
