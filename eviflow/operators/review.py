"""Review analytics over cases, verdicts and post-audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.functions import text as tx
from eviflow.operators.common import count_where, join_keyed, latest_by_key, ratio, top_k, with_position, with_previous
from eviflow.operators.evidence import attestation_found

KEY = ["case_id", "rule_id"]


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names]


# --- queue, dashboard, summaries -----------------------------------------------------------------
def case_queue(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cases with counts of their verdicts; zeros when there are none."""
    counts = verdicts.groupBy("case_id").agg(
        F.count("*").alias("n_rules"),
        F.count("confirmed_at").alias("n_confirmed"),
        count_where(F.col("ai_verdict") == "not_met").alias("ai_not_met"),
        count_where(F.col("ai_verdict").isin("unclear", "not_addressed")).alias("ai_attention"),
        count_where(F.col("final_verdict") == "not_met").alias("final_not_met"),
    )
    kept = [c for c in cases.columns if c != "text"]
    return cases.select(*kept).join(counts, "case_id", "left").select(
        *kept, *_zero("n_rules", "n_confirmed", "ai_not_met", "ai_attention", "final_not_met")
    )


def status_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("status").agg(F.count("*").alias("n"))


def dashboard(cases: DataFrame, verdicts: DataFrame, post_audit: DataFrame) -> DataFrame:
    """One row of office figures; each part is a global aggregate of one row."""
    confirmed = F.col("confirmed_at").isNotNull()
    v = verdicts.agg(
        count_where(confirmed).alias("confirmed_verdicts"),
        count_where(confirmed & (F.col("final_verdict") != F.col("ai_verdict"))).alias("_overrides"),
        count_where(F.col("aq") != "").alias("_cites"),
        count_where((F.col("aq") != "") & F.col("cite_ok")).alias("_cites_ok"),
        count_where(
            confirmed & (F.col("final_verdict") == "met") & (F.col("guard_level") == "needs-manual-guard")
        ).alias("unguarded_met_confirmations"),
    )
    seconds = F.unix_timestamp(F.col("signed_at").cast("timestamp")) - F.unix_timestamp(
        F.col("review_started_at").cast("timestamp")
    )
    c = cases.agg(
        F.count("*").alias("cases_total"),
        F.avg(F.when(F.col("signed_at").isNotNull(), seconds)).alias("avg_review_seconds"),
        F.count("spot_answer").alias("spot_n"),
        count_where(F.col("spot_answer") == F.col("spot_ai")).alias("spot_agree"),
    )
    one_row = [c, v, post_audit_stats(cases, verdicts, post_audit)]
    joined = one_row[0].withColumn("_one", F.lit(1))
    for part in one_row[1:]:
        joined = joined.join(part.withColumn("_one", F.lit(1)), "_one")
    return joined.select(
        "cases_total",
        "confirmed_verdicts",
        F.coalesce(ratio(F.col("_overrides"), F.col("confirmed_verdicts")), F.lit(0.0)).alias("override_rate"),
        ratio(F.col("_cites_ok"), F.col("_cites")).alias("citation_ok_rate"),
        "avg_review_seconds",
        "spot_n",
        "spot_agree",
        "unguarded_met_confirmations",
        "eligible",
        "audited",
        "disagree",
        "coverage",
    )


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Verdict counts per case, one column per verdict."""
    return verdicts.groupBy("case_id").agg(
        *[count_where(F.col("ai_verdict") == name).alias(name) for name in fv.VERDICTS]
    )


# --- post-audit ----------------------------------------------------------------------------------
def _auditable(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    met = verdicts.filter(
        (F.col("final_verdict") == "met")
        & F.col("guard_level").isin(fv.UNGUARDED_LEVELS)
        & F.col("confirmed_at").isNotNull()
    )
    signed = cases.filter(F.col("signed_at").isNotNull()).select(
        "case_id", "applicant", "status", F.col("officer").alias("case_officer"), "signed_at"
    )
    return met.join(signed, "case_id")


def post_audit_candidates(cases: DataFrame, verdicts: DataFrame, post_audit: DataFrame, auditor: str) -> DataFrame:
    """Signed MET confirmations without a code guard, not yet audited and not the auditor's own."""
    own = F.coalesce("confirmed_by", F.lit("")) == F.lit(auditor or "")
    return _auditable(cases, verdicts).filter(~own).join(post_audit.select(*KEY).distinct(), KEY, "left_anti")


def post_audit_sample(pool: DataFrame, n: int, seed: int = 0, by_hash: bool = False) -> DataFrame:
    """``n`` random rows of the pool; ``by_hash`` makes the draw depend on the keys alone."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *KEY)) if by_hash else F.rand(seed)
    return pool.orderBy(order, *KEY).limit(n)


def post_audit_stats(cases: DataFrame, verdicts: DataFrame, post_audit: DataFrame) -> DataFrame:
    eligible = _auditable(cases, verdicts).agg(F.count("*").alias("eligible")).withColumn("_k", F.lit(1))
    done = post_audit.agg(
        F.count("*").alias("audited"), count_where(F.col("outcome") == "disagree").alias("disagree")
    ).withColumn("_k", F.lit(1))
    return eligible.join(done, "_k").select(
        "eligible", "audited", "disagree", ratio(F.col("audited"), F.col("eligible")).alias("coverage")
    )


def latest(df: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """Newest ``n`` rows of the whole frame, all when None."""
    return df.orderBy(*order) if n is None else df.orderBy(*order).limit(n)


def audit_events(audit: DataFrame, case_id: str | None = None, n: int | None = None) -> DataFrame:
    """Newest audit rows, of one case if given."""
    rows = audit if case_id is None else audit.filter(F.col("case_id") == case_id)
    return latest(rows, [F.desc("seq")], n)


def audit_events_per_case(audit: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` audit rows of every case."""
    return top_k(audit, ["case_id"], [F.desc("seq")], n)


def validate_post_audit(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Requests (case, rule, auditor, outcome, note) with the first check they fail, null when accepted."""
    found = verdicts.select(*KEY, "final_verdict", "confirmed_by")
    return requests.join(found, KEY, "left").select(
        *requests.columns,
        F.when(~F.coalesce(F.col("outcome").isin("agree", "disagree"), F.lit(False)), "bad_outcome")
        .when(~F.col("final_verdict").eqNullSafe("met"), "not_met_confirmation")
        .when(F.coalesce("confirmed_by", F.lit("")) == F.col("auditor"), "own_confirmation")
        .when(
            (F.col("outcome") == "disagree")
            & (F.length(tx.trim_space(F.coalesce("note", F.lit("")))) < fv.MIN_REASON),
            "reason_too_short",
        )
        .alias("problem"),
    )


def save_post_audit(current: DataFrame, accepted: DataFrame) -> DataFrame:
    """Replace records per (case, rule) with the newest one."""
    return latest_by_key(current.unionByName(accepted), KEY, ["audited_at", "auditor"])


# --- signing -------------------------------------------------------------------------------------
def needs_countersign(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Signed cases without a countersignature that hold a verdict other than met (a missing one counts)."""
    other = verdicts.filter(~F.col("final_verdict").eqNullSafe("met")).select("case_id").distinct()
    open_cases = cases.filter(F.col("status").isin(fv.SIGNED_OR_LATER) & F.col("countersigned_by").isNull())
    return open_cases.select("case_id").join(other, "case_id", "left_semi")


def sign_report(cases: DataFrame, verdicts: DataFrame, as_of: str) -> DataFrame:
    """Sign readiness of the cases under review."""
    review = cases.filter(F.col("status") == "in_review").select("case_id", "review_started_at")
    counts = verdicts.groupBy("case_id").agg(
        F.count("*").alias("n_rules"),
        count_where(F.col("confirmed_at").isNull()).alias("n_missing"),
        count_where(~F.col("final_verdict").eqNullSafe(F.col("ai_verdict"))).alias("overrides"),
        F.bool_or(~F.col("final_verdict").eqNullSafe("met")).alias("rejection"),
    )
    elapsed = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(
        F.col("review_started_at").cast("timestamp")
    )
    needed = F.col("n_rules") * fv.SECONDS_PER_RULE
    return (
        review.join(counts, "case_id", "left")
        .withColumn("n_rules", F.coalesce("n_rules", F.lit(0)))
        .select(
            "case_id",
            "n_rules",
            *_zero("n_missing", "overrides"),
            F.coalesce("rejection", F.lit(False)).alias("rejection"),
            elapsed.alias("elapsed"),
            needed.alias("min_expected"),
            (elapsed < needed).alias("fast"),
            (F.coalesce("n_missing", F.lit(0)) == 0).alias("ready"),
        )
    )


def missing_confirmations(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(case, rule) still to confirm in the cases under review."""
    review = cases.filter(F.col("status") == "in_review").select("case_id")
    return verdicts.filter(F.col("confirmed_at").isNull()).select(*KEY).join(review, "case_id", "left_semi")


def confirmation_audit(verdicts: DataFrame, cases: DataFrame) -> DataFrame:
    """First rule a confirmation breaks, null when it complies; ``evidence_ack`` marks a confirmed AI quotation."""
    reason = tx.trim_space(F.coalesce("officer_reason", F.lit("")))
    n = F.length(reason)
    note = F.coalesce("note", F.lit(""))
    guarded = F.contains(note, F.lit(fv.NOTE_BLOCKED)) | F.contains(note, F.lit(fv.NOTE_SUSPECTED))
    final, ai = F.col("final_verdict"), F.col("ai_verdict")
    must = (~final.eqNullSafe(ai)) | ai.isin("unclear", "not_addressed") | (final == "unclear")
    level = F.coalesce("guard_level", F.lit("llm-only"))
    strict = level == "needs-manual-guard"
    attest = (final == "met") & level.isin(fv.UNGUARDED_LEVELS)
    ack = F.contains(reason, F.lit(fv.NOTE_AI_QUOTE)) if "evidence_ack" not in verdicts.columns else F.col("evidence_ack")
    quoted = ~strict & F.coalesce(ack, F.lit(False)) & (tx.trim_space(F.coalesce("aq", F.lit(""))) != "")
    least = F.when(strict, fv.ATTEST_MIN_MANUAL).otherwise(fv.ATTEST_MIN_PLAIN)
    confirmed = verdicts.filter(F.col("confirmed_at").isNotNull())
    texts = cases.select("case_id", "text")
    # Only rows that must quote the application meet its text.
    judged = confirmed.withColumn(
        "_code",
        F.when(~F.coalesce(final.isin(fv.FINAL_ALLOWED), F.lit(False)), "bad_final")
        .when(must & (n < fv.MIN_REASON), "reason_required")
        .when(guarded & (final == "met") & (n < fv.MIN_REASON), "guard_reason_required")
        .when(attest & ~quoted & (n < least), "attestation_too_short"),
    ).withColumn("_quote", F.when(F.col("_code").isNull() & attest & ~quoted, F.lit(True)).otherwise(False))
    kind = F.when(attest & quoted, "ai_quote_ack").when(attest, "officer_quote")
    plain = judged.filter(~F.col("_quote")).select(
        *KEY, F.when(F.col("_code").isNull(), kind).alias("attestation"), F.col("_code").alias("problem")
    )
    repeated = duplicate_attestations(confirmed).select(*KEY, F.lit(True).alias("_dup"))
    typed = (
        judged.filter("_quote")
        .join(texts, "case_id", "left")
        .join(repeated, KEY, "left")
        .select(
            *KEY,
            F.when(~attestation_found(F.col("officer_reason"), F.col("text")), "no_verbatim_quote")
            .when(F.col("_dup"), "duplicate_attestation")
            .alias("problem"),
        )
        .select(*KEY, F.when(F.col("problem").isNull(), "officer_quote").alias("attestation"), "problem")
    )
    return plain.unionByName(typed)


def duplicate_attestations(verdicts: DataFrame) -> DataFrame:
    """Rows whose normalised reason is used for more than one rule of the case."""
    typed = verdicts.withColumn("reason_norm", tx.ws_norm("officer_reason")).filter(F.col("reason_norm") != "")
    repeated = (
        typed.groupBy("case_id", "reason_norm").agg(F.count("*").alias("n_same")).filter(F.col("n_same") > 1)
    )
    return typed.select(*KEY, "reason_norm").join(repeated, ["case_id", "reason_norm"])


# --- state machine -------------------------------------------------------------------------------
def transition_violations(history: DataFrame, allowed: DataFrame, start: str | None = "new") -> DataFrame:
    """Status changes (case, seq, status, reason) that leave an allowed edge (from_status, status).

    Reopening a signed case needs a reason of at least eight characters.
    """
    chained = with_previous(history, ["case_id"], "seq", {"status": "from_status"})
    if start is not None:
        chained = chained.withColumn("from_status", F.coalesce("from_status", F.lit(start)))
    steps = chained.filter(F.col("from_status").isNotNull())
    legal = allowed.select("from_status", "status").withColumn("_legal", F.lit(True))
    reopened = F.col("from_status").isin(fv.SIGNED_OR_LATER) & (F.col("status") == "in_review")
    short = F.length(tx.trim_space(F.coalesce("reason", F.lit("")))) < fv.MIN_REASON
    return (
        join_keyed(steps, legal, ["from_status", "status"], "left")
        .withColumn(
            "problem",
            F.when(F.col("_legal").isNull(), "edge_not_allowed").when(reopened & short, "reason_required"),
        )
        .filter(F.col("problem").isNotNull())
        .select("case_id", "seq", "from_status", "status", "problem")
    )


def state_machine(spark) -> DataFrame:
    return spark.createDataFrame(fv.ALLOWED_TRANSITIONS, "from_status string, status string")


def sla_overdue(cases: DataFrame, sla_days: dict[str, int], as_of: str, since: str = "review_started_at") -> DataFrame:
    """Cases that stay in their status longer than its limit."""
    limits = F.create_map(*[F.lit(x) for kv in sla_days.items() for x in kv])
    return (
        cases.select(
            "case_id",
            "status",
            F.datediff(F.to_date(F.lit(as_of)), F.to_date(since)).cast("bigint").alias("age_days"),
            limits[F.col("status")].cast("bigint").alias("limit_days"),
        )
        .filter(F.col("age_days") > F.col("limit_days"))
        .withColumn("overdue_days", F.col("age_days") - F.col("limit_days"))
    )


def supplement_deadlines(requests: DataFrame, as_of: str) -> DataFrame:
    """Supplement requests (case, seq, items, days, requested_at, by) with round, deadline and state."""
    days = F.greatest(F.lit(1), F.least(F.when(F.coalesce("days", F.lit(0)) == 0, 15).otherwise(F.col("days")), F.lit(90)))
    items = tx.trim_space(F.coalesce("items", F.lit("")))
    valid = requests.filter(F.length(items) >= fv.MIN_REASON)
    numbered = with_position(valid, ["case_id"], "seq", "round")
    deadline = F.date_add(F.to_date("requested_at"), days.cast("int"))
    return numbered.select(
        "case_id",
        "seq",
        "round",
        items.alias("items"),
        days.cast("bigint").alias("days"),
        deadline.alias("deadline"),
        (deadline < F.to_date(F.lit(as_of))).alias("overdue"),
    )


def case_rules(cases: DataFrame, rules: DataFrame, rulesets: DataFrame) -> DataFrame:
    """Rules of each case: those of its locked version, else of its assigned set, else of the default set.

    ``cases`` carries ruleset_id and locked_version (null before the first assessment); ``rulesets`` holds one row
    per (ruleset_id, version) with is_default and is_current flags. Of several default sets the one of the least id counts.
    """
    current = rulesets.filter("is_current").select("ruleset_id", F.col("version").alias("_current"))
    default = rulesets.filter("is_default AND is_current").agg(F.min("ruleset_id").alias("_default"))
    assigned = (
        join_keyed(cases.select("case_id", "ruleset_id", "locked_version").withColumn("_one", F.lit(1)),
                   default.withColumn("_one", F.lit(1)), ["_one"], "left")
        .withColumn("ruleset_id", F.coalesce("ruleset_id", "_default"))
        .drop("_one", "_default")
    )
    versioned = join_keyed(assigned, current, ["ruleset_id"], "left").select(
        "case_id",
        "ruleset_id",
        F.coalesce("locked_version", "_current").alias("version"),
        F.col("locked_version").isNotNull().alias("locked"),
    )
    return join_keyed(versioned, rules, ["ruleset_id", "version"])


def lock_rulesets(assessments: DataFrame) -> DataFrame:
    """First assessed (ruleset, version) per case: the one every later assessment keeps."""
    return assessments.groupBy("case_id").agg(
        F.min_by(F.struct("ruleset_id", "version"), F.struct("assessed_at", "ruleset_id", "version")).alias("_first")
    ).select("case_id", F.col("_first.ruleset_id").alias("ruleset_id"), F.col("_first.version").alias("locked_version"))


# --- blind view and spot-check -------------------------------------------------------------------
AI_COLUMNS = ["ai_verdict", "ai_confidence", "facts", "aq", "note", "chunk_id", "retrieval", "needs_attention"]


def spot_pending() -> Column:
    return (
        (F.col("status") == "in_review")
        & (F.coalesce("spot_rule", F.lit("")) != "")
        & (F.coalesce("spot_answer", F.lit("")) == "")
    )


def mask_pending(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts with the AI columns hidden while the spot-check of their case is open."""
    pending = cases.filter(spot_pending()).select("case_id", F.lit(True).alias("_pending"))
    hidden = F.coalesce("_pending", F.lit(False))
    return verdicts.join(pending, "case_id", "left").select(
        *[F.when(~hidden, F.col(c)).alias(c) if c in AI_COLUMNS else F.col(c) for c in verdicts.columns],
        hidden.alias("ai_masked"),
    )


def pick_spot(verdicts: DataFrame, seed: int = 0) -> DataFrame:
    """One rule per case for the blind check, drawn by a seeded hash of the keys."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "case_id", "rule_id"))
    return verdicts.groupBy("case_id").agg(
        F.min_by(F.struct("rule_id", "ai_verdict"), F.struct(draw, F.col("rule_id"))).alias("_p")
    ).select("case_id", F.col("_p.rule_id").alias("spot_rule"), F.col("_p.ai_verdict").alias("spot_ai"))


def spot_agreement(cases: DataFrame) -> DataFrame:
    answered = cases.filter(F.coalesce("spot_answer", F.lit("")) != "")
    return answered.select(
        "case_id", "spot_rule", "spot_answer", "spot_ai", F.col("spot_answer").eqNullSafe(F.col("spot_ai")).alias("agree")
    )


# --- voiding, letters, confirmation history ------------------------------------------------------
def void_cases(verdicts: DataFrame, ids: DataFrame) -> DataFrame:
    """Verdicts left after the cases in ``ids`` are voided."""
    return verdicts.join(ids.select("case_id").distinct(), "case_id", "left_anti")


VOIDED_COLUMNS = [
    "review_started_at", "signed_at", "officer", "spot_rule", "spot_answer", "spot_ai", "letter", "letter_status",
    "countersigned_by", "countersigned_at",
]


def reset_cases(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """Voided cases go back to new with their review fields cleared; signed cases are left alone."""
    hit = ids.select("case_id").distinct().withColumn("_hit", F.lit(True))
    void = F.coalesce("_hit", F.lit(False)) & ~F.col("status").isin(fv.SIGNED_OR_LATER)
    return cases.join(hit, "case_id", "left").select(
        *[
            F.when(void, F.lit("new")).otherwise(F.col(c)).alias(c)
            if c == "status"
            else F.when(~void, F.col(c)).alias(c)
            if c in VOIDED_COLUMNS
            else F.col(c)
            for c in cases.columns
        ]
    )


def letter_edits(letters: DataFrame) -> DataFrame:
    """Approved text and whether it differs from the draft; an empty edit keeps the draft."""
    draft = tx.trim_space(F.coalesce("draft", F.lit("")))
    edit = F.coalesce("edited_text", F.lit(""))
    text = F.when(edit != "", tx.trim_space(edit)).otherwise(draft)
    return letters.select("case_id", text.alias("letter"), ((edit != "") & (tx.trim_space(edit) != draft)).alias("edited"))


def current_confirmations(events: DataFrame) -> DataFrame:
    """Human columns after the last confirm or unconfirm event per (case, rule)."""
    human = ["final_verdict", "officer_reason", "confirmed_by", "confirmed_at"]
    last = latest_by_key(events.select(*KEY, "seq", "action", *human), KEY, ["seq"])
    keep = F.col("action") == "confirm"
    return last.select(*KEY, *[F.when(keep, F.col(c)).alias(c) for c in human])


# --- catalogue -----------------------------------------------------------------------------------
def ruleset_catalogue(rulesets: DataFrame, rules: DataFrame) -> DataFrame:
    n = rules.groupBy("ruleset_id").agg(F.count("*").alias("n_rules"))
    return rulesets.join(n, "ruleset_id", "left").select(
        "ruleset_id",
        "name",
        "version",
        F.coalesce("region", F.lit("")).alias("region"),
        F.coalesce("n_rules", F.lit(0)).alias("n_rules"),
        F.coalesce("status", F.lit("approved")).alias("status"),
        F.coalesce("is_default", F.lit(False)).alias("is_default"),
    )


def officer_catalogue(officers: DataFrame) -> DataFrame:
    return officers.select("name", F.coalesce("role", F.lit("officer")).alias("role"), "affiliations")


def managers(officers: DataFrame) -> DataFrame:
    return officers.filter(F.col("role") == "manager").select("name")
