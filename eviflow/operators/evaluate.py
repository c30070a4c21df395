"""Evaluation of predicted verdicts against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.operators.common import count_where, join_keyed, ratio

KEY = ["case_id", "rule_id"]


def scored(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions (case, rule, pred, confidence) with their label."""
    return pred.join(truth, KEY)


def accuracy(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Correct and total: overall, per rule type and per confidence, in one pass."""
    rows = scored(pred, truth)
    return (
        rows.groupingSets([[], ["type"], ["confidence"]], "type", "confidence")
        .agg(
            F.grouping_id().alias("_g"),
            count_where(F.col("pred") == F.col("truth")).alias("correct"),
            F.count("*").alias("total"),
        )
        .select(
            F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "type").otherwise("confidence").alias("slice"),
            F.coalesce("type", "confidence", F.lit("all")).alias("value"),
            "correct",
            "total",
            ratio(F.col("correct"), F.col("total"), 4).alias("pct"),
        )
    )


def confusion(pred: DataFrame, truth: DataFrame) -> DataFrame:
    return scored(pred, truth).groupBy("truth", "pred").agg(F.count("*").alias("n"))


def errors(pred: DataFrame, truth: DataFrame) -> DataFrame:
    return scored(pred, truth).filter(F.col("pred") != F.col("truth"))


def false_pass(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Violations let through, over all violations labelled in the evaluated cases."""
    seen = truth.join(pred.select("case_id").distinct(), "case_id", "left_semi")
    return (
        seen.join(pred.select(*KEY, "pred"), KEY, "left")
        .agg(
            count_where((F.col("truth") == "not_met") & (F.col("pred") == "met")).alias("false_pass"),
            count_where(F.col("truth") == "not_met").alias("violations"),
        )
    )


def citation_rate(pred: DataFrame) -> DataFrame:
    quoted = F.coalesce("aq", F.lit("")) != ""
    return pred.agg(count_where(quoted & F.col("cite_ok")).alias("ok"), count_where(quoted).alias("total"))


def bias_rows(pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verdict of both sides per rule of side a, for pairs (a, b) with both sides present."""
    present = pred.select("case_id").distinct()
    both = (
        pairs.join(present.withColumnRenamed("case_id", "a"), "a", "left_semi")
        .join(present.withColumnRenamed("case_id", "b"), "b", "left_semi")
    )
    left = pred.select(F.col("case_id").alias("a"), "rule_id", F.col("pred").alias("pred_a"))
    right = pred.select(F.col("case_id").alias("b"), "rule_id", F.col("pred").alias("pred_b"))
    return (
        left.join(both, "a")
        .join(right, ["b", "rule_id"], "left")
        .select("a", "b", "rule_id", "pred_a", "pred_b", F.col("pred_a").eqNullSafe(F.col("pred_b")).alias("same"))
    )


def bias_pairs(pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matching verdicts per pair; the differing rules are the rows of :func:`bias_rows` with ``same`` false."""
    return bias_rows(pred, pairs).groupBy("a", "b").agg(
        count_where(F.col("same")).alias("match"), F.count("*").alias("total")
    )


# --- planted test sets ---------------------------------------------------------------------------
def testset_live(cases: DataFrame) -> DataFrame:
    """Cases (ruleset_id, case_id, target, status, target_label_clear) neither disputed nor flagged."""
    disputed = F.coalesce("status", F.lit("")) == "disputed"
    flagged = (F.col("status").eqNullSafe("needs_review")) | (
        F.col("target").isNotNull() & F.col("target_label_clear").eqNullSafe(F.lit(False))
    )
    return cases.withColumn("disputed", disputed).withColumn("flagged", flagged & ~disputed)


def evaluate_testset(pred: DataFrame, testsets: DataFrame, cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Target, control and secondary figures per ruleset.

    ``testsets`` (ruleset_id, label_scope, approved); ``labels`` (ruleset_id, case_id, rule_id, truth, weak, control);
    ``pred`` (case_id, rule_id, pred).
    """
    state = testset_live(cases)
    excluded = state.groupBy("ruleset_id").agg(
        count_where(F.col("disputed")).alias("disputed_cases"), count_where(F.col("flagged")).alias("flagged_unresolved")
    )
    live = state.filter(~F.col("disputed") & ~F.col("flagged")).select("ruleset_id", "case_id", "target")
    rows = labels.join(live, ["ruleset_id", "case_id"]).join(pred.select(*KEY, "pred"), KEY)
    rows = join_keyed(rows, testsets.select("ruleset_id", F.coalesce("label_scope", F.lit("full")).alias("scope")), ["ruleset_id"])
    is_target = F.coalesce(F.col("rule_id") == F.col("target"), F.lit(False))
    weak, control = F.coalesce("weak", F.lit(False)), F.coalesce("control", F.lit(False))
    bucket = F.when(
        F.col("scope") == "target",
        F.when(is_target, "target").when(F.col("target").isNull() & control & ~weak, "control"),
    ).otherwise(F.when(is_target, "target").when(weak, "excluded").otherwise("secondary"))
    rows = rows.withColumn("bucket", bucket)
    right, missed = F.col("pred") == F.col("truth"), (F.col("truth") == "not_met") & (F.col("pred") == "met")

    def tally(name):
        inside = F.col("bucket") == name
        return [
            count_where(inside).alias(f"{name}_total"),
            count_where(inside & right).alias(f"{name}_correct"),
            count_where(inside & missed).alias(f"{name}_false_pass"),
        ]

    figures = rows.groupBy("ruleset_id").agg(
        *tally("target"),
        *tally("control"),
        *tally("secondary"),
        count_where((F.col("bucket") == "control") & ~right & (F.col("pred") == "not_met")).alias("false_alarm"),
        count_where(F.col("bucket") == "excluded").alias("excluded_weak"),
    )
    counts = [c for c in figures.columns if c != "ruleset_id"] + ["disputed_cases", "flagged_unresolved"]
    base = (
        testsets.select("ruleset_id", F.coalesce("label_scope", F.lit("full")).alias("scope"),
                        F.coalesce("approved", F.lit(False)).alias("approved"))
        .join(figures, "ruleset_id", "left")
        .join(excluded, "ruleset_id", "left")
        .select("ruleset_id", "scope", "approved", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts])
    )
    seen = F.greatest(F.col("target_total") + F.col("secondary_total") + F.col("excluded_weak"), F.lit(1))
    rate = F.col("excluded_weak") / seen
    return base.select(
        "ruleset_id",
        "scope",
        (~F.col("approved")).alias("provisional"),
        "target_total",
        "target_correct",
        "target_false_pass",
        (F.col("target_total") - F.col("target_correct") - F.col("target_false_pass")).alias("routed_to_officer"),
        "control_total",
        "control_correct",
        "false_alarm",
        "secondary_total",
        "secondary_correct",
        "secondary_false_pass",
        "excluded_weak",
        F.round(rate, 3).alias("excluded_rate"),
        ((F.col("scope") == "full") & (rate > fv.LOW_QUALITY_RATE)).alias("low_quality"),
        (F.col("target_total") < fv.SMALL_SAMPLE).alias("small_sample"),
        "disputed_cases",
        "flagged_unresolved",
    )


def measurement_status(rulesets: DataFrame, testsets: DataFrame, test_cases: DataFrame, evals: DataFrame) -> DataFrame:
    """How far each ruleset has come on the way to its own measurement.

    ``testsets`` (ruleset_id, approved, generated_at, approved_at); ``evals`` (ruleset_id, labels_generated_at,
    labels_approved_at, provisional, target and control figures).
    """
    pending = test_cases.groupBy("ruleset_id").agg(
        F.bool_or(F.col("status") == "needs_review").alias("_pending"), F.count("*").alias("n_cases")
    )
    joined = (
        rulesets.select("ruleset_id", "name", "version", F.coalesce("status", F.lit("approved")).alias("ruleset_status"))
        .join(testsets.withColumn("_set", F.lit(True)), "ruleset_id", "left")
        .join(pending, "ruleset_id", "left")
        .join(evals.withColumn("_eval", F.lit(True)), "ruleset_id", "left")
    )
    stale = (~F.col("labels_generated_at").eqNullSafe(F.col("generated_at"))) | (
        ~F.col("labels_approved_at").eqNullSafe(F.col("approved_at"))
    )
    stage = (
        F.when(F.col("_set").isNull(), fv.STAGE_NO_SET)
        .when(F.coalesce("_pending", F.lit(False)), fv.STAGE_FLAGGED)
        .when(~F.coalesce("approved", F.lit(False)), fv.STAGE_UNAPPROVED)
        .when(F.col("_eval").isNull(), fv.STAGE_NOT_RUN)
        .when(stale, fv.STAGE_STALE)
        .when(F.coalesce("provisional", F.lit(False)), fv.STAGE_PROVISIONAL)
        .otherwise(fv.STAGE_MEASURED)
    )
    return (
        joined.withColumn("stage", stage)
        .withColumn("measured", F.col("stage") == fv.STAGE_MEASURED)
        .select(
            "ruleset_id",
            "name",
            "version",
            "ruleset_status",
            F.coalesce("n_cases", F.lit(0)).alias("n_cases"),
            "measured",
            "stage",
            *[
                F.when(F.col("measured"), F.col(c)).alias(c)
                for c in ("target_correct", "target_total", "target_false_pass", "control_total", "false_alarm")
            ],
        )
    )


def measurement_headline(status: DataFrame) -> DataFrame:
    return status.agg(F.count("*").alias("n_rulesets"), count_where(F.col("measured")).alias("n_measured"))


def testset_status(testsets: DataFrame, cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Listing of the generated cases with their review state."""
    weak = labels.filter(F.coalesce("weak", F.lit(False))).groupBy("ruleset_id", "case_id").agg(F.count("*").alias("n_weak"))
    listed = cases.join(weak, ["ruleset_id", "case_id"], "left").select(
        "ruleset_id",
        "case_id",
        "target",
        F.coalesce("status", F.lit("pending_review")).alias("status"),
        F.coalesce("n_weak", F.lit(0)).alias("n_weak"),
        "guard_agree",
    )
    sets = testsets.select("ruleset_id", F.coalesce("approved", F.lit(False)).alias("approved"), "approved_by")
    return join_keyed(listed, sets, ["ruleset_id"])
