"""Officer decisions as feedback samples, examples and tuning rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.operators.common import first_items, join_keyed, top_k

KEY = ["case_id", "rule_id"]


def feedback_samples(cases: DataFrame, verdicts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Overridden or human-decided verdicts of signed cases."""
    signed = cases.filter(F.col("status").isin(fv.SIGNED_OR_LATER)).select(
        "case_id", F.coalesce("ruleset_id", F.lit("")).alias("ruleset"), "signed_at"
    )
    override = ~F.col("final_verdict").eqNullSafe(F.col("ai_verdict"))
    kept = verdicts.filter(override | F.col("ai_verdict").isin("unclear", "not_addressed"))
    facts = F.col("facts") if "facts" in verdicts.columns else F.array().cast("array<string>")
    joined = kept.join(signed, "case_id")
    if rules is not None:
        quotes = rules.select(F.col("ruleset_id").alias("ruleset"), "rule_id", F.col("quote").alias("rule_quote"))
        joined = join_keyed(joined, quotes, ["ruleset", "rule_id"], "left")
    else:
        joined = joined.withColumn("rule_quote", F.lit(""))
    return joined.select(
        F.date_format("signed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.col("case_id").alias("case"),
        F.col("rule_id").alias("rule"),
        F.coalesce("rule_quote", F.lit("")).alias("rule_quote"),
        facts.alias("facts"),
        "ai_verdict",
        "ai_confidence",
        "final_verdict",
        F.coalesce("officer_reason", F.lit("")).alias("officer_reason"),
        F.coalesce("aq", F.lit("")).alias("applicant_quote"),
        F.when(override, "override").otherwise("human_decided").alias("kind"),
        F.col("confirmed_by").alias("officer"),
        "ruleset",
    )


def fewshot(feedback: DataFrame, n: int = fv.FEWSHOT_LIMIT, order: str = "ord") -> DataFrame:
    """Last ``n`` overrides with facts per (rule, ruleset), oldest first in ``example_no``."""
    usable = feedback.filter((F.col("kind") == "override") & (F.size("facts") > 0) & F.col("final_verdict").isNotNull() & F.col("ai_verdict").isNotNull()).withColumn(
        "ruleset", F.coalesce("ruleset", F.lit(fv.LEGACY_RULESET))
    )
    last = top_k(usable, ["rule", "ruleset"], [F.desc(order)], n)
    return last.withColumn("example_no", (-F.col("rank")).cast("bigint")).drop("rank")


def fewshot_lines(examples: DataFrame, facts: int | None = None, reason_chars: int | None = None) -> DataFrame:
    """One prompt line per example; ``facts`` and ``reason_chars`` cut it (3 and 160, as published)."""
    stated = F.array_join(first_items(F.col("facts"), facts), "; ")
    reason = F.coalesce("officer_reason", F.lit(""))
    line = F.concat(
        F.lit('- Facts: "'), stated, F.lit('" -> AI said '), "ai_verdict", F.lit(", but the CORRECT verdict was "),
        "final_verdict", F.lit(". Officer reason: "), reason if reason_chars is None else F.substring(reason, 1, reason_chars),
    )
    return examples.select("rule", "ruleset", "example_no", line.alias("line"))


def fewshot_block(examples: DataFrame, facts: int | None = None, reason_chars: int | None = None) -> DataFrame:
    """Text block per (rule, ruleset); at most a handful of lines each, as :func:`fewshot` leaves them."""
    lines = fewshot_lines(examples, facts, reason_chars)
    head = "\nPAST OFFICER CORRECTIONS for this rule (learn from them; the officer verdict is ground truth):"
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("example_no", "line"))), lambda e: e["line"])
    return lines.groupBy("rule", "ruleset").agg(F.concat_ws("\n", F.lit(head), F.array_join(ordered, "\n")).alias("block"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Total, by kind and by rule in one pass."""
    return (
        feedback.groupingSets([[], ["kind"], ["rule"]], "kind", "rule")
        .agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
        .select(
            F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "kind").otherwise("rule").alias("slice"),
            F.coalesce("kind", "rule", F.lit("all")).alias("value"),
            "n",
        )
    )


def sft_rows(feedback: DataFrame, system: str) -> DataFrame:
    """Chat messages per sample with facts, as columns system, user and assistant."""
    numbered = F.array_join(
        F.transform("facts", lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), f)), "\n"
    )
    user = F.concat(
        F.lit("CASE "), F.col("case").cast("string"), F.lit(" — RULE "), "rule", F.lit(': "'), "rule_quote",
        F.lit('"\n\nFACTS (normalized, style removed):\n'), numbered, F.lit("\n\nDecide."),
    )
    note = F.coalesce(F.nullif("officer_reason", F.lit("")), F.lit("Per the officer's signed verdict."))
    answer = F.to_json(
        F.struct(
            F.col("final_verdict").alias("verdict"),
            F.lit("high").alias("confidence"),
            F.lit(1).alias("supporting_fact"),
            note.alias("note"),
        )
    )
    return feedback.filter(F.size("facts") > 0).select(
        "case", "rule", F.lit(system).alias("system"), user.alias("user"), answer.alias("assistant")
    )


def sft_json(rows: DataFrame) -> DataFrame:
    """One JSON document per row with the three messages."""
    messages = F.array(
        *[F.struct(F.lit(role).alias("role"), F.col(role).alias("content")) for role in ("system", "user", "assistant")]
    )
    return rows.select(F.to_json(F.struct(messages.alias("messages"))).alias("value"))
