"""Quality gates for labelled test texts.

Texts are rows ``(ruleset_id, case_id, text)``; votes are two-element arrays; label rows are ``(ruleset_id, case_id,
rule_id, truth, weak, control)``. Every text gate is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.functions import text as tx
from eviflow.operators.common import computed, count_where, first_items, join_keyed, top_k

LABEL = ["ruleset_id", "case_id", "rule_id"]
CASE = ["ruleset_id", "case_id"]
MARKER = r"\[\[FACT\]\]"


# --- texts ---------------------------------------------------------------------------------------
def _found_ids(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Texts with a pattern of the rule ids they hold; no more ids than the text has words."""
    found = leaked_ids(texts, rules).groupBy(*CASE).agg(F.array_sort(F.collect_set("rule_id")).alias("_ids"))
    return texts.join(found, CASE, "left")


def _word_pattern(ids: Column) -> Column:
    quoted = F.transform(ids, lambda i: F.concat(F.lit("\\Q"), i, F.lit("\\E")))
    return F.concat(F.lit(r"(?U)\b(?:"), F.array_join(quoted, "|"), F.lit(r")\b"))


def leaked_ids(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(ruleset, case, rule_id) for rule ids that stand in a text as words.

    The text's own words are matched against the ids by an equi-join where ids are plain words; ids with other
    characters are looked for by pattern.
    """
    pattern = F.concat(F.lit(r"(?U)\b\Q"), "rule_id", F.lit(r"\E\b"))
    ids = rules.select("ruleset_id", "rule_id").distinct()
    plain = ids.filter(F.col("rule_id").rlike(r"^\w+$"))
    odd = ids.filter(~F.col("rule_id").rlike(r"^\w+$"))
    tokens = texts.select(
        *CASE, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)))).alias("rule_id")
    )
    by_word = join_keyed(tokens, plain, ["ruleset_id", "rule_id"], "left_semi").select(*LABEL)
    by_pattern = join_keyed(texts.select(*CASE, "text"), odd, ["ruleset_id"]).filter(
        F.regexp_like("text", pattern)
    ).select(*LABEL)
    return by_word.unionByName(by_pattern)


def leak_flags(text: Column | str) -> list[Column]:
    """First rule comment of a text (null when none) and whether a fact marker is left."""
    text = tx._c(text)
    comment = F.regexp_extract(text, fv.RULE_COMMENTARY, 0)
    return [
        F.when(comment != "", comment).alias("comment"),
        F.contains(text, F.lit(fv.FACT_MARKER)).alias("marker_left"),
    ]


def leak_problems(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Texts that give their answer away: leaked ids counted, the comment found, a marker left."""
    ids = leaked_ids(texts, rules).groupBy(*CASE).agg(F.count("*").alias("n_ids"), F.min("rule_id").alias("first_id"))
    return (
        texts.select(*CASE, *leak_flags("text"))
        .join(ids, CASE, "left")
        .withColumn("n_ids", F.coalesce("n_ids", F.lit(0)))
        .filter((F.col("n_ids") > 0) | F.col("comment").isNotNull() | F.col("marker_left"))
    )


def insert_fact(df: DataFrame) -> DataFrame:
    """Put ``fact`` at the first marker of ``text`` or append it; later copies of the fact are removed."""
    text, fact = F.col("text"), F.col("fact")
    at = F.locate(fv.FACT_MARKER, text)
    rest = F.replace(F.substring(text, at + len(fv.FACT_MARKER), F.length(text)), F.lit(fv.FACT_MARKER), F.lit(""))
    placed = F.concat(F.substring(text, F.lit(1), at - 1), fact, rest)
    appended = F.concat(
        F.regexp_replace(text, rf"(?U){tx.SPACE}+$", ""), F.lit("\n\nAdditional Details\n"), fact
    )
    out = df.withColumn("_t", F.when(at > 0, placed).otherwise(appended)).withColumn(
        "placement", F.when(at > 0, "marker").otherwise("appended")
    )
    cut = F.position(fact, F.col("_t")) + F.length(fact)
    once = F.concat(
        F.substring("_t", F.lit(1), cut - 1), F.replace(F.substring(F.col("_t"), cut, F.length("_t")), fact, F.lit(""))
    )
    return out.withColumn("text", F.regexp_replace(once, r"[ \t]{2,}", " ")).drop("_t")


def repair_meta(texts: DataFrame, rules: DataFrame, keep: str = "fact") -> DataFrame:
    """Drop sentences that comment on the rules or name a rule id, line by line; the kept fact always stays.

    Adds ``text`` (repaired) and ``removed`` (the sentences taken out)."""
    base = _found_ids(texts, rules).withColumn("_ids", F.coalesce(_word_pattern(F.col("_ids")), F.lit(r"(?!)")))

    def meta(s):
        kept = tx.contains_cmp(s, F.col(keep))
        return (tx.trim_space(s) != "") & (s.rlike(fv.RULE_COMMENTARY) | F.regexp_like(s, F.col("_ids"))) & ~kept

    lines = F.transform(F.split("text", "\n"), lambda line: F.split(line, fv.SENTENCE_BREAK))
    base = base.withColumn("_lines", lines)
    marked = F.transform(
        "_lines", lambda line: F.transform(line, lambda s: F.struct(s.alias("s"), meta(s).alias("out")))
    )
    base = base.withColumn("_marked", marked)
    rebuilt = F.transform(
        "_marked",
        lambda line: F.regexp_replace(
            F.array_join(F.transform(F.filter(line, lambda m: ~m["out"]), lambda m: m["s"]), " "),
            rf"(?U){tx.SPACE}+$",
            "",
        ),
    )
    removed = F.transform(F.filter(F.flatten("_marked"), lambda m: m["out"]), lambda m: tx.trim_space(m["s"]))
    return base.withColumn("text", F.array_join(rebuilt, "\n")).withColumn("removed", removed).drop("_ids", "_lines", "_marked")


def doc_problems(texts: DataFrame, limit: int | None = None) -> DataFrame:
    """Model talk and abnormal length: the phrases (``limit``: the first so many; four, as published) and the word count,
    for texts with a problem."""
    said = F.array_sort(
        F.array_distinct(
            F.transform(
                F.regexp_extract_all("text", F.lit(fv.MODEL_MONOLOGUE), F.lit(0)), lambda s: F.lower(tx.trim_space(s))
            )
        )
    )
    return (
        computed(
            texts,
            F.array_join(first_items(said, limit), ", ").alias("phrases"),
            tx.word_count("text").cast("bigint").alias("n_words"),
        )
        .withColumn("abnormal_length", ~F.col("n_words").between(fv.DOC_MIN_WORDS, fv.DOC_MAX_WORDS))
        .filter((F.col("phrases") != "") | F.col("abnormal_length"))
        .drop("text")
    )


def strip_markers(text: Column | str) -> Column:
    return F.regexp_replace(tx._c(text), rf"[ \t]*{MARKER}[ \t]*", " ")


def gate_texts(repaired: DataFrame, rules: DataFrame) -> DataFrame:
    """First gate a repaired text fails: too much removed, fact missing, answer leaked; null when it passes."""
    clean = repaired.withColumn("text", strip_markers("text"))
    leaks = leak_problems(clean, rules).select(*CASE, F.lit(True).alias("_leak"))
    fact = F.coalesce("fact", F.lit(""))
    return clean.join(leaks, CASE, "left").select(
        *CASE,
        "text",
        F.when(F.size("removed") > fv.MAX_META_REMOVED, "too_many_comments")
        .when((fact != "") & ~tx.contains_cmp("text", "fact"), "fact_missing")
        .when(F.col("_leak"), "leak")
        .alias("problem"),
    )


# --- guards and votes ----------------------------------------------------------------------------
def guard_crosscheck(decided: DataFrame, targets: DataFrame) -> DataFrame:
    """Per case: did guards fire on the target, and on how many other rules.

    ``decided`` holds the guard actions on an all-met sheet (ruleset_id, case_id, rule_id, action)."""
    fired = decided.filter(F.col("action").isin("override", "flag"))
    on_target = F.col("rule_id").eqNullSafe(F.col("target"))
    rolled = fired.join(targets.select(*CASE, "target"), CASE).groupBy(*CASE).agg(
        count_where(~on_target).alias("n_wrong"), count_where(on_target).alias("_hit")
    )
    return targets.select(*CASE).join(rolled, CASE, "left").select(
        *CASE,
        F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"),
        (F.coalesce("n_wrong", F.lit(0)) == 0).alias("clean"),
        (F.coalesce("_hit", F.lit(0)) > 0).alias("target_fired"),
    )


def map_votes(df: DataFrame) -> DataFrame:
    """Two raw answers as votes on "is the rule satisfied"; the second question asks for a violation and is turned
    round, a failed call stays visible as error."""

    def vote(answer, flip):
        a = F.coalesce(answer, F.lit("error"))
        return F.when(a == "yes", "no").when(a == "no", "yes").otherwise(a) if flip else a

    return df.withColumn("votes", F.array(vote(F.col("answer"), False), vote(F.col("answer_violation"), True)))


def classify_labels(votes: DataFrame, overridden: DataFrame) -> DataFrame:
    """Secondary label class per (ruleset, case, rule): ok, disagree or weak; a code override makes it weak."""
    vetoed = overridden.select(*LABEL).distinct().withColumn("_veto", F.lit(True))
    return votes.join(vetoed.hint("merge"), LABEL, "left").select(
        *LABEL,
        F.when(F.col("_veto"), "weak")
        .when(F.forall("votes", lambda v: v == "yes"), "ok")
        .when(F.exists("votes", lambda v: v == "yes"), "disagree")
        .otherwise("weak")
        .alias("label_class"),
    )


def label_cases(cases: DataFrame, rules: DataFrame, votes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, label rows) by construction: the target rule is violated, every other rule is met.

    ``cases (ruleset_id, case_id, target)``. A target all votes deny is clear; on the clean case the rules all votes
    affirm become controls.
    """
    rows = join_keyed(cases.select(*CASE, "target"), rules.select("ruleset_id", "rule_id"), ["ruleset_id"])
    polled = votes.select(
        *LABEL,
        F.forall("votes", lambda v: v == "yes").alias("_yes"),
        F.forall("votes", lambda v: v == "no").alias("_no"),
    )
    # Votes and classes are about as many as the rows, however well their files are packed: never broadcast.
    joined = rows.join(polled.hint("merge"), LABEL, "left").join(classes.hint("merge"), LABEL, "left")
    is_target = F.coalesce(F.col("rule_id") == F.col("target"), F.lit(False))
    labels = joined.select(
        *LABEL,
        F.when(is_target, "not_met").otherwise("met").alias("truth"),
        (~is_target & F.col("label_class").eqNullSafe("weak")).alias("weak"),
        (F.col("target").isNull() & F.coalesce("_yes", F.lit(False))).alias("control"),
    )
    clear = joined.filter(is_target).select(*CASE, F.coalesce("_no", F.lit(False)).alias("target_label_clear"))
    labelled = cases.join(clear, CASE, "left").withColumn(
        "status",
        F.when(F.col("target").isNotNull() & ~F.coalesce("target_label_clear", F.lit(False)), "needs_review").otherwise(
            "pending_review"
        ),
    )
    return labelled, labels


def select_targets(rules: DataFrame, constraints: DataFrame, hand: DataFrame, n: int | None = None) -> DataFrame:
    """Rules worth a planted violation: those with constraints or a hand guard, first ``n`` in rule order (None: all); a
    ruleset without any takes its first ``n`` rules. ``rules`` carries ``ord``."""
    guarded = constraints.select("ruleset_id", "rule_id").union(hand.select("ruleset_id", "rule_id")).distinct()
    good = rules.join(guarded, ["ruleset_id", "rule_id"], "left_semi")
    none = rules.join(good.select("ruleset_id").distinct(), "ruleset_id", "left_anti")
    order = [F.asc("ord"), F.asc("rule_id")]
    picked = good if n is None else top_k(good, ["ruleset_id"], order, n).drop("rank")
    spare = none if n is None else top_k(none, ["ruleset_id"], order, n).drop("rank")
    return picked.unionByName(spare)


# --- review of labels ----------------------------------------------------------------------------
def apply_edits(cases: DataFrame, labels: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold reviewer edits (ruleset_id, case_id, rule_id, seq, action, by) into (cases, labels, revoked rulesets).

    confirm_target clears the flag of a target case, dispute takes a case out, confirm_control and flag_weak change
    one label; the last edit of each kind decides. Every edited ruleset loses its approval.
    """
    known = edits.join(cases.select(*CASE, "target").hint("merge"), CASE)
    status_edits = known.filter(
        (F.col("action") == "dispute") | ((F.col("action") == "confirm_target") & F.col("target").isNotNull())
    )
    last = status_edits.groupBy(*CASE).agg(
        F.max_by("action", "seq").alias("_last"),
        F.bool_or(F.col("action") == "confirm_target").alias("_confirmed"),
    )
    new_cases = cases.join(last, CASE, "left").select(
        *[
            F.when(F.col("_last") == "dispute", "disputed")
            .when(F.col("_last") == "confirm_target", "pending_review")
            .otherwise(F.col("status"))
            .alias("status")
            if c == "status"
            else (F.coalesce("_confirmed", F.lit(False)) | F.coalesce(c, F.lit(False))).alias(c)
            if c == "target_label_clear"
            else F.col(c)
            for c in cases.columns
        ]
    )
    label_edits = known.filter(
        (F.col("action") == "flag_weak") | ((F.col("action") == "confirm_control") & F.col("target").isNull())
    )
    per_label = label_edits.groupBy(*LABEL).agg(
        F.max_by("action", "seq").alias("_last"), F.bool_or(F.col("action") == "flag_weak").alias("_weak")
    )
    new_labels = labels.join(per_label, LABEL, "left").select(
        *LABEL,
        "truth",
        (F.coalesce("weak", F.lit(False)) | F.coalesce("_weak", F.lit(False))).alias("weak"),
        F.when(F.col("_last") == "confirm_control", True)
        .when(F.col("_last") == "flag_weak", False)
        .otherwise(F.coalesce("control", F.lit(False)))
        .alias("control"),
    )
    reviewers = edits.groupBy("ruleset_id").agg(F.count("*").alias("n_edits"))
    return new_cases, new_labels, reviewers


def reviewers(edits: DataFrame) -> DataFrame:
    """Who disputed labels of a ruleset and so may not approve it."""
    return edits.filter((F.col("action") == "dispute") & F.col("by").isNotNull()).select("ruleset_id", "by").distinct()


def approval_report(requests: DataFrame, cases: DataFrame, edits: DataFrame, texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Approval requests (ruleset_id, approver) with the first reason that refuses them."""
    own = reviewers(edits).select("ruleset_id", F.col("by").alias("approver")).withColumn("_own", F.lit(True))
    open_cases = cases.groupBy("ruleset_id").agg(
        count_where(F.col("status") == "needs_review").alias("n_open"),
        count_where(F.coalesce("status", F.lit("")) != "disputed").alias("n_live"),
    )
    live = cases.filter(F.col("target").isNotNull() & (F.coalesce("status", F.lit("")) != "disputed"))
    leaky = leak_problems(texts.join(live.select(*CASE), CASE, "left_semi"), rules).groupBy("ruleset_id").agg(
        F.count("*").alias("n_leaky")
    )
    return (
        requests.join(own, ["ruleset_id", "approver"], "left")
        .join(open_cases, "ruleset_id", "left")
        .join(leaky, "ruleset_id", "left")
        .select(
            "ruleset_id",
            "approver",
            F.coalesce("n_open", F.lit(0)).alias("n_open"),
            F.coalesce("n_leaky", F.lit(0)).alias("n_leaky"),
            F.coalesce("n_live", F.lit(0)).alias("n_live"),
            F.when(F.col("n_live").isNull(), "no_testset")
            .when(F.col("_own"), "approver_is_reviewer")
            .when(F.col("n_open") > 0, "cases_need_review")
            .when(F.coalesce("n_leaky", F.lit(0)) > 0, "answers_leak")
            .otherwise("approved")
            .alias("outcome"),
        )
    )


# --- fact sentences ------------------------------------------------------------------------------
def confirm_facts(facts: DataFrame, rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Fact sentences (ruleset_id, case_id, rule_id, fact, votes) with the first gate they fail and what confirms
    them: a guard hit ("code") or votes that all deny the rule ("verifier")."""
    flat = F.regexp_replace(tx.collapse_space(tx.guard_norm("fact")), r'^"+|"+$', "")
    base = facts.withColumn("text", flat)
    # Each fact is judged alone, so it is looked up as a text of its own.
    fact_id = F.sha2(F.to_json(F.struct(*LABEL, "text")), 256)
    base = base.withColumn("_fact", fact_id)
    own = base.select("ruleset_id", F.col("_fact").alias("case_id"), "text").distinct()
    leaks = leak_problems(own, rules).select("ruleset_id", F.col("case_id").alias("_fact"), F.lit(True).alias("_leak")).distinct()
    fired = hits.select(*LABEL).distinct().withColumn("_hit", F.lit(True))
    joined = base.join(leaks, ["ruleset_id", "_fact"], "left").join(fired, LABEL, "left")
    denied = (F.size("votes") > 0) & F.forall("votes", lambda v: v == "no")
    problem = (
        F.when(tx.word_count("text") < 6, "too_short")
        .when(F.col("text").rlike(fv.MODEL_MONOLOGUE) | F.col("text").rlike(fv.CASE_NUMBER), "not_a_fact")
        .when(F.col("_leak"), "leak")
        .when(~F.coalesce("_hit", F.lit(False)) & ~F.coalesce(denied, F.lit(False)), "not_a_violation")
    )
    return joined.select(
        *LABEL,
        F.col("text").alias("fact"),
        problem.alias("problem"),
        F.when(problem.isNull(), F.when(F.col("_hit"), "code").otherwise("verifier")).alias("confirmed_by"),
    )


def rest_without_fact(text: Column | str, fact: Column | str) -> Column:
    return F.regexp_replace(F.replace(tx._c(text), tx._c(fact), F.lit(" ")), r"[ \t]{2,}", " ")


def contradiction_gate(texts: DataFrame) -> DataFrame:
    """Texts (text, fact, confirmed_by, rest_votes, guard_on_text) with ``rest`` and the reason that refuses them."""
    satisfied = (F.size("rest_votes") > 0) & F.forall("rest_votes", lambda v: v == "yes")
    return texts.withColumn("rest", rest_without_fact("text", "fact")).withColumn(
        "problem",
        F.when((F.col("confirmed_by") == "code") & ~F.coalesce("guard_on_text", F.lit(False)), "guard_lost").when(
            F.coalesce(satisfied, F.lit(False)), "self_contradictory"
        ),
    )
