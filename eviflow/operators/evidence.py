"""Facts, citations and verdict assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.functions import similarity as sim
from eviflow.functions import text as tx
from eviflow.operators.common import first_items

KEY = ["case_id", "rule_id"]
#: Attestations of more characters are searched by automaton, whose time is linear in both texts.
LONG_ATTESTATION = 500


# --- facts and judgements ------------------------------------------------------------------------
def clean_facts(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Facts ``array<struct<fact, chunk_id, key_phrase>>`` with blanks dropped and chunk ids outside
    ``hits`` moved to the first hit; coverage defaults to none or partial. ``limit`` keeps the first so many (four, as published)."""
    first = F.get("hits", F.lit(0))
    kept = F.filter(first_items(F.col("facts"), limit), lambda f: F.coalesce(f["fact"], F.lit("")) != "")
    clean = F.transform(
        kept,
        lambda f: F.struct(
            tx.trim_space(f["fact"]).alias("fact"),
            F.when(F.coalesce(F.array_contains("hits", f["chunk_id"]), F.lit(False)), f["chunk_id"])
            .otherwise(first)
            .alias("chunk_id"),
            tx.trim_space(F.coalesce(f["key_phrase"], F.lit(""))).alias("key_phrase"),
        ),
    )
    facts = F.coalesce(clean, F.expr("array()").cast("array<struct<fact:string,chunk_id:int,key_phrase:string>>"))
    return df.withColumn("facts", facts).withColumn(
        "coverage", F.coalesce("coverage", F.when(F.size("facts") == 0, "none").otherwise("partial"))
    )


def clean_judgement(df: DataFrame) -> DataFrame:
    """Unknown verdicts become unclear, unknown confidences low; without facts the rule is not addressed."""
    none = F.col("n_facts") == 0
    verdict = F.when(F.col("verdict").isin(fv.VERDICTS), F.col("verdict")).otherwise("unclear")
    confidence = F.when(F.col("confidence").isin(fv.CONFIDENCES), F.col("confidence")).otherwise("low")
    return (
        df.withColumn("verdict", F.when(none, "not_addressed").otherwise(verdict))
        .withColumn("confidence", F.when(none, "high").otherwise(confidence))
        .withColumn("note", F.when(none, fv.NO_FACTS_NOTE).otherwise(F.coalesce("note", F.lit(""))))
    )


def consistency_lock(df: DataFrame) -> DataFrame:
    """A not_met that points at no fact, or rests on no coverage, becomes unclear with low confidence.

    Columns verdict, confidence, note, supporting_fact, n_facts, coverage; rows without facts keep index 0.
    """
    some = F.col("n_facts") > 0
    valid = F.coalesce(F.col("supporting_fact").between(1, F.col("n_facts")), F.lit(False))
    locked = some & (F.col("verdict") == "not_met") & (~valid | F.col("coverage").eqNullSafe("none"))
    why = F.when(~valid, "no fact states the violation").otherwise("nothing relevant was extracted")
    note = F.concat(
        F.lit(f"{fv.NOTE_LOCK} not_met without support: "), why, F.lit("; set to unclear. | "), F.coalesce("note", F.lit(""))
    )
    return (
        df.withColumn("_locked", locked)
        .withColumn("note", F.when(F.col("_locked"), note).otherwise(F.col("note")))
        .withColumn("verdict", F.when(F.col("_locked"), "unclear").otherwise(F.col("verdict")))
        .withColumn("confidence", F.when(F.col("_locked"), "low").otherwise(F.col("confidence")))
        .withColumn(
            "supporting_fact",
            F.when(~some, 0).when(valid, F.col("supporting_fact")).otherwise(1).cast("int"),
        )
        .drop("_locked")
    )


# --- citations -----------------------------------------------------------------------------------
def best_sentence(
    df: DataFrame, text: str = "chunk_text", phrase: str = "key_phrase", name: str = "aq", max_words: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """Add the verbatim sentence of ``text`` that fits ``phrase`` best; ``max_words`` cuts it (forty, as published) and
    ``max_chars`` the text that stands in where it has no sentence (200).

    A sentence that holds the whole phrase always wins; with exactly one such sentence nothing needs scoring. Only
    the remaining rows reach the similarity UDF, and only with the sentences still in question.
    """
    split = df.withColumn("_s", tx.sentence_array(text)).withColumn("_p", tx.ws_norm(phrase))
    pairs = F.transform("_s", lambda s: F.struct(s.alias("raw"), tx.ws_norm(s).alias("norm")))
    split = split.withColumn("_pairs", pairs)
    split = split.withColumn("_holding", F.filter("_pairs", lambda p: F.contains(p["norm"], F.col("_p"))))
    direct = (
        F.when(F.size("_s") == 0, F.col(text) if max_chars is None else F.substring(text, 1, max_chars))
        .when(F.col("_p") == "", F.get("_s", F.lit(0)))
        .when(F.size("_holding") == 1, F.col("_holding")[0]["raw"])
    )
    split = split.withColumn("_direct", direct).withColumn(
        "_open", F.when(F.size("_holding") > 1, F.col("_holding")).otherwise(F.col("_pairs"))
    )
    ask = F.col("_direct").isNull()
    options = F.when(ask, F.transform("_open", lambda p: p["norm"]))
    split = split.withColumn("_at", sim.best_match_index(options, F.when(ask, F.col("_p"))))
    chosen = F.coalesce("_direct", F.get(F.col("_open"), F.col("_at"))["raw"])
    return split.withColumn(name, chosen if max_words is None else tx.first_words(chosen, max_words)).drop("_s", "_p", "_pairs", "_holding", "_direct", "_open", "_at")


def cite_ok(quote: Column | str, text: Column | str) -> Column:
    """An empty quotation counts as correct."""
    quote = tx._c(quote)
    return (quote == "") | tx.quote_in_source(quote, text)


def attestation_found(attestation: Column, source: Column, min_words: int = fv.ATTEST_MIN_WORDS) -> Column:
    """Does the source hold ``min_words`` consecutive words of the attestation?"""
    words, text, n = tx.words(F.lower(attestation)), tx.ws_norm(source), F.lit(min_words)

    def held(p):
        runs = F.sequence(F.lit(1), F.size(p["words"]) - n + 1)
        found = F.exists(runs, lambda i: F.contains(p["text"], F.array_join(F.slice(p["words"], i, n), " ")))
        return F.when(F.size(p["words"]) >= n, found).otherwise(False)

    short = F.transform(F.array(F.struct(words.alias("words"), text.alias("text"))), held)[0]
    long = F.length(attestation) > LONG_ATTESTATION
    return F.when(long, sim.longest_span(F.when(long, words), F.when(long, text), n).isNotNull()).otherwise(short)


def attestation_span(df: DataFrame, min_words: int = fv.ATTEST_MIN_WORDS, name: str = "span") -> DataFrame:
    """Longest run of at least ``min_words`` words of ``attestation`` found in ``source``, the earliest among equals.

    The time for a row is linear in the lengths of both texts (:func:`similarity.longest_span`).
    """
    span = sim.longest_span(tx.words(F.lower("attestation")), tx.ws_norm("source"), F.lit(min_words))
    return df.withColumn(name, span)


def rule_verbatim_ok(rules: DataFrame, guideline: str = "guideline") -> DataFrame:
    """Does the guideline text hold the extracted quote?"""
    return rules.withColumn("verbatim_ok", F.contains(tx.ws_norm(guideline), tx.ws_norm("quote")))


def redact_letters(df: DataFrame, as_of: str, letter: str = "letter", allowed: str = "allowed") -> DataFrame:
    """Replace e-mails, phone numbers and ISO dates that the allowed input does not hold by placeholders.

    Each kind is found left to right and rewritten at its own place: the text is cut at the matches and joined with
    either the match or the placeholder.
    """

    def scrub(text: Column, pattern: str, placeholder: str, extra: str | None) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        rests = F.split(text, pattern)

        def keep(m):
            known = F.contains(F.col(allowed), m)
            return known | (m == extra) if extra else known

        shown = F.transform(hits, lambda m: F.when(keep(m), m).otherwise(F.lit(placeholder)))
        tails = F.zip_with(shown, F.slice(rests, 2, F.greatest(F.size(rests) - 1, F.lit(0))), lambda m, r: F.concat(m, r))
        return F.concat(rests[0], F.array_join(tails, ""))

    out = df.withColumn(letter, scrub(F.col(letter), fv.LETTER_EMAIL, fv.PLACEHOLDER_EMAIL, None))
    out = out.withColumn(letter, scrub(F.col(letter), fv.LETTER_PHONE, fv.PLACEHOLDER_PHONE, None))
    return out.withColumn(letter, scrub(F.col(letter), fv.LETTER_DATE, fv.PLACEHOLDER_DATE, as_of))


def letter_findings(verdicts: DataFrame, rules: DataFrame, cases: DataFrame) -> DataFrame:
    """Final findings of the signed cases, one row per rule, ``is_fail`` marking those a letter must explain."""
    signed = cases.filter(F.col("status").isin(fv.SIGNED_OR_LATER)).select("case_id", "ruleset_id")
    titled = rules.select("ruleset_id", "rule_id", "title")
    return (
        verdicts.join(signed, "case_id")
        .join(titled, ["ruleset_id", "rule_id"], "left")
        .select(
            *KEY,
            F.coalesce("title", "rule_id").alias("title"),
            "rq",
            "aq",
            F.col("final_verdict").alias("verdict"),
            F.coalesce("officer_reason", F.lit("")).alias("officer_reason"),
            (~F.col("final_verdict").eqNullSafe("met")).alias("is_fail"),
        )
    )


def restrict_rules(case_rules: DataFrame, only: DataFrame) -> DataFrame:
    """Keep the wanted rules of the cases that name any; other cases keep all their rules."""
    wanted = only.select(*KEY).distinct()
    limited = wanted.select("case_id").distinct().withColumn("_limited", F.lit(True))
    chosen = case_rules.join(wanted, KEY, "left_semi")
    free = case_rules.join(limited, "case_id", "left_anti")
    return chosen.unionByName(free)


# --- assembly ------------------------------------------------------------------------------------
def needs_attention(verdict: Column, confidence: Column, ok: Column, guard_action: Column, level: Column) -> Column:
    return (
        verdict.isin("unclear", "not_addressed")
        | (confidence == "low")
        | ~F.coalesce(ok, F.lit(False))
        | guard_action.isNotNull()
        | ((level == "needs-manual-guard") & (verdict == "met"))
    )


def assemble_verdicts(judged: DataFrame, citations: DataFrame, hits: DataFrame, levels: DataFrame, rules: DataFrame, quote_words: int | None = None) -> DataFrame:
    """Verdict rows from guarded judgements (case, rule, ruleset_id, verdict, confidence, note, action), citations
    (case, rule, aq, chunk_id, cite_ok), guard levels and rule quotes; the first retrieved chunk stands in where
    nothing was cited. ``quote_words`` cuts the rule quotes (45, as published)."""
    first = hits.filter(F.col("rank") == 1).select(*KEY, F.col("chunk_id").alias("_first"))
    quotes = rules.select("ruleset_id", "rule_id", (F.col("quote") if quote_words is None else tx.first_words("quote", quote_words)).alias("rq"))
    quote = F.coalesce("aq", F.lit(""))
    return (
        judged.join(citations, KEY, "left")
        .join(first, KEY, "left")
        .join(levels.select("ruleset_id", "rule_id", "guard_level"), ["ruleset_id", "rule_id"], "left")
        .join(quotes, ["ruleset_id", "rule_id"], "left")
        .withColumn("cite_ok", F.when(quote == "", F.lit(True)).otherwise(F.col("cite_ok")))
        .select(
            *KEY,
            F.col("verdict").alias("ai_verdict"),
            F.col("confidence").alias("ai_confidence"),
            "rq",
            quote.alias("aq"),
            F.coalesce("chunk_id", "_first").alias("chunk_id"),
            "cite_ok",
            "note",
            "guard_level",
            needs_attention(
                F.col("verdict"), F.col("confidence"), F.col("cite_ok"), F.col("action"), F.col("guard_level")
            ).alias("needs_attention"),
        )
    )


# --- model-free baseline -------------------------------------------------------------------------
def baseline_facts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """First sentence of each retrieved chunk as a fact: (case, rule, fact_no, chunk_id, fact, key_phrase)."""
    line = F.regexp_extract(tx.trim_space("text"), r"(?d)^(.*)", 1)
    sentence = F.get(F.split(tx.trim_space(line), fv.SENTENCE_BREAK), F.lit(0))
    first = chunks.select("case_id", "chunk_id", sentence.alias("_s")).withColumn("_w", tx.words("_s"))
    phrase = F.array_join(F.slice("_w", 3, 6), " ")
    return (
        hits.join(first, ["case_id", "chunk_id"])
        .filter(F.coalesce("_s", F.lit("")) != "")
        .select(
            *KEY,
            F.col("rank").alias("fact_no"),
            "chunk_id",
            F.substring("_s", 1, 160).alias("fact"),
            F.when(phrase != "", phrase).otherwise(F.substring("_s", 1, 40)).alias("key_phrase"),
        )
    )


def baseline_judgements(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """The label as verdict, unclear where none is known, resting on the first fact."""
    counted = facts.groupBy(*KEY).agg(F.count("*").cast("int").alias("n_facts"))
    return counted.join(labels.select(*KEY, "truth"), KEY, "left").select(
        *KEY,
        F.coalesce("truth", F.lit("unclear")).alias("verdict"),
        F.lit("medium").alias("confidence"),
        F.lit(1).alias("supporting_fact"),
        "n_facts",
        F.lit("partial").alias("coverage"),
        F.lit("label as verdict").alias("note"),
    )


def cite(judged: DataFrame, facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Quotation for the supporting fact of every judgement, checked against its chunk."""
    support = judged.select(*KEY, F.col("supporting_fact").alias("fact_no")).join(facts, [*KEY, "fact_no"])
    texts = chunks.select("case_id", "chunk_id", F.col("text").alias("chunk_text"))
    quoted = best_sentence(support.join(texts, ["case_id", "chunk_id"]))
    return quoted.select(*KEY, "chunk_id", "aq", cite_ok("aq", "chunk_text").alias("cite_ok"))
