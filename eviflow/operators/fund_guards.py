"""Fund-specific guards as rows of a pattern table.

Each row says how one rule of one fund is broken; a row becomes a boolean expression over the dossier text. Rows of
a rule are tried in order. All rows are evaluated row-locally in one projection, gated by the ruleset of the case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.functions import text as tx
from eviflow.operators.crosscheck import budget_values


@dataclass(frozen=True)
class Phrase:
    """The text holds the pattern."""

    pattern: str

    def broken(self, text: Column) -> Column:
        return text.rlike(self.pattern)


@dataclass(frozen=True)
class PhraseUnless:
    """The text holds the pattern, and no sentence shows the alternative branch."""

    pattern: str
    alt: str
    need: str

    def broken(self, text: Column) -> Column:
        return text.rlike(self.pattern) & ~tx.alt_satisfied(text, self.alt, self.need)


@dataclass(frozen=True)
class Sentence:
    """Some sentence holds the term without an exempting phrase."""

    pattern: str
    exempt: str

    def broken(self, text: Column) -> Column:
        hit = F.exists(tx.raw_sentences(text), lambda s: s.rlike(self.pattern) & ~s.rlike(self.exempt))
        return text.rlike(self.pattern) & hit


@dataclass(frozen=True)
class Number:
    """The first match's figure lies on the wrong side of a limit."""

    pattern: str
    op: str
    limit: int
    groups: tuple[int, ...] = (1,)
    whole: str | None = None

    def broken(self, text: Column) -> Column:
        found = F.coalesce(*[tx.first_group(text, self.pattern, g) for g in self.groups])
        return _beyond(F.replace(found, F.lit(","), F.lit("")).try_cast("double"), self.op, self.limit)


@dataclass(frozen=True)
class SentenceNumber:
    """Some sentence with the term starts its amounts on the wrong side of a limit."""

    pattern: str
    op: str
    limit: int

    def broken(self, text: Column) -> Column:
        first = _sentence_amounts(text, self.pattern, fv.SENTENCE_MONEY)
        return text.rlike(self.pattern) & F.exists(first, lambda v: _beyond(v, self.op, self.limit))


def _beyond(value: Column, op: str, limit: int) -> Column:
    test = {"<": value < limit, "<=": value <= limit, ">": value > limit}[op]
    return F.coalesce(test, F.lit(False))


def _sentence_amounts(text: Column, pattern: str, money: str) -> Column:
    """First amount of every sentence that holds the pattern."""
    values = F.transform(
        F.filter(tx.raw_sentences(text), lambda s: s.rlike(pattern)),
        lambda s: tx.parse_digits(tx.first_group(s, money)),
    )
    return F.filter(values, lambda v: v.isNotNull())


@dataclass(frozen=True)
class BudgetFloor:
    """All total budgets stay under the floor; fields named in the text or the directorate raise the floor."""

    def broken(self, text: Column) -> Column:
        directorate = F.coalesce(F.col("directorate"), F.lit(""))
        raised = directorate.rlike(fv.HIGH_FLOOR_FIELDS) | text.rlike(fv.HIGH_FLOOR_FIELDS)
        floor = F.when(raised, fv.HIGH_FLOOR).otherwise(fv.LOW_FLOOR)
        return F.coalesce(F.array_max(budget_values(text)) < floor, F.lit(False))


@dataclass(frozen=True)
class NoExcess:
    """The total reaches the threshold, but nothing of the cellar-door sales lies above it."""

    def broken(self, text: Column) -> Column:
        total = F.get(_sentence_amounts(text, fv.REBATABLE, fv.SENTENCE_MONEY_LONG), F.lit(0))
        cellar = F.get(_sentence_amounts(text, fv.CELLAR_SALES, fv.SENTENCE_MONEY_LONG), F.lit(0))
        excess = F.least(cellar, total - fv.WINE_THRESHOLD)
        reached = total.isNotNull() & cellar.isNotNull() & (total >= fv.WINE_THRESHOLD)
        return F.coalesce(reached & (excess <= 0), F.lit(False))


@dataclass(frozen=True)
class LargeEmployer:
    """A breach of the gender-equality act is stated; ``known`` asks for a headcount at the limit, else for none."""

    known: bool

    def broken(self, text: Column) -> Column:
        breach = F.exists(
            tx.raw_sentences(text), lambda s: s.rlike(fv.GENDER_ACT) & s.rlike(fv.GENDER_ACT_BREACH)
        )
        found = tx.matches(text, f"(?iu:{fv.HEADCOUNT})", {"a": 1, "b": 2})
        counts = F.transform(
            found, lambda m: tx.parse_digits(F.coalesce(F.nullif(m["a"], F.lit("")), m["b"]))
        )
        top = F.array_max(counts)
        size = F.coalesce(top >= fv.HEADCOUNT_LIMIT, F.lit(False)) if self.known else top.isNull()
        return text.rlike(fv.GENDER_ACT) & breach & size


@dataclass(frozen=True)
class Outside:
    """The first amount lies outside a closed range."""

    pattern: str
    low: int
    high: int

    def broken(self, text: Column) -> Column:
        value = tx.parse_digits(tx.first_group(text, self.pattern))
        return F.coalesce((value < self.low) | (value > self.high), F.lit(False))


def _percent(legacy: str, whole: str, op: str, limit: int, groups=(1,)):
    return Number(legacy, op, limit, groups, whole)


# (ruleset, rule, test, verdict, reason)
FUND_TABLE = [
    ("nsf-22-586", "R04", _percent(fv.TENURE_PERCENT, fv.TENURE_PERCENT_WHOLE, "<", 50), "not_met", "tenure-track share under 50%"),
    ("nsf-22-586", "R04", Phrase(fv.ASSOCIATE_TITLE), "not_met", "associate professor title"),
    ("nsf-22-586", "R05", Phrase(fv.TENURE_GRANTED), "not_met", "tenure granted"),
    ("nsf-22-586", "R07", Phrase(fv.LATE_SUBMISSION), "not_met", "fourth or later submission"),
    ("nsf-22-586", "R08", Sentence(fv.CO_LEAD, fv.CO_LEAD_EXEMPT), "not_met", "co-lead named"),
    ("nsf-22-586", "R09", Number(fv.LETTER_LENGTH, ">", 2), "not_met", "letter over 2 pages"),
    ("nsf-22-586", "R10", Number(fv.DESCRIPTION_LENGTH, ">", 15), "not_met", "description over 15 pages"),
    ("nsf-22-586", "R11", BudgetFloor(), "not_met", "total budget under the floor"),
    ("nsf-22-586", "R12", Sentence(fv.COST_SHARE, fv.COST_SHARE_EXEMPT), "not_met", "voluntary cost sharing"),
    ("au-wine-tourism-r8", "W03", SentenceNumber(fv.REBATABLE, "<", fv.WINE_THRESHOLD), "not_met", "rebatable sales under threshold"),
    ("au-wine-tourism-r8", "W04", Phrase(fv.CELLAR_USED), "not_met", "cellar-door sales used up"),
    ("au-wine-tourism-r8", "W04", NoExcess(), "not_met", "no cellar-door sales above the threshold"),
    ("au-wine-tourism-r8", "W06", PhraseUnless(fv.NO_CELLAR_DOOR, fv.RELATED_ENTITY, fv.RELATED_HOLDS), "not_met", "no physical cellar door"),
    ("au-wine-tourism-r8", "W08", _percent(fv.CELLAR_PERCENT, fv.CELLAR_PERCENT_WHOLE, "<", 50), "not_met", "cellar-door share under 50%"),
    ("au-wine-tourism-r8", "W09", Number(fv.GRANT_AMOUNT, ">", 100_000), "not_met", "request over $100,000"),
    ("au-cyber-skills-r2", "C01", Phrase(fv.SOLE_APPLICANT), "not_met", "sole applicant"),
    ("au-cyber-skills-r2", "C06", PhraseUnless(fv.NOT_ENDORSED, fv.ENDORSER, fv.ENDORSES), "not_met", "no endorsement"),
    ("au-cyber-skills-r2", "C06", PhraseUnless(fv.COSTS_UNCOVERED, fv.ENDORSER, fv.ENDORSES), "not_met", "remaining costs not covered"),
    ("au-cyber-skills-r2", "C07", SentenceNumber(fv.ELIGIBLE_SPEND, "<", 500_000), "not_met", "eligible expenditure under $500,000"),
    ("au-cyber-skills-r2", "C08", LargeEmployer(known=True), "not_met", "large employer in breach"),
    ("au-cyber-skills-r2", "C08", LargeEmployer(known=False), "unclear", "breach stated, headcount unknown"),
    ("au-female-founders-r1", "F01", _percent(fv.FEMALE_PERCENT, fv.FEMALE_PERCENT_WHOLE, "<=", 50, (1, 3)), "not_met", "no female majority"),
    ("au-female-founders-r1", "F05", Sentence(fv.TAX_EXEMPT, fv.TAX_EXEMPT_NEGATION), "not_met", "income tax exempt"),
    ("au-female-founders-r1", "F06", Outside(fv.GRANT_AMOUNT, 25_000, 480_000), "not_met", "request outside range"),
    ("au-onfarm-water", "O01", Phrase(fv.CROPPING_ONLY), "not_met", "no livestock"),
    ("au-onfarm-water", "O05", _percent(fv.INCOME_PERCENT, fv.INCOME_PERCENT_WHOLE, "<=", 50), "not_met", "income share not above 50%"),
    ("au-onfarm-water", "O06", SentenceNumber(fv.OFF_FARM, ">", 5_000_000), "not_met", "off-farm assets over $5,000,000"),
    ("au-onfarm-water", "O07", Number(fv.REBATE_AMOUNT, ">", 25_000), "not_met", "claim over $25,000"),
]


def _as_read(test, whole_percent: bool):
    if isinstance(test, Number) and test.whole and whole_percent:
        return Number(test.whole, test.op, test.limit, test.groups)
    return test


FUND_HIT = "array<struct<at:int,rule_id:string,verdict:string,reason:string>>"


def fund_array(text: Column, ruleset: Column, whole_percent: bool = True) -> Column:
    """Rows of the table that a dossier breaks, from its text in guard form, its ruleset and column ``directorate``."""
    hits = []
    for at, (of, rule, test, verdict, reason) in enumerate(FUND_TABLE):
        broken = (ruleset == of) & _as_read(test, whole_percent).broken(text)
        hit = F.struct(F.lit(at).alias("at"), F.lit(rule).alias("rule_id"), F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))
        hits.append(F.when(broken, hit))
    return F.when(ruleset.isin(list(fv.FUND_GUARD_RULES)), F.array_compact(F.array(*hits))).otherwise(F.array().cast(FUND_HIT))


def fund_hits(cases: DataFrame, whole_percent: bool = True) -> DataFrame:
    """(case, ruleset, rule, verdict, reason) for ``cases (case_id, ruleset_id, text[, directorate])``, text in guard
    form. ``whole_percent`` reads percentages as full numbers; off, it reads their last digits as published."""
    if "directorate" not in cases.columns:
        cases = cases.withColumn("directorate", F.lit(""))
    fired = cases.select("case_id", "ruleset_id", F.inline(fund_array(F.col("text"), F.col("ruleset_id"), whole_percent)))
    first = fired.groupBy("case_id", "ruleset_id", "rule_id").agg(
        F.min_by(F.struct("verdict", "reason"), "at").alias("_h")
    )
    return first.select("case_id", "ruleset_id", "rule_id", "_h.verdict", "_h.reason")
