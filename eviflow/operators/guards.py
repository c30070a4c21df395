"""Rules compiled into constraints, constraints checked against dossiers, and verdicts corrected by the hits.

Compiling is row-local over the rules. Checking reads every dossier once for the few figures and sentences a constraint
can look at, then meets its ruleset's constraints in arrays of bounded size; only hits are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.functions import text as tx
from eviflow.operators.common import computed, count_where, first_items, join_keyed, ratio
from eviflow.operators.crosscheck import budget_values
from eviflow.operators.fund_guards import fund_array

KEY = ["case_id", "rule_id"]
RULE = ["ruleset_id", "rule_id"]
CONSTRAINT = (
    "struct<kind:string,op:string,value:bigint,anchors:array<string>,term:string,label:string,"
    "conditional:boolean,alt:boolean,reason:string>"
)


# --- compiling -----------------------------------------------------------------------------------
def _constraint(kind, label, op=None, value=None, anchors=None, term=None, conditional=False, alt=False, reason=None):
    def lit(x, kind_of):
        return (x if isinstance(x, Column) else F.lit(x)).cast(kind_of)

    return F.struct(
        lit(kind, "string").alias("kind"),
        lit(op, "string").alias("op"),
        lit(value, "bigint").alias("value"),
        (anchors if isinstance(anchors, Column) else F.lit(None)).cast("array<string>").alias("anchors"),
        lit(term, "string").alias("term"),
        lit(label, "string").alias("label"),
        lit(conditional, "boolean").alias("conditional"),
        lit(alt, "boolean").alias("alt"),
        lit(reason, "string").alias("reason"),
    )


def _none() -> Column:
    return F.expr("array()").cast(f"array<{CONSTRAINT}>")


def _only_if(condition: Column, item: Column) -> Column:
    return F.when(condition, F.array(item)).otherwise(_none())


def anchor_words(segment: Column, limit: int | None = None) -> Column:
    """Identifying words of a stretch of the rule, stop words dropped; ``limit`` keeps the first so many (six, as published)."""
    found = F.transform(F.regexp_extract_all(segment, F.lit(fv.ANCHOR_WORD), F.lit(0)), F.lower)
    stop = F.array(*[F.lit(w) for w in fv.STOP_WORDS])
    return first_items(F.filter(found, lambda w: ~F.array_contains(stop, w)), limit)


def _segment(m: Column) -> Column:
    return F.concat(m["before"], m["ahead"])


def money_constraints(quote: Column) -> Column:
    """Money thresholds in reading order."""
    found = tx.matches(
        quote,
        f"(?iu:{fv.MONEY_THRESHOLD})",
        {"whole": 0, "words": 1, "figure": 2},
        before=fv.ANCHOR_WINDOW,
        ahead=fv.ANCHOR_WINDOW,
    )
    return F.transform(
        found,
        lambda m: _constraint(
            "money",
            m["whole"],
            op=F.when(m["words"].rlike(fv.MONEY_IS_MIN), "min").otherwise("max"),
            value=tx.parse_digits(m["figure"]),
            anchors=anchor_words(_segment(m)),
        ),
    )


def collapse_conditional(money: Column) -> tuple[Column, Column]:
    """(constraints, uncompilable rows): several thresholds of one direction keep only the safest."""

    def same(op):
        return F.filter(money, lambda c: c["op"] == op)

    def safest(op):
        sign = 1 if op == "min" else -1
        ranked = F.transform(same(op), lambda c, i: F.struct((c["value"] * sign).alias("v"), i.alias("i"), c.alias("c")))
        best = F.array_min(ranked)["c"]
        label = F.concat(
            best["label"],
            F.format_string(" (rule has %d conditional thresholds — safest one used)", F.size(same(op))),
        )
        return _constraint(
            "money", label, op=op, value=best["value"], anchors=best["anchors"], conditional=True
        )

    many = {op: F.size(same(op)) > 1 for op in ("min", "max")}
    kept = F.when(many["min"], F.concat(same("max"), F.array(safest("min")))).otherwise(money)
    kept = F.when(
        many["max"], F.concat(F.filter(kept, lambda c: c["op"] != "max"), F.array(safest("max")))
    ).otherwise(kept)

    def admitted(op):
        values = F.array_join(
            F.transform(same(op), lambda c: F.concat(F.lit("$"), F.format_number(c["value"], 0))), ", "
        )
        return _only_if(
            many[op],
            _constraint(
                "uncompilable", "conditional threshold", reason=F.concat(F.lit(f"several '{op}' thresholds: "), values)
            ),
        )

    return kept, F.concat(admitted("min"), admitted("max"))


def range_constraints(quote: Column, limit: int | None = None) -> Column:
    """Lower and upper bound of every money range, of the first ``limit`` where given (one, as published)."""
    found = tx.matches(
        quote, fv.MONEY_RANGE, {"low": 1, "high": 2}, before=fv.ANCHOR_WINDOW, ahead=fv.ANCHOR_WINDOW
    )
    return F.flatten(
        F.transform(
            first_items(found, limit),
            lambda m: F.array(
                _constraint("money", "lower bound", "min", tx.parse_digits(m["low"]), anchor_words(_segment(m))),
                _constraint("money", "upper bound", "max", tx.parse_digits(m["high"]), anchor_words(_segment(m))),
            ),
        )
    )


def percent_constraints(quote: Column) -> Column:
    found = tx.matches(
        quote,
        f"(?iu:{fv.PERCENT_THRESHOLD})",
        {"whole": 0, "words": 1, "figure": 2},
        before=fv.ANCHOR_WINDOW,
        ahead=fv.ANCHOR_WINDOW,
    )
    plain = F.transform(
        found,
        lambda m: _constraint(
            "percent",
            m["whole"],
            op=F.when(m["words"].rlike(fv.PERCENT_IS_MIN), "min").otherwise("max"),
            value=m["figure"].cast("bigint"),
            anchors=anchor_words(_segment(m)),
        ),
    )
    women = _constraint(
        "percent",
        "majority owned and led by women (>50%)",
        "min",
        51,
        F.array(*[F.lit(a) for a in fv.WOMEN_MAJORITY_ANCHORS]),
    )
    return F.concat(plain, _only_if(quote.rlike(fv.WOMEN_MAJORITY), women))


def forbidden_constraints(quote: Column, alt: Column) -> Column:
    found = tx.matches(quote, f"(?iu:{fv.FORBIDDEN_ITEM})", {"a": 1, "b": 2, "c": 3})

    def one(m):
        term = F.trim(F.coalesce(F.nullif(m["a"], F.lit("")), F.nullif(m["b"], F.lit("")), m["c"]))
        return _constraint(
            "forbidden", F.concat(F.lit("prohibited: "), term), term=F.regexp_replace(term, "s+$", ""), alt=alt
        )

    return F.transform(found, one)


def exclusion_constraints(quote: Column, alt: Column, limit: int | None = None) -> Column:
    """Items of an exclusion list: plain statuses become terms, the rest is admitted as uncompilable. ``limit`` keeps the
    first so many (eight, as published)."""
    listing = F.regexp_extract(quote, fv.EXCLUSION_LIST, 1)
    items = F.transform(F.split(listing, fv.EXCLUSION_SPLIT), lambda s: F.regexp_replace(s, fv.EXCLUSION_STRIP, ""))
    items = first_items(F.filter(items, lambda s: F.length(s) > 4), limit)

    def one(item):
        conditional = item.rlike(fv.EXCLUSION_CONDITIONAL)
        core = F.trim(F.split(F.regexp_replace(item, fv.EXCLUSION_ARTICLE, ""), fv.EXCLUSION_CORE_CUT)[0])
        gap = _constraint(
            "uncompilable",
            F.when(conditional, "conditional exclusion").otherwise("complex exclusion"),
            reason=F.concat(F.lit("exclusion item: "), item),
        )
        plain = _constraint("excluded", F.concat(F.lit("excluded: "), core), term=core, alt=alt)
        fits = (F.length(core) > 4) & (F.length(core) < 60)
        return F.when(conditional | (F.length(item) >= 90), gap).when(fits, plain)

    return F.filter(F.transform(items, one), lambda c: c.isNotNull())


def logic_gaps(quote: Column) -> Column:
    """Uncompilable rows for derived values and alternative branches."""
    derived = _constraint("uncompilable", "derived logic", reason="the rule compares a derived value")
    branch = _constraint(
        "uncompilable", "alternative branch (OR)", reason="the rule can be met through another entity or route"
    )
    return F.concat(
        _only_if(quote.rlike(fv.DERIVED_LOGIC), derived), _only_if(quote.rlike(fv.ALTERNATIVE_BRANCH), branch)
    )


def compile_rules(rules: DataFrame) -> DataFrame:
    """Constraints of every rule ``(ruleset_id, rule_id, quote)`` in evaluation order."""
    base = rules.select(*RULE, F.coalesce("quote", F.lit("")).alias("q"))
    q = F.col("q")
    base = base.withColumn("money", money_constraints(q)).withColumn("branch", q.rlike(fv.ALTERNATIVE_BRANCH))
    kept, admitted = collapse_conditional(F.col("money"))
    every = F.concat(
        admitted,
        kept,
        range_constraints(q),
        percent_constraints(q),
        forbidden_constraints(q, F.col("branch")),
        exclusion_constraints(q, F.col("branch")),
        logic_gaps(q),
    )
    return base.select(*RULE, F.posexplode(every).alias("ord", "c")).select(*RULE, "ord", "c.*")


# --- evaluating ----------------------------------------------------------------------------------
def _figures(sentence: Column, kind: str, pattern: str, shown: Column) -> Column:
    """Figures of a kind, which only a sentence with its sign (``shown``) can hold."""
    return F.transform(
        tx.gaps_and_figures(F.when(shown, sentence).otherwise(""), pattern),
        lambda f: F.struct(
            F.lit(kind).alias("kind"),
            F.replace(f["figure"], F.lit(","), F.lit("")).try_cast("double").alias("value"),
            F.lower(sentence).alias("sentence"),
            F.lower(F.substring(f["gap"], F.greatest(F.length(f["gap"]) - 59, F.lit(1)), F.lit(60))).alias("window"),
        ),
    )


def figure_array(text: Column, whole_percent: bool = True) -> Column:
    """Money and percent figures of a text with their sentence and the text right before them."""
    percent = fv.PERCENT_FIGURE_WHOLE if whole_percent else fv.PERCENT_FIGURE
    with_digits = F.filter(tx.raw_sentences(text), lambda s: s.rlike(r"(?iu)\$\s?\d|\d\s*(?:per cent|%)"))
    return F.flatten(
        F.transform(
            with_digits,
            lambda s: F.concat(
                _figures(s, "money", fv.MONEY_FIGURE, F.contains(s, F.lit("$"))),
                _figures(s, "percent", percent, F.contains(s, F.lit("%")) | F.contains(F.lower(s), F.lit("per cent"))),
            ),
        )
    )


def _anchored(anchors: Column, text: Column) -> Column:
    return F.size(F.filter(F.array_distinct(anchors), lambda a: F.contains(text, a)))


def _figure_hit(figures: Column, c: Column) -> Column:
    """Reason of a min or max constraint that the figures break, null when they do not; it holds the offending figure.

    A minimum is broken when every figure of a sentence on its topic lies below it, the lowest is named; a cap when one
    figure with two topic words right before it lies above it, the highest is named.
    """
    is_min = c["op"] == "min"

    def relevant(f):
        near = _anchored(c["anchors"], f["sentence"])
        right_before = _anchored(c["anchors"], f["window"])
        fits = F.when(is_min, near >= 1).otherwise((near >= 2) & (right_before >= 2))
        return (f["kind"] == c["kind"]) & fits

    def reason(values):
        top, low, limit = F.array_max(values), F.array_min(values), F.format_number(c["value"], 0)
        broken = F.when(is_min, top < c["value"]).otherwise(top > c["value"])
        figure = F.format_number(F.when(is_min, low).otherwise(top), 0)
        side = F.when(is_min, " under ").otherwise(" over ")
        return F.when(broken, F.concat(F.lit("figure "), figure, side, limit, F.lit(" ("), c["label"], F.lit(")")))

    return F.transform(F.array(F.transform(F.filter(figures, relevant), lambda f: f["value"])), reason)[0]


def _asserted(sentence: Column, kind: Column, term: Column) -> Column:
    """Is the term stated in the sentence and not negated right before or after it?"""
    quoted = F.concat(F.lit("\\Q"), term, F.lit("\\E"))
    left = f"(?<=((?s:.{{{fv.NEGATION_WIDTH}}})))"
    right = f"(?=((?s:.{{0,{fv.NEGATION_WIDTH}}})))"
    status = (kind == "excluded") & ~F.contains(term, F.lit(" "))
    pattern = F.concat(
        F.lit("(?iu)"),
        F.when(status, F.lit(fv.STATUS_VERB)).otherwise(F.lit(r"\b")),
        F.lit(left),
        quoted,
        F.when(status, F.lit(fv.STATUS_TAIL)).otherwise(F.lit("")),
        F.lit(right),
    )
    subject = tx.padded(sentence, fv.NEGATION_WIDTH)
    around = F.arrays_zip(
        F.regexp_extract_all(subject, pattern, F.lit(1)).alias("before"),
        F.regexp_extract_all(subject, pattern, F.lit(2)).alias("after"),
    )
    return F.exists(
        around,
        lambda m: ~tx.unpadded(m["before"]).rlike(fv.NEGATED_BEFORE) & ~m["after"].rlike(fv.NEGATED_AFTER),
    )


def _term_hit(sentences: Column, c: Column) -> Column:
    """Reason of a forbidden or excluded term that some sentence states, null when none does."""
    naming = F.filter(sentences, lambda s: F.contains(F.lower(s), F.lower(c["term"])))
    stated = F.exists(naming, lambda s: _asserted(s, c["kind"], c["term"]))
    return F.when(stated, F.concat(F.lit("states '"), c["term"], F.lit("' ("), c["label"], F.lit(")")))


BOOK = ["rule_id", "layer", "ord", "kind", "op", "value", "anchors", "term", "alt", "label"]
HIT = "array<struct<rule_id:string,layer:int,ord:int,verdict:string,reason:string>>"
#: Layers of hits: a fund's own guard, the guard that every ruleset gets, the compiled rules.
FUND, GENERIC, COMPILED = 0, 1, 2
#: Constraints that a dossier meets in one row; a larger ruleset is cut into several.
BUCKET = 200


def rule_book(constraints: DataFrame | None = None, rules: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """(ruleset_id, constraints): what dossiers are checked for, in arrays of about ``bucket`` at most.

    Compiled ``constraints`` and the limits of the generic guard, read from ``rules``; a ruleset of more is dealt over
    several rows by the hash of the constraint, so no array grows with a ruleset.
    """
    parts = []
    if constraints is not None:
        compiled = constraints.filter(F.col("kind") != "uncompilable").withColumn("layer", F.lit(COMPILED))
        parts.append(compiled.select("ruleset_id", *[F.trim(c).alias(c) if c == "term" else F.col(c) for c in BOOK]))
    if rules is not None:
        parts.append(generic_limits(rules).select("ruleset_id", *BOOK))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sizes = rows.groupBy("ruleset_id").agg(F.ceil(F.count("*") / bucket).alias("_n"))
    dealt = rows.join(sizes, "ruleset_id").withColumn("_bucket", F.pmod(F.xxhash64("rule_id", "layer", "ord"), F.col("_n")))
    return dealt.groupBy("ruleset_id", "_bucket").agg(F.collect_list(F.struct(*BOOK)).alias("constraints")).drop("_bucket")


def generic_limits(rules: DataFrame) -> DataFrame:
    """Limits every ruleset's dossiers are held to: a stated minimum for the total budgets, a page limit for the description."""
    quote = F.coalesce("quote", F.lit(""))
    minimum, pages = tx.parse_digits(tx.first_group(quote, fv.GENERIC_MINIMUM)), tx.first_group(quote, fv.GENERIC_PAGES).cast("bigint")

    def limit(ord_, op, value):
        return F.when(value.isNotNull(), F.struct(F.lit(ord_).alias("ord"), F.lit(op).alias("op"), value.cast("bigint").alias("value")))

    found = rules.select(*RULE, F.inline(F.array_compact(F.array(limit(0, "minimum", minimum), limit(1, "pages", pages)))))
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("anchors", "array<string>"), ("term", "string"), ("alt", "boolean"), ("label", "string"))]
    return found.select(*RULE, F.lit(GENERIC).alias("layer"), "ord", F.lit("limit").alias("kind"), "op", "value", *empty)


def _limit_hit(budget: Column, pages: Column, c: Column) -> Column:
    """Reason of a generic limit that the dossier breaks."""
    low = F.concat(F.lit("budget "), budget, F.lit(" under minimum "), c["value"])
    long = F.concat(pages, F.lit(" pages over limit "), c["value"])
    return F.when((c["op"] == "minimum") & (budget < c["value"]), low).when((c["op"] == "pages") & (pages > c["value"]), long)


def fund_rules(rules: DataFrame) -> DataFrame:
    """(ruleset_id, listed): the rules of each fund that have a guard of their own; as long as the table of such guards at most."""
    own = F.create_map(*[x for of, ids in fv.FUND_GUARD_RULES.items() for x in (F.lit(of), F.array(*[F.lit(i) for i in ids]))])
    guarded = F.array_contains(F.try_element_at(own, F.col("ruleset_id")), F.col("rule_id"))
    return rules.filter(guarded).groupBy("ruleset_id").agg(F.collect_set("rule_id").alias("listed"))


def book_arrays(book: DataFrame, cases: DataFrame, whole_percent: bool = True, funds: DataFrame | None = None) -> DataFrame:
    """``cases`` without their text and with ``hits``, an array of every guard that fires.

    One pass: a dossier is normalised once, read for its figures, sentences, budgets and pages once, and meets its
    ruleset's constraints in a row per bucket of ``book``. With ``funds`` (:func:`fund_rules`) the fund guards read it in
    the same pass. ``cases (case_id, ruleset_id, text[, directorate])`` may be a stream: nothing is grouped here.
    """
    if "directorate" not in cases.columns:
        cases = cases.withColumn("directorate", F.lit(""))
    kept = [c for c in cases.columns if c not in ("text", "directorate")]
    ready = computed(cases.select(*kept, "directorate", F.col("text").alias("_raw")), tx.guard_norm("_raw").alias("text")).drop("_raw")
    text = F.col("text")
    read = [figure_array(text, whole_percent).alias("figures"), F.lower(text).alias("low")]
    read += [F.array_max(budget_values("text")).alias("budget"), tx.first_group("text", fv.GENERIC_PAGES_FOUND).cast("bigint").alias("pages")]
    if funds is not None:
        read.append(fund_array(text, F.col("ruleset_id"), whole_percent).alias("fund"))
    met = join_keyed(computed(ready, *read).drop("directorate"), book, ["ruleset_id"], "left")

    numeric = lambda c: c["kind"].isin("money", "percent")
    limit = lambda c: c["kind"] == "limit"
    named = lambda c: ~numeric(c) & ~limit(c) & F.contains("low", F.lower(c["term"]))
    constraints = F.coalesce("constraints", F.array().cast(book.schema["constraints"].dataType))
    worth = F.filter(constraints, lambda c: (numeric(c) & (F.size("figures") > 0)) | limit(c) | F.coalesce(named(c), F.lit(False)))
    met = computed(met, worth.alias("worth"))
    met = computed(met, F.when(F.exists("worth", lambda c: ~numeric(c) & ~limit(c)), tx.raw_sentences(F.col("text"))).alias("sentences"))

    def hit(rule, layer, ord_, verdict, reason):
        return F.struct(rule.alias("rule_id"), layer.cast("int").alias("layer"), ord_.cast("int").alias("ord"), verdict.alias("verdict"), reason.alias("reason"))

    def judged(c):
        strong = numeric(c) | limit(c) | ((c["kind"] == "forbidden") & ~F.coalesce(c["alt"], F.lit(False)))
        reason = F.when(numeric(c), _figure_hit(F.col("figures"), c)).when(limit(c), _limit_hit(F.col("budget"), F.col("pages"), c))
        return hit(c["rule_id"], c["layer"], c["ord"], F.when(strong, F.lit("not_met")).otherwise("unclear"), reason.otherwise(_term_hit(F.col("sentences"), c)))

    hits = F.filter(F.transform("worth", judged).cast(HIT), lambda h: h["reason"].isNotNull())
    if funds is not None:
        met = join_keyed(met, funds, ["ruleset_id"], "left")
        own = F.filter("fund", lambda f: F.coalesce(F.array_contains("listed", f["rule_id"]), F.lit(False)))
        hits = F.concat(hits, F.transform(own, lambda f: hit(f["rule_id"], F.lit(FUND), f["at"], f["verdict"], f["reason"])).cast(HIT))
    return met.select(*kept, hits.alias("hits"))


def book_hits(book: DataFrame, cases: DataFrame, whole_percent: bool = True, funds: DataFrame | None = None) -> DataFrame:
    """(case_id, ruleset_id, rule_id, layer, ord, verdict, reason) of every guard that fires on ``cases``."""
    found = book_arrays(book, cases, whole_percent, funds)
    return found.select(*[c for c in found.columns if c != "hits"], F.inline("hits"))


def eval_constraints(constraints: DataFrame, cases: DataFrame, whole_percent: bool = True) -> DataFrame:
    """Every firing constraint on ``cases (case_id, ruleset_id, text)``."""
    return book_hits(rule_book(constraints), cases.select("case_id", "ruleset_id", "text"), whole_percent).select(*KEY, "ord", "verdict", "reason")


def first_hit(hits: DataFrame) -> DataFrame:
    """First firing constraint per (case, rule)."""
    return hits.groupBy(*KEY).agg(F.min_by(F.struct("verdict", "reason"), "ord").alias("_h")).select(
        *KEY, "_h.verdict", "_h.reason"
    )


def evaluate_constraints(constraints: DataFrame, cases: DataFrame, whole_percent: bool = True) -> DataFrame:
    """(case, rule, verdict, reason) of the compiled layer."""
    return first_hit(eval_constraints(constraints, cases, whole_percent))


def generic_hits(rules: DataFrame, cases: DataFrame) -> DataFrame:
    """Hits every ruleset gets: a stated minimum against the total budgets, a page limit against the description."""
    return first_hit(book_hits(rule_book(rules=rules), cases.select("case_id", "ruleset_id", "text")))


def dossier_hits(rules: DataFrame, cases: DataFrame, constraints: DataFrame | None = None, whole_percent: bool = True) -> DataFrame:
    """Hits of all layers with their ruleset; fund guards count for rules that are listed in ``rules`` only."""
    constraints = compile_rules(rules) if constraints is None else constraints
    return book_hits(rule_book(constraints, rules), cases, whole_percent, fund_rules(rules))


def hand_hits(rules: DataFrame, cases: DataFrame, whole_percent: bool = True) -> DataFrame:
    """Fund-specific hits, the generic ones where the fund has none."""
    found = dossier_hits(rules, cases, compile_rules(rules).limit(0), whole_percent)
    return found.groupBy(*KEY).agg(F.min_by(F.struct("verdict", "reason"), F.struct("layer", "ord")).alias("_h")).select(*KEY, "_h.verdict", "_h.reason")


def merge_layers(hits: DataFrame) -> DataFrame:
    """One hit per (case, rule) from hits of all layers, as :func:`merge_hits` gives it, in one aggregation."""
    one, by = F.struct("verdict", "reason"), F.struct("layer", "ord")
    compiled = F.col("layer") == COMPILED
    picked = hits.groupBy(*KEY).agg(F.min_by(F.when(~compiled, one), F.when(~compiled, by)).alias("_h"), F.min_by(F.when(compiled, one), F.when(compiled, by)).alias("_c"))
    return picked.select(*KEY, *merged(F.col("_h"), F.col("_c")))


def merged(hand: Column, compiled: Column) -> list[Column]:
    """hit_verdict, source and reason of a hand hit and a compiled one (structs of verdict and reason, null where none)."""
    both = hand.isNotNull() & compiled.isNotNull()
    strict = (hand["verdict"] == "not_met") | (compiled["verdict"] == "not_met")
    verdict = F.when(both & strict, "not_met").otherwise(F.coalesce(hand["verdict"], compiled["verdict"]))
    source = F.when(both, "hand+compiler").when(hand.isNotNull(), "hand").otherwise("compiler")
    reason = F.when(both, F.concat(hand["reason"], F.lit(" | "), compiled["reason"])).otherwise(F.coalesce(hand["reason"], compiled["reason"]))
    return [verdict.alias("hit_verdict"), source.alias("source"), reason.alias("reason")]


# --- merging and applying ------------------------------------------------------------------------
def hand_coverage(spark) -> DataFrame:
    """(ruleset, rule) pairs with a fund-specific guard."""
    pairs = [(s, r) for s, rules in fv.FUND_GUARD_RULES.items() for r in rules]
    return spark.createDataFrame(pairs, "ruleset_id string, rule_id string")


def merge_hits(hand: DataFrame, compiled: DataFrame) -> DataFrame:
    """One hit per (case, rule) with its source: hand, compiler or both (not_met when either says so)."""
    h = hand.select(*KEY, F.struct("verdict", "reason").alias("_h"))
    c = compiled.select(*KEY, F.struct("verdict", "reason").alias("_c"))
    return h.join(c, KEY, "full").select(*KEY, *merged(F.col("_h"), F.col("_c")))


def decide(verdicts: DataFrame, hits: DataFrame, rules: DataFrame, hand: DataFrame) -> DataFrame:
    """Attach the guard's action to verdicts (case, rule, ruleset_id, verdict): override, flag, confirm or none."""
    return decided(verdicts.join(hits, KEY, "left"), rules, hand).select(*verdicts.columns, "source", "reason", "action")


def decided(met: DataFrame, rules: DataFrame, hand: DataFrame) -> DataFrame:
    """``action`` for verdicts that carry their hit (hit_verdict, source, reason)."""
    known = rules.select(*RULE, "type").join(hand.withColumn("_hand", F.lit(True)), RULE, "left")
    is_met = F.col("verdict") == "met"
    doubt = (F.col("source") == "compiler") & F.coalesce("_hand", F.lit(False))
    strict = (F.col("type") == "quantitative") & (F.col("hit_verdict") == "not_met")
    action = (
        F.when(F.col("hit_verdict").isNull(), None)
        .when(is_met & ~doubt & strict, "override")
        .when(is_met, "flag")
        .otherwise("confirm")
    )
    return join_keyed(met, known, RULE, "left").select(*met.columns, action.alias("action"))


def apply_guard(df: DataFrame) -> DataFrame:
    """Correct verdict, confidence and note by the action; nothing is ever raised to met."""
    action = F.col("action")
    note = F.coalesce("note", F.lit(""))

    def marked(mark):
        return F.concat(F.lit(mark + " "), F.coalesce("reason", F.lit("")), F.lit(" | "), note)

    return (
        df.withColumn(
            "note",
            F.when(action == "override", marked(fv.NOTE_BLOCKED)).when(action == "flag", marked(fv.NOTE_SUSPECTED)).otherwise(note),
        )
        .withColumn("verdict", F.when(action == "override", "not_met").when(action == "flag", "unclear").otherwise(F.col("verdict")))
        .withColumn("confidence", F.when(action == "override", "high").when(action == "flag", "low").otherwise(F.col("confidence")))
    )


def guard_verdicts(
    verdicts: DataFrame, cases: DataFrame, rules: DataFrame, constraints: DataFrame | None = None, whole_percent: bool = True
) -> DataFrame:
    """The whole guard layer over verdicts (case, rule, ruleset_id, verdict, confidence, note)."""
    hits = merge_layers(dossier_hits(rules, cases, constraints, whole_percent))
    return apply_guard(decide(verdicts, hits, rules, hand_coverage(rules.sparkSession)))


# --- coverage ------------------------------------------------------------------------------------
def guard_level(rules: DataFrame, constraints: DataFrame, hand: DataFrame) -> DataFrame:
    """Protection level per rule with its runnable constraints and gaps counted."""
    counts = constraints.groupBy(*RULE).agg(
        count_where(F.col("kind") != "uncompilable").alias("n_constraints"),
        count_where(F.col("kind") == "uncompilable").alias("n_gaps"),
    )
    has_hand = F.coalesce("_hand", F.lit(False))
    n, gaps = F.coalesce("n_constraints", F.lit(0)), F.coalesce("n_gaps", F.lit(0))
    return (
        rules.join(counts, RULE, "left")
        .join(hand.withColumn("_hand", F.lit(True)), RULE, "left")
        .select(
            *rules.columns,
            has_hand.alias("hand"),
            n.alias("n_constraints"),
            gaps.alias("n_gaps"),
            F.when(has_hand | (n > 0), "code-guarded")
            .when(gaps > 0, "needs-manual-guard")
            .otherwise("llm-only")
            .alias("guard_level"),
        )
    )


def coverage(levels: DataFrame) -> DataFrame:
    """Counts per level and covered share of every ruleset; ``n_partial`` are guarded rules that still have gaps."""
    level = F.col("guard_level")
    counts = levels.groupBy("ruleset_id").agg(
        F.count("*").alias("n_rules"),
        count_where(level == "code-guarded").alias("n_guarded"),
        count_where(level == "needs-manual-guard").alias("n_needs_manual"),
        count_where(level == "llm-only").alias("n_llm_only"),
        count_where((level == "code-guarded") & (F.col("n_gaps") > 0)).alias("n_partial"),
    )
    # bround: halves go to the even neighbour, as the published figures do
    return counts.withColumn("pct", F.bround(ratio(F.col("n_guarded"), F.col("n_rules")), 2))


def coverage_rows(levels: DataFrame, constraints: DataFrame) -> DataFrame:
    """Constraint labels and gap reasons of every rule, one row each."""
    listed = levels.select(*RULE, "title", "guard_level", "hand")
    return listed.join(constraints.select(*RULE, "ord", "kind", "label", "reason"), RULE, "left").select(
        *RULE, "title", "guard_level", "hand", "ord", "label", (F.col("kind") == "uncompilable").alias("is_gap"), "reason"
    )


def guard_backlog(levels: DataFrame) -> DataFrame:
    """Rules without full protection by priority."""
    level = F.col("guard_level")
    priority = (
        F.when(level == "needs-manual-guard", "high")
        .when((level == "code-guarded") & (F.col("n_gaps") > 0), "medium")
        .when(level == "llm-only", "low")
    )
    return levels.withColumn("priority", priority).filter(F.col("priority").isNotNull()).select(
        *RULE, "title", "priority", "n_gaps"
    )


def sorted_backlog(backlog: DataFrame) -> DataFrame:
    order = F.create_map(*[F.lit(x) for i, p in enumerate(fv.PRIORITIES) for x in (p, i)])
    return backlog.orderBy(order[F.col("priority")], *RULE)


def backlog_counts(backlog: DataFrame) -> DataFrame:
    return backlog.groupBy("priority").agg(F.count("*").alias("n"))


def approval_gate(requests: DataFrame, rulesets: DataFrame, cover: DataFrame) -> DataFrame:
    """Outcome of approval requests (ruleset_id, officer, acknowledge, reason)."""
    low = F.col("pct") < fv.MIN_COVERAGE
    state = rulesets.select("ruleset_id", F.coalesce("status", F.lit("approved")).alias("_status"))
    return (
        requests.join(state, "ruleset_id", "left")
        .join(cover.select("ruleset_id", "pct"), "ruleset_id", "left")
        .select(
            *requests.columns,
            F.when(F.col("_status").isNull(), "unknown_ruleset")
            .when(F.col("_status") == "approved", "already_approved")
            .when(low & ~F.coalesce("acknowledge", F.lit(False)), "coverage_not_acknowledged")
            .when(low & (F.length(tx.trim_space(F.coalesce("reason", F.lit("")))) < fv.MIN_REASON), "reason_required")
            .otherwise("approved")
            .alias("outcome"),
        )
    )


def complete_rules(rules: DataFrame) -> DataFrame:
    """Rules with id, title and quote; unknown types count as qualitative."""

    def filled(name):
        return F.coalesce(F.col(name), F.lit("")) != ""

    kept = rules.filter(filled("rule_id") & filled("quote") & filled("title"))
    return kept.withColumn("type", F.when(F.col("type").isin(fv.RULE_TYPES), F.col("type")).otherwise("qualitative"))


def validate_rulesets(rulesets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rulesets as saved (draft) with the first problem that refuses them."""
    n = complete_rules(rules).groupBy("ruleset_id").agg(F.count("*").alias("n_valid"))
    rid = F.lower(tx.trim_space("ruleset_id"))
    return rulesets.join(n, "ruleset_id", "left").select(
        rid.alias("ruleset_id"),
        "name",
        F.coalesce("n_valid", F.lit(0)).alias("n_valid"),
        F.when(~rid.rlike(fv.RULESET_ID), "bad_id")
        .when(F.coalesce("n_valid", F.lit(0)) < fv.MIN_RULES, "too_few_rules")
        .alias("problem"),
        F.lit("draft").alias("status"),
    )
