"""Queries over the rule compiler, the guards and ruleset administration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.operators import fund_guards as fg
from eviflow.operators import guards as gd
from eviflow.plans import views as v
from eviflow.plans.registry import Tables, query


# --- rules written from parts --------------------------------------------------------------------
def part_rules(t: Tables) -> DataFrame:
    """Every part is a rule; its type decides the shape of the sentence, its brand the ruleset."""
    price = F.format_number(F.floor("p_retailprice") * 1000, 0)
    kind = F.col("p_type")
    quote = (
        F.when(kind == "ECONOMY", F.concat(F.lit("Applicants made at least $"), price, F.lit(" in sales of "), "p_name", F.lit(" items")))
        .when(kind == "STANDARD", F.concat(F.lit("Requests for "), "p_name", F.lit(" projects may not exceed $"), price))
        .when(kind == "MEDIUM", F.concat(F.lit("From $1,000 to $"), price, F.lit(" is offered and/or at least $500 for "), "p_name", F.lit(" or at least $700")))
        .when(kind == "PROMO", F.concat(F.lit("Income share of at least "), "p_size", F.lit(" per cent must come from "), "p_name", F.lit(" sales")))
        .when(kind == "LARGE", F.concat(F.lit("No "), "p_name", F.lit("s are permitted on site")))
        .otherwise(
            F.concat(F.lit("You are not eligible if you are: an individual; a "), "p_name",
                     F.lit("; an employer of 100 or more employees that has not complied with the act"))
        )
    )
    return t.spread("part").select(
        F.col("p_brand").alias("ruleset_id"), F.concat(F.lit("P"), "p_partkey").alias("rule_id"), F.col("p_partkey").alias("ord"),
        F.when(F.col("p_size") < 25, "quantitative").otherwise("qualitative").alias("type"), F.col("p_name").alias("title"), quote.alias("quote"),
    )


STOPS = ", ".join(f"'{w}'" for w in gd.fv.STOP_WORDS)
PART_CONSTRAINTS = f"""
v_part AS (SELECT *, p_brand AS ruleset_id, 'P' || p_partkey AS rule_id, CAST(floor(p_retailprice) AS BIGINT) * 1000 AS amount,
  format('{{:,}}', CAST(floor(p_retailprice) AS BIGINT) * 1000) AS money FROM part),
v_quote AS (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'Applicants made at least $' || money || ' in sales of ' || p_name || ' items'
  WHEN 'STANDARD' THEN 'Requests for ' || p_name || ' projects may not exceed $' || money
  WHEN 'PROMO' THEN 'Income share of at least ' || p_size || ' per cent must come from ' || p_name || ' sales' ELSE '' END AS q FROM v_part),
v_anchor AS (SELECT *, array_to_string(list_filter(list_transform(regexp_extract_all(q, '[A-Za-z][A-Za-z-]{{3,}}'), lambda w: lower(w)),
  lambda w: NOT list_contains([{STOPS}], w)), ' ') AS anchors FROM v_quote),
v_cons AS (
  SELECT ruleset_id, rule_id, 0 AS ord, 'money' AS kind, 'min' AS op, amount AS value, NULL AS term, 'at least $' || money AS label, anchors FROM v_anchor WHERE p_type = 'ECONOMY'
  UNION ALL SELECT ruleset_id, rule_id, 0, 'money', 'max', amount, NULL, 'may not exceed $' || money, anchors FROM v_anchor WHERE p_type = 'STANDARD'
  UNION ALL SELECT ruleset_id, rule_id, 0, 'percent', 'min', p_size, NULL, 'at least ' || p_size || ' per cent', anchors FROM v_anchor WHERE p_type = 'PROMO'
  UNION ALL SELECT ruleset_id, rule_id, 0, 'uncompilable', NULL, NULL, NULL, 'conditional threshold', NULL FROM v_part WHERE p_type = 'MEDIUM'
  UNION ALL SELECT ruleset_id, rule_id, 1, 'money', 'min', 500, NULL, 'at least $500 (rule has 2 conditional thresholds — safest one used)', '?' FROM v_part WHERE p_type = 'MEDIUM'
  UNION ALL SELECT ruleset_id, rule_id, 2, 'money', 'min', 1000, NULL, 'lower bound', '?' FROM v_part WHERE p_type = 'MEDIUM'
  UNION ALL SELECT ruleset_id, rule_id, 3, 'money', 'max', amount, NULL, 'upper bound', '?' FROM v_part WHERE p_type = 'MEDIUM'
  UNION ALL SELECT ruleset_id, rule_id, 4, 'uncompilable', NULL, NULL, NULL, 'alternative branch (OR)', NULL FROM v_part WHERE p_type = 'MEDIUM'
  UNION ALL SELECT ruleset_id, rule_id, 0, 'forbidden', NULL, NULL, p_name, 'prohibited: ' || p_name || 's', NULL FROM v_part WHERE p_type = 'LARGE'
  UNION ALL SELECT ruleset_id, rule_id, 0, 'excluded', NULL, NULL, 'individual', 'excluded: individual', NULL FROM v_part WHERE p_type = 'SMALL'
  UNION ALL SELECT ruleset_id, rule_id, 1, 'excluded', NULL, NULL, p_name, 'excluded: ' || p_name, NULL FROM v_part WHERE p_type = 'SMALL'
  UNION ALL SELECT ruleset_id, rule_id, 2, 'uncompilable', NULL, NULL, NULL, 'conditional exclusion', NULL FROM v_part WHERE p_type = 'SMALL')
"""


@query("compile_rules", v.ctes(PART_CONSTRAINTS, body="SELECT * FROM v_cons"))
def compile_rules(t: Tables) -> DataFrame:
    cons = gd.compile_rules(part_rules(t)).join(t.spread("part").select(F.concat(F.lit("P"), "p_partkey").alias("rule_id"), "p_type"), "rule_id")
    anchors = F.when((F.col("p_type") == "MEDIUM") & F.col("anchors").isNotNull(), "?").otherwise(F.array_join("anchors", " "))
    return cons.select("ruleset_id", "rule_id", "ord", "kind", "op", "value", "term", "label", anchors.alias("anchors"))


def part_levels(t: Tables) -> DataFrame:
    """Guard levels; the largest parts carry a hand guard, rules of two types lose their constraints."""
    rules = part_rules(t)
    hand = t.part.filter("p_size >= 45").select(F.col("p_brand").alias("ruleset_id"), F.concat(F.lit("P"), "p_partkey").alias("rule_id"))
    small = rules.join(t.spread("part").select(F.concat(F.lit("P"), "p_partkey").alias("rule_id"), "p_type"), "rule_id")
    reworded = small.withColumn(
        "quote",
        F.when(F.col("p_type") == "ECONOMY", F.concat("title", F.lit(" must be sound")))
        .when(F.col("p_type") == "STANDARD", F.concat("title", F.lit(" net of rebates")))
        .otherwise(F.col("quote")),
    ).drop("p_type")
    return gd.guard_level(reworded, gd.compile_rules(reworded), hand)


LEVELS = """
v_level AS (SELECT p_brand AS ruleset_id, 'P' || p_partkey AS rule_id, p_name AS title, p_size >= 45 AS hand,
  CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 0 WHEN 'MEDIUM' THEN 3 WHEN 'SMALL' THEN 2 ELSE 1 END AS n_constraints,
  CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'SMALL' THEN 1 ELSE 0 END AS n_gaps,
  CASE WHEN p_size >= 45 OR p_type NOT IN ('ECONOMY', 'STANDARD') THEN 'code-guarded' WHEN p_type = 'STANDARD' THEN 'needs-manual-guard'
    ELSE 'llm-only' END AS guard_level FROM part),
v_cover AS (SELECT ruleset_id, count(*) AS n_rules, count(*) FILTER (WHERE guard_level = 'code-guarded') AS n_guarded,
  count(*) FILTER (WHERE guard_level = 'needs-manual-guard') AS n_needs_manual, count(*) FILTER (WHERE guard_level = 'llm-only') AS n_llm_only,
  count(*) FILTER (WHERE guard_level = 'code-guarded' AND n_gaps > 0) AS n_partial,
  round_even(count(*) FILTER (WHERE guard_level = 'code-guarded')::DOUBLE / count(*), 2) AS pct FROM v_level GROUP BY 1),
v_backlog AS (SELECT ruleset_id, rule_id, title, n_gaps, CASE WHEN guard_level = 'needs-manual-guard' THEN 'high'
  WHEN guard_level = 'code-guarded' AND n_gaps > 0 THEN 'medium' WHEN guard_level = 'llm-only' THEN 'low' END AS priority FROM v_level)
"""


@query("guard_level", v.ctes(LEVELS, body="SELECT ruleset_id, rule_id, hand, n_constraints::BIGINT AS n_constraints, n_gaps::BIGINT AS n_gaps, guard_level FROM v_level"))
def guard_level(t: Tables) -> DataFrame:
    return part_levels(t).select("ruleset_id", "rule_id", "hand", "n_constraints", "n_gaps", "guard_level")


@query("ruleset_coverage", v.ctes(LEVELS, body="SELECT * FROM v_cover"))
def ruleset_coverage(t: Tables) -> DataFrame:
    return gd.coverage(part_levels(t))


@query("coverage_rows", v.ctes(PART_CONSTRAINTS, LEVELS, body="""
SELECT l.ruleset_id, l.rule_id, l.guard_level, c.ord, c.label, c.kind = 'uncompilable' AS is_gap FROM
  (SELECT ruleset_id, rule_id, CASE WHEN p_size >= 45 OR true THEN 'code-guarded' END AS guard_level FROM v_part) l
LEFT JOIN v_cons c ON c.rule_id = l.rule_id AND c.ruleset_id = l.ruleset_id
"""))
def coverage_rows(t: Tables) -> DataFrame:
    rules = part_rules(t)
    cons = gd.compile_rules(rules)
    none = rules.select("ruleset_id", "rule_id").limit(0)
    return gd.coverage_rows(gd.guard_level(rules, cons, none), cons).select("ruleset_id", "rule_id", "guard_level", "ord", "label", "is_gap")


@query("guard_backlog", v.ctes(LEVELS, body="SELECT ruleset_id, rule_id, title, priority, n_gaps::BIGINT AS n_gaps FROM v_backlog WHERE priority IS NOT NULL"))
def guard_backlog(t: Tables) -> DataFrame:
    return gd.sorted_backlog(gd.guard_backlog(part_levels(t)))


@query("backlog_counts", v.ctes(LEVELS, body="SELECT priority, count(*) AS n FROM v_backlog WHERE priority IS NOT NULL GROUP BY 1"))
def backlog_counts(t: Tables) -> DataFrame:
    return gd.backlog_counts(gd.guard_backlog(part_levels(t)))


@query(
    "approval_gate",
    v.ctes(
        LEVELS,
        body="""
SELECT c_custkey AS request_id, ruleset_id, CASE WHEN n_rules IS NULL THEN 'unknown_ruleset' WHEN approved THEN 'already_approved'
  WHEN pct < 0.5 AND NOT acknowledge THEN 'coverage_not_acknowledged' WHEN pct < 0.5 AND length(reason) < 8 THEN 'reason_required' ELSE 'approved' END AS outcome
FROM (SELECT c_custkey, 'Brand#' || c_nationkey AS ruleset_id, c_acctbal > 2000 AS acknowledge, c_mktsegment AS reason FROM customer) r
LEFT JOIN (SELECT ruleset_id, n_rules, ruleset_id > 'Brand#20' AS approved, pct - 0.3 AS pct FROM v_cover) k USING (ruleset_id)
""",
    ),
)
def approval_gate(t: Tables) -> DataFrame:
    """Customers ask for the approval of a brand's rules; coverage is read 30 points lower to meet the limit."""
    cover = gd.coverage(part_levels(t)).withColumn("pct", F.col("pct") - 0.3)
    sets = cover.select("ruleset_id", F.when(F.col("ruleset_id") > "Brand#20", "approved").otherwise("draft").alias("status"))
    requests = t.customer.select(
        F.col("c_custkey").alias("request_id"), F.concat(F.lit("Brand#"), "c_nationkey").alias("ruleset_id"),
        (F.col("c_acctbal") > 2000).alias("acknowledge"), F.col("c_mktsegment").alias("reason"),
    )
    return gd.approval_gate(requests, sets, cover).select("request_id", "ruleset_id", "outcome")


@query(
    "validate_rulesets",
    """
WITH s AS (SELECT p_brand || CASE WHEN p_size > 47 THEN ' ' || p_size || '!' ELSE '-' || p_size || '.' || p_type END AS raw, p_name, p_type FROM part),
n AS (SELECT raw, count(*) FILTER (WHERE p_name NOT LIKE 'red%') AS n FROM s GROUP BY 1)
SELECT lower(replace(raw, '#', '')) AS ruleset_id, raw AS name, n AS n_valid,
  CASE WHEN NOT regexp_full_match(lower(replace(raw, '#', '')), '[a-z0-9][a-z0-9_.-]{2,60}') THEN 'bad_id' WHEN n < 3 THEN 'too_few_rules' END AS problem, 'draft' AS status FROM n
""",
)
def validate_rulesets(t: Tables) -> DataFrame:
    raw = F.concat("p_brand", F.when(F.col("p_size") > 47, F.concat(F.lit(" "), "p_size", F.lit("!"))).otherwise(F.concat(F.lit("-"), "p_size", F.lit("."), "p_type")))
    rows = t.spread("part").select(
        F.replace(raw, F.lit("#"), F.lit("")).alias("ruleset_id"), raw.alias("name"), F.concat(F.lit("P"), "p_partkey").alias("rule_id"),
        F.when(~F.startswith("p_name", F.lit("red")), F.col("p_name")).alias("title"), F.lit("q").alias("quote"), F.lit("odd").alias("type"),
    )
    return gd.validate_rulesets(rows.select("ruleset_id", "name").distinct(), rows)


# --- guards on dossiers --------------------------------------------------------------------------
def nation_rules(t: Tables) -> DataFrame:
    """Each nation is a fund with a budget floor, a cap, a ban and a stated minimum."""
    floor = F.format_number(50000 + 10000 * F.col("n_nationkey"), 0)
    cap = F.format_number(300000 + 5000 * F.col("n_nationkey"), 0)
    rules = F.array(
        F.struct(F.lit("A1").alias("rule_id"), F.concat(F.lit("Projects need a total requested budget of at least $"), floor).alias("quote")),
        F.struct(F.lit("A2").alias("rule_id"), F.concat(F.lit("The requested budget may not exceed $"), cap).alias("quote")),
        F.struct(F.lit("A3").alias("rule_id"), F.lit("No annual turnovers are permitted in the form").alias("quote")),
        F.struct(F.lit("A4").alias("rule_id"), F.concat(F.lit("The plan must reach a minimum of $"), floor).alias("quote")),
    )
    return t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("ruleset_id"), F.inline(rules)).select(
        "*", F.when(F.col("rule_id") != "A2", "quantitative").otherwise("qualitative").alias("type"), F.lit("rule").alias("title")
    )


def nation_cases(t: Tables) -> DataFrame:
    owner = t.customer.select(F.col("c_custkey").alias("custkey"), F.concat(F.lit("N"), "c_nationkey").alias("ruleset_id"))
    return v.money_dossiers(t).join(owner, "custkey").select("case_id", "ruleset_id", "directorate", "text")


NATION_HITS = """
v_nation AS (SELECT m.*, 'N' || c_nationkey AS ruleset_id, 50000 + 10000 * c_nationkey AS lo, 300000 + 5000 * c_nationkey AS hi,
  greatest(declared, coalesce(attached, declared)) AS top FROM v_money m JOIN customer ON c_custkey = custkey),
v_comp AS (SELECT case_id, 'A1' AS rule_id FROM v_nation WHERE top < lo UNION ALL SELECT case_id, 'A2' FROM v_nation WHERE declared > hi
  UNION ALL SELECT case_id, 'A3' FROM v_nation WHERE revenue IS NOT NULL),
v_hand AS (SELECT case_id, unnest(['A4']) AS rule_id FROM v_nation WHERE top < lo)
"""


@query("guard_eval", v.ctes(v.V_MONEY, NATION_HITS, body="SELECT case_id, rule_id, 'not_met' AS verdict FROM v_comp"))
def guard_eval(t: Tables) -> DataFrame:
    """Compiled rules that dossiers break; A4 is read by the generic guard only, its anchors stand elsewhere."""
    return gd.evaluate_constraints(gd.compile_rules(nation_rules(t)), nation_cases(t)).select("case_id", "rule_id", "verdict")


@query("generic_guard", v.ctes(v.V_MONEY, NATION_HITS, body="SELECT case_id, rule_id, 'not_met' AS verdict FROM v_hand"))
def generic_guard(t: Tables) -> DataFrame:
    return gd.generic_hits(nation_rules(t), nation_cases(t)).select("case_id", "rule_id", "verdict")


@query(
    "fund_guards",
    v.ctes(
        v.V_MONEY,
        body="""
SELECT case_id, 'R11' AS rule_id, 'not_met' AS verdict FROM v_money
WHERE greatest(declared, coalesce(attached, declared)) < CASE WHEN directorate = 'BIO' THEN 500000 ELSE 400000 END
""",
    ),
)
def fund_guards(t: Tables) -> DataFrame:
    cases = v.money_dossiers(t).withColumn("ruleset_id", F.lit("nsf-22-586"))
    return fg.fund_hits(cases).select("case_id", "rule_id", "verdict")


@query(
    "guard_verdicts",
    v.ctes(
        v.V_MONEY, NATION_HITS,
        body="""
SELECT n.case_id, r.rule_id, CASE WHEN (h.case_id IS NULL AND c.case_id IS NULL) OR o.v <> 'met' THEN o.v WHEN r.rule_id <> 'A2' THEN 'not_met' ELSE 'unclear' END AS verdict,
  CASE WHEN (h.case_id IS NULL AND c.case_id IS NULL) OR o.v <> 'met' THEN 'medium' WHEN r.rule_id <> 'A2' THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN h.case_id IS NULL AND c.case_id IS NULL THEN NULL WHEN o.v <> 'met' THEN 'confirm' WHEN r.rule_id <> 'A2' THEN 'override' ELSE 'flag' END AS action,
  CASE WHEN h.case_id IS NOT NULL THEN 'hand' WHEN c.case_id IS NOT NULL THEN 'compiler' END AS source
FROM v_nation n CROSS JOIN (SELECT unnest(['A1', 'A2', 'A3', 'A4']) AS rule_id) r
JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'unclear' ELSE 'met' END AS v FROM orders) o ON o.o_orderkey = n.case_id
LEFT JOIN v_hand h ON h.case_id = n.case_id AND h.rule_id = r.rule_id LEFT JOIN v_comp c ON c.case_id = n.case_id AND c.rule_id = r.rule_id
""",
    ),
)
def guard_verdicts(t: Tables) -> DataFrame:
    """Mostly-met sheets of every dossier corrected by hand and compiled guards."""
    rules, cases = nation_rules(t), nation_cases(t)
    state = t.orders.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "unclear").otherwise("met").alias("verdict"))
    sheet = cases.select("case_id", "ruleset_id").join(rules.select("ruleset_id", "rule_id"), "ruleset_id").join(state, "case_id")
    sheet = sheet.withColumn("confidence", F.lit("medium")).withColumn("note", F.lit(""))
    done = gd.guard_verdicts(sheet, cases, rules)
    return done.select("case_id", "rule_id", "verdict", "confidence", "action", "source")


HITS = """
v_hits_hand AS (SELECT l_orderkey AS case_id, 'R' || l_linenumber AS rule_id, CASE WHEN l_quantity > 25 THEN 'not_met' ELSE 'unclear' END AS verdict FROM v_lines WHERE l_discount >= 0.07),
v_hits_comp AS (SELECT l_orderkey AS case_id, 'R' || l_linenumber AS rule_id, CASE WHEN l_returnflag = 'A' THEN 'not_met' ELSE 'unclear' END AS verdict FROM v_lines WHERE l_tax >= 0.05)
"""


@query(
    "merge_hits",
    v.ctes(
        v.V_LINES, HITS,
        body="""
SELECT coalesce(h.case_id, c.case_id) AS case_id, coalesce(h.rule_id, c.rule_id) AS rule_id,
  CASE WHEN h.verdict IS NOT NULL AND c.verdict IS NOT NULL THEN CASE WHEN 'not_met' IN (h.verdict, c.verdict) THEN 'not_met' ELSE h.verdict END ELSE coalesce(h.verdict, c.verdict) END AS hit_verdict,
  CASE WHEN h.verdict IS NULL THEN 'compiler' WHEN c.verdict IS NULL THEN 'hand' ELSE 'hand+compiler' END AS source
FROM v_hits_hand h FULL JOIN v_hits_comp c ON h.case_id = c.case_id AND h.rule_id = c.rule_id
""",
    ),
)
def merge_hits(t: Tables) -> DataFrame:
    lines = v.lines(t)
    key = [F.col("l_orderkey").alias("case_id"), F.concat(F.lit("R"), "l_linenumber").alias("rule_id")]
    hand = lines.filter("l_discount >= 0.07").select(*key, F.when(F.col("l_quantity") > 25, "not_met").otherwise("unclear").alias("verdict"), F.lit("h").alias("reason"))
    comp = lines.filter("l_tax >= 0.05").select(*key, F.when(F.col("l_returnflag") == "A", "not_met").otherwise("unclear").alias("verdict"), F.lit("c").alias("reason"))
    return gd.merge_hits(hand, comp).drop("reason")
