"""Queries over registers, name screening and conflict-of-interest checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eviflow.functions import text as tx
from eviflow.functions.similarity import name_score
from eviflow.operators import assignment
from eviflow.operators import names as nm
from eviflow.plans import views as v
from eviflow.plans.registry import Tables, query, work_folder
from eviflow.sources.readers import banned_from, sanctions_from

AS_OF = "2010-06-30"


# --- registers from the star schema --------------------------------------------------------------
def banned(t: Tables) -> DataFrame:
    """Parts as banned persons, written LAST, FIRST; larger parts are banned for good or until past AS_OF."""
    turned = F.concat(F.substring_index("p_name", " ", -1), F.lit(", "), F.substring_index("p_name", " ", 1))
    end = F.when(F.col("p_size") > 40, "").when(F.col("p_size") > 20, "1/7/2010").otherwise("30/06/2009")
    rows = t.spread("part").select(
        F.col("p_partkey").alias("ord"), turned.alias("BD_PER_NAME"), F.col("p_type").alias("BD_PER_TYPE"),
        F.col("p_brand").alias("BD_PER_DOC_NUM"), F.lit("01/02/2001").alias("BD_PER_START_DT"), end.alias("BD_PER_END_DT"),
        F.lit("NSW").alias("BD_PER_ADD_STATE"), F.lit("AU").alias("BD_PER_ADD_COUNTRY"),
    )
    return banned_from(rows, AS_OF)


BANNED = """
v_banned AS (SELECT p_partkey AS ord, upper(string_split(p_name, ' ')[2]) || ' ' || upper(string_split(p_name, ' ')[1]) AS norm,
  upper(p_name) AS norm2, p_type AS type, p_brand AS doc, p_size > 20 AS active,
  string_split(p_name, ' ')[2] || ', ' || string_split(p_name, ' ')[1] AS name FROM part)
"""


@query("banned_register", v.ctes(BANNED, body="SELECT ord, name, norm, norm2, type, doc, active FROM v_banned"))
def banned_register(t: Tables) -> DataFrame:
    b = banned(t)
    return b.select("ord", "name", b.norms[0].alias("norm"), b.norms[1].alias("norm2"), "type", "doc", "active")


def _alias_rows(t: Tables) -> DataFrame:
    """Suppliers as aliases of their nation's entry; the poorest have no name, some fields are blank."""
    rich = F.col("s_acctbal") > 5000
    return t.supplier.select(
        F.col("s_suppkey").alias("ord"),
        F.concat("s_nationkey", F.when(rich, "a").otherwise("bc")).alias("Reference"),
        F.when(F.col("s_acctbal") > 500, F.col("s_name")).alias("Name of Individual or Entity"),
        F.when(F.col("s_nationkey") < 12, "Individual").otherwise("Entity").alias("Type"),
        F.lit("Primary Name").alias("Name Type"),
        F.when(rich, F.concat(F.lit("born "), "s_suppkey")).otherwise(" ").alias("Date of Birth"),
        F.lit(None).cast("string").alias("Citizenship"),
        F.when(~rich, F.concat(F.lit("list "), "s_suppkey")).alias("Committees"),
    )


@query(
    "sanctions_register",
    """
SELECT CAST(s_nationkey AS VARCHAR) AS ref, count(*) FILTER (WHERE s_acctbal > 500) AS n_aliases, coalesce(arg_min(s_name, s_suppkey) FILTER (WHERE s_acctbal > 500), '') AS first_name,
  CASE WHEN s_nationkey < 12 THEN 'Individual' ELSE 'Entity' END AS type, coalesce('born ' || min(s_suppkey) FILTER (WHERE s_acctbal > 5000), '') AS birth,
  '' AS citizenship, coalesce('list ' || min(s_suppkey) FILTER (WHERE s_acctbal <= 5000), '') AS committees, min(s_suppkey) AS ord
FROM supplier GROUP BY s_nationkey
""",
)
def sanctions_register(t: Tables) -> DataFrame:
    entries, aliases = sanctions_from(_alias_rows(t))
    first = aliases.groupBy("ref").agg(F.min_by("name", "ord").alias("first_name"))
    return entries.join(first, "ref", "left").withColumn("first_name", F.coalesce("first_name", F.lit("")))


# --- match scores in SQL -------------------------------------------------------------------------
# Block matching: the longest common block of two strings, the earliest in the first and then in the second among
# equals; then the same left and right of it. A segment of ``n = 0`` is still to be cut, the others are found blocks.
LONGEST_BLOCK = """list_max(flatten(list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(y) + 1), lambda j:
  {'n': len(list_filter(range(1, least(len(x) - i + 1, len(y) - j + 1) + 1), lambda k: substr(x, i, k) = substr(y, j, k))), 'i': -i, 'j': -j}))))"""
SCORES = f"""
v_sorted AS (SELECT DISTINCT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS p, array_to_string(list_sort(string_split(b, ' ')), ' ') AS q FROM v_ask),
v_seg AS (
  SELECT DISTINCT p, q, p AS x, q AS y, 0::BIGINT AS n FROM v_sorted
  UNION ALL
  SELECT p, q, c.x, c.y, c.n FROM (SELECT p, q, x, y, {LONGEST_BLOCK} AS m FROM v_seg WHERE n = 0 AND x <> '' AND y <> '') s,
    unnest([{{'x': substr(x, 1, -m.i - 1), 'y': substr(y, 1, -m.j - 1), 'n': 0}}, {{'x': substr(x, -m.i + m.n), 'y': substr(y, -m.j + m.n), 'n': 0}}, {{'x': '', 'y': '', 'n': m.n}}]) AS u(c)
  WHERE m.n > 0),
v_ratio AS (SELECT p, q, 2.0::DOUBLE * sum(n)::DOUBLE / (len(p) + len(q)) AS r FROM v_seg GROUP BY p, q),
v_overlap AS (SELECT s.*, r, len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::DOUBLE
  / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS j FROM v_sorted s JOIN v_ratio USING (p, q)),
v_score AS (SELECT a, b, round(greatest(r, 0.55::DOUBLE * j + 0.45::DOUBLE * r), 3)::DOUBLE AS score FROM v_overlap)
"""
ALL_PARTS = "v_ask AS (SELECT a.n AS a, b.n AS b FROM (SELECT DISTINCT upper(p_name) AS n FROM part) a CROSS JOIN (SELECT DISTINCT upper(p_name) AS n FROM part) b)"
BEST_BANNED = """
v_bhit AS (SELECT * FROM (SELECT a, name, active, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, active DESC, ord) AS rank
  FROM v_score JOIN v_banned ON norm2 = b WHERE score >= 0.78) WHERE rank <= 5)
"""


# --- screening -----------------------------------------------------------------------------------
@query(
    "banned_matches",
    v.ctes(
        BANNED, ALL_PARTS, SCORES, BEST_BANNED,
        body="SELECT a AS norm, CAST(rank AS INTEGER) AS rank, score, name AS matched_name, active, CASE WHEN score >= 0.9 THEN 'strong' ELSE 'possible' END AS strength FROM v_bhit",
    ),
)
def banned_matches(t: Tables) -> DataFrame:
    """Every part name against the banned register."""
    names = t.part.select(tx.name_norm("p_name", exotic=False).alias("norm"))
    return nm.match_banned(names, banned(t)).select("norm", "rank", "score", "matched_name", "active", "strength")


def _entries(t: Tables) -> tuple[DataFrame, DataFrame]:
    """One sanctions entry per part name and kind, brands as committees."""
    rows = t.part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("ord"), F.max("p_brand").alias("brand"))
    kind = F.when(F.col("p_type").isin("ECONOMY", "LARGE"), "Individual").when(F.col("p_type") == "PROMO", "").otherwise("Entity")
    return sanctions_from(
        rows.select(
            "ord", F.concat("ord", F.lit("a")).alias("Reference"), F.col("p_name").alias("Name of Individual or Entity"), kind.alias("Type"),
            F.lit("Primary Name").alias("Name Type"), F.lit("").alias("Date of Birth"), F.lit("AU").alias("Citizenship"), F.col("brand").alias("Committees"),
        )
    )


ENTRIES = """
v_entry AS (SELECT upper(p_name) AS norm, p_name AS name, min(p_partkey) AS ord, max(p_brand) AS brand,
  CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'Individual' WHEN p_type = 'PROMO' THEN '' ELSE 'Entity' END AS kind FROM part GROUP BY p_name, p_type),
v_ehit AS (SELECT a, e.*, score FROM v_score JOIN v_entry e ON e.norm = b WHERE score >= 0.78)
"""


@query(
    "sanctions_matches",
    v.ctes(
        ALL_PARTS, SCORES, ENTRIES,
        body="""
SELECT a AS norm, ord::VARCHAR AS ref, name AS matched_name, kind AS entity_type, score, 'AU · ' || brand AS detail, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, ord) AS rank FROM v_ehit WHERE kind <> 'Individual') WHERE rank <= 5
""",
    ),
)
def sanctions_matches(t: Tables) -> DataFrame:
    """Every part name against the sanctions entries of the wanted kind."""
    names = t.part.select(tx.name_norm("p_name", exotic=False).alias("norm"))
    hits = nm.match_sanctions(names, *_entries(t), "Entity")
    return hits.select("norm", "ref", "matched_name", "entity_type", "score", "detail", "rank")


@query(
    "register_search",
    v.ctes(
        BANNED, ALL_PARTS, SCORES, BEST_BANNED,
        body="SELECT a AS norm, CAST(rank AS INTEGER) AS rank, score, name AS matched_name, active FROM v_bhit WHERE a IN (SELECT upper(p_name) FROM part WHERE p_size > 25)",
    ),
)
def register_search(t: Tables) -> DataFrame:
    """Names of the larger parts looked up in all registers, without a kind; the banned persons found."""
    names = t.part.filter("p_size > 25").select(F.col("p_name").alias("name"))
    companies = _companies(t)
    found = nm.lookup(names, banned(t), _entries(t), companies, nm.registry_tokens(companies))[0]
    return found.select("norm", "rank", "score", "matched_name", "active")


def _parties(t: Tables) -> DataFrame:
    """Parts as applications: turned name as applicant, plain name as organisation when large."""
    turned = F.concat(F.substring_index("p_name", " ", -1), F.lit(" "), F.substring_index("p_name", " ", 1))
    return t.spread("part").select(
        F.col("p_partkey").alias("case_id"), F.when(F.col("p_size") > 10, turned).alias("applicant"),
        F.when(F.col("p_size") > 45, F.col("p_name")).otherwise("zzz qqq").alias("org"),
    )


SCREENED = v.ctes(
    BANNED, ALL_PARTS, SCORES, BEST_BANNED, ENTRIES,
    """
v_bn AS (SELECT a, bool_or(active) AS act, bool_or(active AND score >= 0.9) AS strong FROM v_bhit GROUP BY a),
v_person AS (SELECT a, max(score) AS top FROM v_ehit WHERE kind <> 'Entity' GROUP BY a),
v_org AS (SELECT a, max(score) AS top FROM v_ehit WHERE kind <> 'Individual' GROUP BY a)
""",
    body="""
SELECT p_partkey AS case_id, CASE WHEN p_size > 10 AND (coalesce(b.strong, false) OR coalesce(s.top, 0) >= 0.9) OR p_size > 45 AND coalesce(o.top, 0) >= 0.9 THEN 'review_strong'
  WHEN p_size > 10 AND (coalesce(b.act, false) OR s.top IS NOT NULL) OR p_size > 45 AND o.top IS NOT NULL THEN 'review'
  WHEN p_size > 10 AND b.a IS NOT NULL THEN 'note_expired' ELSE 'clear' END AS risk
FROM part LEFT JOIN v_bn b ON b.a = upper(p_name) LEFT JOIN v_person s ON s.a = upper(p_name) LEFT JOIN v_org o ON o.a = upper(p_name)
""",
)


@query("screen_cases", SCREENED)
def screen_cases(t: Tables) -> DataFrame:
    cases = _parties(t)
    return nm.screen_cases(cases, banned(t), _entries(t))[1].select("case_id", "risk")


@query(
    "screen_risk",
    v.ctes(
        v.V_CASES, v.V_LINES,
        body="""
SELECT c.case_id, coalesce(n, 0) AS n_hits, CASE WHEN strong THEN 'review_strong' WHEN act THEN 'review' WHEN n > 0 THEN 'note_expired' ELSE 'clear' END AS risk
FROM v_cases c LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n, bool_or(l_returnflag <> 'R') AS act, bool_or(l_returnflag <> 'R' AND l_quantity > 45) AS strong
  FROM v_lines WHERE l_discount > 0.07 GROUP BY 1) h ON h.k = c.case_id
""",
    ),
)
def screen_risk(t: Tables) -> DataFrame:
    hits = v.lines(t).filter("l_discount > 0.07").select(
        F.col("l_orderkey").alias("case_id"), (F.col("l_returnflag") != "R").alias("active"), F.when(F.col("l_quantity") > 45, "strong").otherwise("possible").alias("strength")
    )
    return nm.screen_risk(v.cases(t), hits)


@query("screening_sources", "SELECT 'banned' AS source, count(*) AS n FROM part UNION ALL SELECT 'sanctions', count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 'registry', count(*) FROM customer")
def screening_sources(t: Tables) -> DataFrame:
    return nm.screening_sources(banned(t), sanctions_from(_alias_rows(t))[0], t.customer)


def _registry(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit("A"), "c_custkey").alias("abn"), F.col("c_name").alias("name"),
        F.lit("ACT").alias("status"), F.col("c_mktsegment").alias("entity_type"), F.col("c_nationkey").cast("string").alias("state"), F.lit("2000").alias("postcode"),
        tx.name_norm("c_name", exotic=False).alias("norm"),
    )


def _companies(t: Tables) -> DataFrame:
    """Parts as registered companies: the name and a legal form by type."""
    name = F.concat("p_name", F.when(F.col("p_type") == "ECONOMY", " co").when(F.col("p_type") == "PROMO", " pty ltd").otherwise(" ltd"))
    return t.part.select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("A"), "p_partkey").alias("abn"), name.alias("name"), F.lit("ACT").alias("status"), F.col("p_type").alias("entity_type"),
        F.lit("NSW").alias("state"), F.lit("2000").alias("postcode"), tx.name_norm(name, exotic=False).alias("norm"),
    )


COMPANIES = """
v_company AS (SELECT p_partkey AS ord, p_type, upper(p_name) AS a, upper(p_name) || CASE p_type WHEN 'ECONOMY' THEN ' CO' WHEN 'PROMO' THEN ' PTY LTD' ELSE ' LTD' END AS b,
  p_name || CASE p_type WHEN 'ECONOMY' THEN ' co' WHEN 'PROMO' THEN ' pty ltd' ELSE ' ltd' END AS name FROM part),
v_ask AS (SELECT DISTINCT a, b FROM v_company)
"""


@query(
    "registry_lookup",
    v.ctes(
        COMPANIES, SCORES,
        body="""
SELECT a AS norm, CAST(rank AS INTEGER) AS rank, 'A' || ord AS abn, name, score, p_type AS entity_type FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, ord) AS rank FROM v_score JOIN v_company USING (a, b) WHERE score >= 0.70) WHERE rank <= 5
""",
    ),
)
def registry_lookup(t: Tables) -> DataFrame:
    """Every part name in a registry where many companies hold its words."""
    reg = _companies(t)
    found = nm.lookup_registry(t.part.select(tx.name_norm("p_name", exotic=False).alias("norm")), reg, nm.registry_tokens(reg))
    return found.select("norm", "rank", "abn", "name", "score", "entity_type")


@query(
    "screen_registry",
    v.ctes(
        COMPANIES, SCORES,
        body="""
SELECT p.p_partkey AS case_id, CAST(rank AS INTEGER) AS rank, 'A' || ord AS abn, score FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, ord) AS rank FROM v_score JOIN v_company USING (a, b) WHERE score >= 0.70) h
JOIN part p ON upper(p.p_name) = h.a WHERE rank <= 5 AND p_size > 45
""",
    ),
)
def screen_registry(t: Tables) -> DataFrame:
    """Registry hits of the organisations that the cases name."""
    reg = _companies(t)
    return nm.screen_registry(_parties(t), reg, nm.registry_tokens(reg)).select("case_id", "rank", "abn", "score")


@query("registry_tokens", "SELECT unnest([CASE WHEN i = 1 THEN 'CUSTOMER' ELSE substr(c_name, 10) END]) AS token, c_custkey AS ord FROM customer, (SELECT unnest([1, 2]) AS i)")
def registry_tokens(t: Tables) -> DataFrame:
    return nm.registry_tokens(_registry(t))


@query("registry_status", "SELECT count(*) AS n, count(*) > 0 AS indexed FROM customer")
def registry_status(t: Tables) -> DataFrame:
    return nm.registry_status(_registry(t))


_R = nm.fv.POSSIBLE_MATCH - nm.ROUNDING


@query(
    "name_candidates",
    f"""
WITH n AS (SELECT norm, array_to_string(list_sort(string_split(norm, ' ')), ' ') AS s, length(norm) AS len FROM (SELECT DISTINCT upper(p_name) AS norm FROM part)),
g AS (SELECT norm, bg, count(*) AS c FROM (SELECT norm, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS bg FROM n) GROUP BY 1, 2),
o AS (SELECT a.norm AS a, b.norm AS b, sum(least(a.c, b.c)) AS common FROM g a JOIN g b ON a.bg = b.bg GROUP BY 1, 2),
p AS (SELECT a.norm AS a, b.norm AS b, least(a.len, b.len) >= floor((a.len + b.len) * {_R!r}::DOUBLE / 2)
    AND coalesce(common, 0) >= greatest(ceil({1.5 * _R - 1!r}::DOUBLE * (a.len + b.len) - 1), 1) AS near,
  len(list_intersect(string_split(a.norm, ' '), string_split(b.norm, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(a.norm, ' '), string_split(b.norm, ' ')))) AS j
  FROM n a CROSS JOIN n b LEFT JOIN o ON o.a = a.norm AND o.b = b.norm)
SELECT a AS query_id, b AS ord FROM p WHERE near OR 0.55 * j + 0.45 >= {_R!r}::DOUBLE
""",
)
def name_candidates(t: Tables) -> DataFrame:
    """Pairs of different part names that may reach the match threshold."""
    names = t.spread("part").select(tx.name_norm("p_name", exotic=False).alias("norm")).distinct()
    pairs = nm.name_candidates(names.select(F.col("norm").alias("query_id"), "norm"), names.select(F.col("norm").alias("ord"), "norm"))
    return pairs.select("query_id", "ord")


@query("name_matches_low", v.ctes(ALL_PARTS, SCORES, body="SELECT a AS query_id, b AS ord, score FROM v_score WHERE score >= 0.70"))
def name_matches_low(t: Tables) -> DataFrame:
    """Pairs of part names at the level of organisations that resemble each other."""
    names = t.spread("part").select(tx.name_norm("p_name", exotic=False).alias("norm")).distinct()
    return nm.scored_pairs(names.select(F.col("norm").alias("query_id"), "norm"), names.select(F.col("norm").alias("ord"), "norm"), nm.fv.ORG_WARN)


@query(
    "name_overlap",
    """
WITH n AS (SELECT DISTINCT upper(p_name) AS norm FROM part)
SELECT a.norm AS a, b.norm AS b, round(len(list_intersect(string_split(a.norm, ' '), string_split(b.norm, ' ')))::DOUBLE
  / len(list_distinct(list_concat(string_split(a.norm, ' '), string_split(b.norm, ' ')))), 6) AS overlap
FROM n a JOIN n b ON list_has_any(string_split(a.norm, ' '), string_split(b.norm, ' '))
""",
)
def name_overlap(t: Tables) -> DataFrame:
    """Token overlap of part names that share a word."""
    names = t.spread("part").select(tx.name_norm("p_name", exotic=False).alias("norm")).distinct()
    words = names.select("norm", F.explode(tx.words("norm")).alias("w"))
    pairs = words.select(F.col("norm").alias("a"), "w").join(words.select(F.col("norm").alias("b"), "w"), "w").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(nm.token_jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("name_scores", v.ctes(ALL_PARTS, SCORES, body="SELECT a, b, score FROM v_score WHERE list_has_any(string_split(a, ' '), string_split(b, ' '))"))
def name_scores(t: Tables) -> DataFrame:
    """Scores of part names against all names that share a word."""
    names = t.spread("part").select(tx.name_norm("p_name", exotic=False).alias("norm")).distinct()
    words = names.select("norm", F.explode(tx.words("norm")).alias("w"))
    pairs = words.select(F.col("norm").alias("a"), "w").join(words.select(F.col("norm").alias("b"), "w"), "w").select("a", "b").distinct()
    return pairs.select("a", "b", name_score("a", "b").alias("score"))


# --- conflict of interest ------------------------------------------------------------------------
def _officers(t: Tables) -> DataFrame:
    """Officers of the cases, each affiliated with the organisation of the same number; number 6 is not listed."""
    n = t.orders.select((F.col("o_custkey") % 7).alias("n")).distinct().filter("n <> 6")
    return n.select(
        F.col("n").alias("ord"), F.concat(F.lit("Officer "), "n").alias("name"), F.when(F.col("n") == 2, "manager").otherwise("officer").alias("role"),
        F.array(F.concat(F.lit("org "), "n")).alias("affiliations"),
    )


COI = """
v_coi AS (SELECT case_id, officer, CASE WHEN officer = 'officer 6' THEN 'warn'
  WHEN 'org ' || right(officer, 1) = org OR (org = 'org 10' AND officer IN ('officer 0', 'officer 1')) THEN 'block' ELSE 'warn' END AS level FROM v_cases)
"""


def _levels(t: Tables) -> DataFrame:
    cases = v.cases(t).withColumn("text", F.concat(F.lit("form of "), "applicant"))
    return nm.coi_check(cases.select("case_id", "officer"), _officers(t), cases)


@query("coi_check", v.ctes(v.V_CASES, COI, body="SELECT case_id, officer, level, CAST(1 AS BIGINT) AS n_reasons, officer <> 'officer 6' AS registered FROM v_coi"))
def coi_check(t: Tables) -> DataFrame:
    return _levels(t)


@query("eligible_reviewers", v.ctes(v.V_CASES, COI, body="SELECT case_id, officer, level FROM v_coi WHERE level <> 'block'"))
def eligible_reviewers(t: Tables) -> DataFrame:
    return nm.eligible_reviewers(_levels(t))


@query("officer_roles", v.ctes(v.V_CASES, body="SELECT case_id, officer AS name, CASE officer WHEN 'officer 2' THEN 'manager' WHEN 'officer 6' THEN NULL ELSE 'officer' END AS role FROM v_cases"))
def officer_roles(t: Tables) -> DataFrame:
    return nm.officer_roles(v.cases(t).select("case_id", F.col("officer").alias("name")), _officers(t))


def _register(t: Tables) -> DataFrame:
    """Suppliers as officers, affiliated with the parts of their number and of the next."""
    part = t.part.select("p_partkey", "p_name")
    own = t.supplier.select("s_suppkey", "s_name", F.posexplode(F.array("s_suppkey", F.col("s_suppkey") + 1)).alias("pos", "p_partkey"))
    entries = own.join(part, "p_partkey").groupBy("s_suppkey", "s_name").agg(F.array_sort(F.collect_list(F.struct("pos", "p_name"))).alias("e"))
    return entries.select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.transform("e", lambda e: e["p_name"]).alias("affiliations"))


def _applications(t: Tables) -> DataFrame:
    """Parts as applications: some name an organisation, a supplier, or another name in the text."""
    turned = F.concat(F.substring_index("p_name", " ", -1), F.lit(" "), F.substring_index("p_name", " ", 1))
    supplier = F.format_string("Supplier#%09d", F.col("p_partkey") % 10)
    text = F.concat(
        F.lit("Form of "), turned, F.when(F.col("p_size") > 40, F.concat(F.lit(", with "), supplier)).otherwise(""), F.when(F.col("p_size") < 5, F.concat(F.lit(", at "), "p_name")).otherwise("")
    )
    return t.spread("part").select(
        F.col("p_partkey").alias("case_id"), F.when(F.col("p_size") == 50, supplier).otherwise(turned).alias("applicant"),
        F.when(F.col("p_size") > 30, F.concat("p_name", F.when(F.col("p_size") > 44, " ltd").otherwise(""))).alias("org"), text.alias("text"),
    )


CONFLICTS = """
v_entry0 AS (SELECT s_suppkey AS ord, s_name AS officer, pos, upper(p_name) AS aff, upper(replace(s_name, '#', ' ')) AS norm
  FROM (SELECT *, unnest([0, 1]) AS pos FROM supplier) JOIN part ON p_partkey = s_suppkey + pos),
v_known AS (SELECT ord, officer, norm, row_number() OVER (ORDER BY ord) - 1 AS place FROM (SELECT DISTINCT ord, officer, norm FROM v_entry0)),
v_app AS (SELECT p_partkey AS case_id, string_split(p_name, ' ') AS w, 'SUPPLIER ' || lpad(CAST(p_partkey % 10 AS VARCHAR), 9, '0') AS sup, p_size AS size,
  CASE WHEN p_size > 30 THEN upper(p_name) || CASE WHEN p_size > 44 THEN ' LTD' ELSE '' END ELSE '' END AS org, upper(p_name) AS name FROM part),
v_text AS (SELECT *, CASE WHEN size = 50 THEN sup ELSE upper(w[-1] || ' ' || w[1]) END AS applicant,
  'FORM OF ' || upper(w[-1] || ' ' || w[1]) || CASE WHEN size > 40 THEN ' WITH ' || sup ELSE '' END || CASE WHEN size < 5 THEN ' AT ' || name ELSE '' END AS txt FROM v_app),
v_ask AS (SELECT DISTINCT org AS a, aff AS b FROM v_text, v_entry0 WHERE org <> '' UNION SELECT DISTINCT applicant, norm FROM v_text, v_known WHERE size = 50)
"""
IN_CONFLICT = """
v_conflict AS (
  SELECT case_id, officer, CASE WHEN score >= 0.85 THEN 2 ELSE 1 END AS rank FROM v_text JOIN v_score ON a = org JOIN v_entry0 ON aff = b WHERE score >= 0.70
  UNION ALL SELECT case_id, officer, 1 FROM v_text JOIN v_score ON a = applicant AND size = 50 JOIN v_known ON norm = b WHERE score >= 0.82
  UNION ALL SELECT case_id, officer, 1 FROM v_text JOIN v_entry0 ON contains(txt, aff) LEFT JOIN v_score ON a = org AND b = aff WHERE coalesce(score, 0) < 0.70
  UNION ALL SELECT case_id, officer, 1 FROM v_text JOIN v_known ON contains(txt, norm)),
v_level AS (SELECT case_id, officer, max(rank) AS rank, count(*) AS n_reasons FROM v_conflict GROUP BY ALL)
"""


@query("assignment_conflicts", v.ctes(CONFLICTS, SCORES, IN_CONFLICT, body="SELECT case_id, officer, CASE rank WHEN 2 THEN 'block' ELSE 'warn' END AS level, n_reasons FROM v_level"))
def assignment_conflicts(t: Tables) -> DataFrame:
    """Every conflict between the whole register and all applications."""
    return assignment.case_levels(_applications(t), _register(t))


@query(
    "assignment_pool",
    v.ctes(
        CONFLICTS, SCORES, IN_CONFLICT,
        """
v_n AS (SELECT count(*) AS n FROM v_known),
v_free AS (SELECT case_id, officer, row_number() OVER (PARTITION BY case_id ORDER BY (place - CAST('0x' || substr(md5(CAST(case_id AS VARCHAR)), 1, 8) AS BIGINT) % n + n) % n) AS turn
  FROM v_text CROSS JOIN v_known CROSS JOIN v_n WHERE NOT EXISTS (SELECT 1 FROM v_level l WHERE l.case_id = v_text.case_id AND l.officer = v_known.officer)),
v_first AS (SELECT case_id, string_agg(officer, ', ' ORDER BY turn) AS suggested FROM v_free WHERE turn <= 3 GROUP BY case_id),
v_count AS (SELECT case_id, count(*) FILTER (WHERE rank = 2) AS n_blocked, count(*) FILTER (WHERE rank = 1) AS n_warned FROM v_level GROUP BY case_id)
""",
        body="""
SELECT case_id, n AS n_officers, coalesce(n_blocked, 0) AS n_blocked, coalesce(n_warned, 0) AS n_warned, n - coalesce(n_blocked, 0) - coalesce(n_warned, 0) AS n_free, coalesce(suggested, '') AS suggested
FROM v_text CROSS JOIN v_n LEFT JOIN v_count USING (case_id) LEFT JOIN v_first USING (case_id)
""",
    ),
)
def assignment_pool(t: Tables) -> DataFrame:
    """The conflict-free officers of every application, counted, and three of them."""
    return assignment.assignment_pool(_applications(t), _register(t), folder=work_folder(t)).withColumn("suggested", F.array_join("suggested", ", "))
