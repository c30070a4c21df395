"""Name screening against registers, and conflict-of-interest checks.

A register row is ``(ord, name, norm, ...)``. Fuzzy matches start from an equi-join on shared pieces of names that
provably every match has, so no name meets a whole register; scoring by UDF sees only pairs that pass the bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.functions import text as tx
from eviflow.functions.similarity import name_score, token_jaccard
from eviflow.operators.common import computed, count_where, join_keyed, top_k

ROUNDING = 0.0005
# Letters by falling frequency in English names; rarer pieces sort first so that the kept prefix is selective.
BY_FREQUENCY = " EATIONRSLHDCMUPGYBFWKVJXQZ0123456789"
RARE_FIRST = "".join(sorted("abcdefghijklmnopqrstuvwxyz0123456789~", reverse=True))


def strength(score: Column) -> Column:
    return F.when(score >= fv.STRONG_MATCH, "strong").otherwise("possible")


# --- candidate pairs -----------------------------------------------------------------------------
#
# Let r = 2M / S be the block ratio of two names of total length S. The matching characters M lie in at most
# S - 2M + 1 blocks, and a block of n characters holds n - 1 common bigrams, so the names share at least
# 3M - S - 1 bigrams. With r at the threshold this is (1.5 r - 1) S - 1, and lengths may differ only by the factor
# r / (2 - r). Two bigram multisets with that overlap must meet within their rarest pieces (prefix filter).
# A score above the threshold with a lower r needs token overlap of at least (t - 0.45) / 0.55, for which the same
# prefix argument holds on tokens.
#
# Where (1.5 r - 1) S is 1 or less no bigram is certain: at 0.70 up to S = 20. Such names share M >= r S / 2 letters, so
# in one order of letters (the rarest first) the first three common ones lie in both names' first n - M + 3: they meet
# on a combination of three letters (of two where both have three letters or fewer).


def _bigrams(coded: Column) -> Column:
    return F.when(
        F.length(coded) >= 2,
        F.transform(F.sequence(F.lit(1), F.length(coded) - 1), lambda i: F.substring(coded, i, F.lit(2))),
    ).otherwise(F.array().cast("array<string>"))


def _numbered(pieces: Column) -> Column:
    """Pieces with their occurrence number, so that repeated ones stay apart; rarest first."""
    return F.array_sort(
        F.transform(
            pieces,
            lambda p, i: F.concat(p, F.size(F.filter(F.slice(pieces, 1, i + 1), lambda q: q == p)).cast("string")),
        )
    )


def _shared(r: float, total: Column) -> Column:
    """Bigrams two names of this total length share at least when their block ratio is ``r``."""
    return F.greatest(F.ceil((1.5 * r - 1) * total - 1), F.lit(1))


def _combined(items: Column, k: int) -> Column:
    """All combinations of ``k`` of an array's items, in its order, each as one string."""
    if k == 1:
        return items
    rest = lambda i: F.slice(items, i + 2, F.size(items))
    return F.flatten(F.transform(items, lambda x, i: F.transform(_combined(rest(i), k - 1), lambda y: F.concat(x, y))))


def _with_letter_keys(df: DataFrame, r: float, longest: int) -> DataFrame:
    """``letters`` of a name, and ``letter_keys``: what one of ``longest`` letters or fewer is found by where no bigram is certain."""
    none = F.array().cast("array<string>")
    n = F.size("letters")
    df = computed(df, F.transform(F.sequence(F.lit(1), F.length("coded")), lambda i: F.substring(F.col("coded"), i, F.lit(1))).alias("chars"))
    df = computed(df, _numbered(F.col("chars")).alias("letters")).drop("chars")
    first = F.slice("letters", 1, (n - F.ceil(n * (r / (2 - r)) - 1e-9) + 3).cast("int"))
    df = computed(df, F.when(n <= longest, first).otherwise(none).alias("first"))
    pairs = F.when(n <= 3, _combined(F.col("letters"), 2)).otherwise(none)
    return computed(df, F.concat(_combined(F.col("first"), 3), pairs).alias("letter_keys")).drop("first")


def _profile(df: DataFrame, key: str, norm: str, threshold: float, certain: int) -> DataFrame:
    """Per name: sorted form, numbered bigrams, tokens, and the pieces it is found by."""
    r = threshold - ROUNDING
    base = df.select(F.col(key).alias("id"), F.col(norm).alias("norm"))
    base = base.withColumn("coded", F.translate(tx.token_sort("norm"), BY_FREQUENCY, RARE_FIRST))
    base = base.withColumn("pieces", _bigrams(F.col("coded")))
    base = base.withColumn("grams", _numbered(F.col("pieces"))).withColumn("tokens", F.array_distinct(tx.words("norm")))
    n = F.length("norm")
    needed = _shared(r, n / (1 - r / 2))
    keep = F.greatest(F.size("grams") - needed + 1, F.lit(0)).cast("int")
    least = F.ceil(F.size("tokens") * ((r - 0.45) / 0.55) - 1e-9)
    token_keep = (F.size("tokens") - least + 1).cast("int")
    # Longer tokens are rarer than short ones; any fixed order is valid.
    ranked = F.transform(
        F.array_sort(F.transform("tokens", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"]
    )
    letters = []
    if certain:
        base = _with_letter_keys(base, r, int(certain * (2 - r) / 2))
        letters = ["letters", "letter_keys"]
    return base.select(
        "id",
        "norm",
        n.alias("len"),
        "grams",
        F.slice("grams", 1, keep).alias("gram_keys"),
        F.slice(ranked, 1, F.greatest(token_keep, F.lit(1))).alias("token_keys"),
        *letters,
    )


def name_candidates(
    queries: DataFrame, register: DataFrame, threshold: float = fv.POSSIBLE_MATCH, min_length: int = fv.MIN_QUERY_NAME
) -> DataFrame:
    """All pairs (query_id, ord) whose score can reach the threshold.

    ``queries (query_id, norm)``, names under ``min_length`` letters are passed over, and ``register (ord, norm)``. Every
    pair scoring at or above the threshold is returned, each once; thresholds under 0.70 are refused, as so many pairs
    share no piece of use there.
    """
    if threshold < fv.ORG_WARN:
        raise ValueError("candidate pieces are guaranteed for thresholds of 0.70 and above only")
    r = threshold - ROUNDING
    certain = int(1 / (1.5 * r - 1))  # the total length up to which no common bigram is certain
    if min_length + math.ceil(min_length * r / (2 - r)) > certain:
        certain = 0
    q = _profile(queries.filter(F.length("norm") >= min_length), "query_id", "norm", threshold, certain)
    reg = _profile(register.filter(F.length("norm") >= 1), "ord", "norm", threshold, certain)
    right = reg.select(*[F.col(c).alias(f"r_{c}") for c in reg.columns])

    total = F.col("len") + F.col("r_len")
    common = F.size(F.array_intersect("grams", "r_grams"))
    near = (F.least("len", "r_len") >= F.floor(total * r / 2)) & (common >= _shared(r, total))
    enough = F.size(F.array_intersect("letters", "r_letters")) >= F.ceil(total * (r / 2) - 1e-9) if certain else F.lit(True)

    def met_once(keys: str, other: str) -> Column:
        """The joined piece is the first one both sides are found by, so a pair appears once."""
        return F.array_min(F.array_intersect(keys, other)) == F.col("piece")

    def met_on(keys: str, test: Column) -> DataFrame:
        # Outer generators: a plain one adds a filter on its array that is pushed down and works the profile out again.
        left, other = q.withColumn("piece", F.explode_outer(keys)), right.withColumn("piece", F.explode_outer(f"r_{keys}"))
        return join_keyed(left, other, ["piece"]).filter(test & met_once(keys, f"r_{keys}")).select(*out)

    out = [F.col("id").alias("query_id"), F.col("r_id").alias("ord"), "norm", "r_norm"]
    by_token = 0.55 * token_jaccard(F.col("norm"), F.col("r_norm")) + 0.45 >= r
    found = met_on("gram_keys", near & enough).unionByName(met_on("token_keys", ~(near & enough) & by_token))
    if certain:
        found = found.unionByName(met_on("letter_keys", (total <= certain) & ~near & enough & ~by_token))
    return found


def scored_pairs(
    queries: DataFrame, register: DataFrame, threshold: float = fv.POSSIBLE_MATCH, min_length: int = fv.MIN_QUERY_NAME
) -> DataFrame:
    """(query_id, ord, score) of the pairs at or above the threshold."""
    pairs = name_candidates(queries, register, threshold, min_length)
    return (
        pairs.withColumn("score", name_score("norm", "r_norm"))
        .filter(F.col("score") >= threshold)
        .select("query_id", "ord", "score")
    )


def _scored_rows(names: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, ord, score) of names against register rows (ord, norm).

    Distinct names meet distinct names; the register rows that carry a matching name are joined afterwards.
    """
    asked = names.select("norm").distinct().select(F.col("norm").alias("query_id"), "norm")
    listed = rows.select("norm").distinct().select(F.col("norm").alias("ord"), "norm")
    scores = scored_pairs(asked, listed).select("query_id", F.col("ord").alias("norm"), "score")
    return scores.join(rows, "norm").select("query_id", "ord", "score")


# --- registers -----------------------------------------------------------------------------------
def match_banned(names: DataFrame, banned: DataFrame, top: int = 5) -> DataFrame:
    """Best ``top`` banned persons per normalised name ``norm``: score down, active first, register order."""
    variants = banned.select("ord", F.explode(F.array_distinct("norms")).alias("norm"))
    best = _scored_rows(names, variants).groupBy("query_id", "ord").agg(F.max("score").alias("score"))
    hits = best.join(banned.drop("norms"), "ord")
    ranked = top_k(hits, ["query_id"], [F.desc("score"), F.desc("active"), F.asc("ord")], top)
    return ranked.select(
        F.col("query_id").alias("norm"),
        F.lit("banned").alias("source"),
        "rank",
        "score",
        F.col("name").alias("matched_name"),
        F.col("type").alias("detail"),
        F.concat_ws(" → ", F.coalesce("start", F.lit("")), F.coalesce(F.nullif("end", F.lit("")), F.lit("..."))).alias("period"),
        "active",
        strength(F.col("score")).alias("strength"),
    )


def match_sanctions(
    names: DataFrame, entries: DataFrame, aliases: DataFrame, want_type: str | None = None, top: int = 5
) -> DataFrame:
    """Best ``top`` sanctions entries per name over their aliases; entries without a type pass the type filter."""
    kept = entries
    if want_type:
        kept = kept.filter((F.coalesce("type", F.lit("")) == "") | (F.lower("type") == want_type.lower()))
        aliases = aliases.join(kept.select("ref"), "ref", "left_semi")
    rows = aliases.select(F.struct("ref", "ord", "name").alias("ord"), "norm")
    best = (
        _scored_rows(names, rows)
        .groupBy("query_id", F.col("ord.ref").alias("ref"))
        .agg(F.max_by(F.struct("score", "ord.name"), F.struct(F.col("score"), (-F.col("ord.ord")).alias("n"))).alias("b"))
        .select("query_id", "ref", "b.score", F.col("b.name").alias("matched_name"))
    )
    hits = best.join(kept, "ref")
    where = F.coalesce(F.nullif("citizenship", F.lit("")), F.nullif("birth", F.lit("")), F.lit(""))
    detail = F.regexp_replace(
        F.concat_ws(" · ", where, F.coalesce("committees", F.lit(""))), r"^[ ·]+|[ ·]+$", ""
    )
    ranked = top_k(hits, ["query_id"], [F.desc("score"), F.asc("ord")], top)
    return ranked.select(
        F.col("query_id").alias("norm"),
        F.lit("sanctions").alias("source"),
        "rank",
        "score",
        "ref",
        "matched_name",
        F.col("type").alias("entity_type"),
        detail.alias("detail"),
        "n_aliases",
        F.lit(True).alias("active"),
        strength(F.col("score")).alias("strength"),
    )


def lookup_registry(names: DataFrame, registry: DataFrame, tokens: DataFrame, top: int = 5, candidates: int | None = None) -> DataFrame:
    """Best ``top`` registry rows among those that hold every token (of two letters or more) of a name.

    All of them are scored; ``candidates`` scores only the first so many in register order (forty, as published).

    ``registry (ord, abn, name, norm, ...)``, ``tokens (token, ord)``. Each name is looked up through its rarest
    token only, the other tokens are checked on the row, so common words never drive the join.
    """
    asked = names.select("norm").distinct().withColumn(
        "toks", F.array_distinct(F.filter(tx.words("norm"), lambda t: F.length(t) > 1))
    ).filter(F.size("toks") > 0)
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df"))
    wanted = asked.select("norm", "toks", F.explode("toks").alias("token"))
    # A token absent from the index has no frequency: the name then has no hit.
    rarest = wanted.join(frequency, "token", "left").groupBy("norm").agg(
        F.min_by(F.struct("token", "df"), F.struct(F.coalesce("df", F.lit(0)).alias("n"), F.col("token"))).alias("t"),
        F.first("toks").alias("toks"),
    ).filter(F.col("t.df").isNotNull()).select("norm", "toks", F.col("t.token").alias("token"))
    postings = join_keyed(tokens, rarest, ["token"])
    rows = registry.withColumnRenamed("norm", "r_norm")
    found = postings.join(rows, "ord").filter(F.size(F.array_except("toks", tx.words("r_norm"))) == 0)
    first = found if candidates is None else top_k(found, ["norm"], [F.asc("ord")], candidates, "_n")
    hits = first.withColumn("score", name_score("norm", "r_norm")).filter(F.col("score") >= fv.REGISTRY_MATCH)
    ranked = top_k(hits, ["norm"], [F.desc("score"), F.asc("ord")], top)
    return ranked.select("norm", "rank", "abn", "name", "status", "entity_type", "state", "postcode", "score")


def registry_tokens(registry: DataFrame) -> DataFrame:
    """(token, ord) index of the normalised registry names."""
    return registry.select(F.explode(F.array_distinct(tx.words("norm"))).alias("token"), "ord").filter(F.col("token") != "")


def registry_status(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("n")).withColumn("indexed", F.col("n") > 0)


def lookup(
    names: DataFrame, banned: DataFrame, sanctions: tuple[DataFrame, DataFrame], registry: DataFrame, tokens: DataFrame
) -> tuple[DataFrame, ...]:
    """Ad-hoc search of ``names (name)`` of four characters or more in all registers, without a type filter."""
    asked = names.filter(F.length(tx.trim_space("name")) >= fv.MIN_QUERY_NAME)
    norms = asked.select(tx.name_norm("name").alias("norm"))
    return (
        match_banned(norms, banned),
        match_sanctions(norms, *sanctions),
        lookup_registry(norms, registry, tokens),
    )


# --- cases ---------------------------------------------------------------------------------------
def screen_hits(cases: DataFrame, banned: DataFrame, sanctions: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Register hits of every case: the applicant as a person, the organisation as an entity."""
    parties = cases.select(
        "case_id", tx.name_norm("applicant").alias("applicant_norm"), tx.name_norm("org").alias("org_norm")
    )
    people = parties.select(F.col("applicant_norm").alias("norm")).distinct()
    orgs = parties.select(F.col("org_norm").alias("norm")).distinct()
    shared = ["norm", "source", "score", "matched_name", "active", "strength"]
    by_person = match_banned(people, banned).select(*shared).unionByName(
        match_sanctions(people, *sanctions, "Individual").select(*shared)
    )
    by_org = match_sanctions(orgs, *sanctions, "Entity").select(*shared)
    person = parties.select("case_id", F.col("applicant_norm").alias("norm")).join(by_person, "norm")
    entity = parties.select("case_id", F.col("org_norm").alias("norm")).join(by_org, "norm")
    return person.withColumn("party", F.lit("applicant")).unionByName(entity.withColumn("party", F.lit("org"))).drop("norm")


def screen_registry(cases: DataFrame, registry: DataFrame, tokens: DataFrame, top: int = 5) -> DataFrame:
    """Registry rows of every case's organisation: part of the screening report, without weight in its risk."""
    orgs = cases.select("case_id", tx.name_norm("org").alias("norm"))
    return orgs.join(lookup_registry(orgs, registry, tokens, top), "norm").drop("norm")


def screen_risk(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Number of hits and risk per case."""
    rolled = hits.groupBy("case_id").agg(
        F.count("*").alias("n_hits"),
        F.bool_or(F.col("active")).alias("_active"),
        F.bool_or(F.col("active") & (F.col("strength") == "strong")).alias("_strong"),
    )
    return cases.select("case_id").join(rolled, "case_id", "left").select(
        "case_id",
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.when(F.col("_strong"), "review_strong")
        .when(F.col("_active"), "review")
        .when(F.col("n_hits") > 0, "note_expired")
        .otherwise("clear")
        .alias("risk"),
    )


def screen_cases(
    cases: DataFrame, banned: DataFrame, sanctions: tuple[DataFrame, DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(hits, risk per case)."""
    hits = screen_hits(cases, banned, sanctions)
    return hits, screen_risk(cases, hits)


def screening_sources(banned: DataFrame, sanctions: DataFrame, registry: DataFrame) -> DataFrame:
    """Row count per register."""
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
        for name, df in (("banned", banned), ("sanctions", sanctions), ("registry", registry))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- conflict of interest ------------------------------------------------------------------------
def coi_reasons(assignments: DataFrame, officers: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, officer, ord, level, reason, detail, score) for assignments (case_id, officer): one row per finding.

    Only assigned pairs are looked at. A case's text is normalised once and asked for all names in one pass; each
    distinct pair of names is scored once.
    """
    parts = officers.select(tx.name_norm("name").alias("officer_norm"), "ord", F.posexplode_outer("affiliations").alias("pos", "affiliation"))
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "affiliation", tx.name_norm("affiliation").alias("norm")))
    listed = parts.withColumn("entry", entry).groupBy("officer_norm", "ord").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    first = listed.groupBy("officer_norm").agg(F.min_by("entries", "ord").alias("entries"))
    pairs = assignments.select("case_id", "officer", tx.name_norm("officer").alias("officer_norm"))
    known = join_keyed(pairs, first, ["officer_norm"], "left")
    parties = [
        F.coalesce("org", F.lit("")).alias("org"), tx.name_norm("org").alias("org_norm"),
        F.coalesce("applicant", F.lit("")).alias("applicant"), tx.name_norm("applicant").alias("applicant_norm"),
    ]
    entries = F.coalesce("entries", F.array().cast("array<struct<pos:int,affiliation:string,norm:string>>"))

    names = known.join(cases.select("case_id", *parties), "case_id")
    met = F.concat(
        F.transform(entries, lambda e: F.struct(e["norm"].alias("a"), F.col("org_norm").alias("b"))),
        F.array(F.struct(F.col("officer_norm").alias("a"), F.col("applicant_norm").alias("b"))),
    )
    scores = names.select(F.inline(met)).distinct().withColumn("score", name_score("a", "b"))

    def probe(kind, ord_, detail, a=None, b=None, in_text=None):
        return F.struct(
            F.lit(kind).alias("kind"), ord_.cast("int").alias("ord"), detail.alias("detail"),
            F.lit(None).cast("string").alias("a") if a is None else a.alias("a"),
            F.lit(None).cast("string").alias("b") if b is None else b.alias("b"),
            F.lit(False).alias("in_text") if in_text is None else in_text.alias("in_text"),
        )

    late, officer, text = 1_000_000, F.col("officer"), F.col("text_norm")
    affiliated = F.transform(
        entries, lambda e: probe("affiliation", e["pos"] * 2, e["affiliation"], e["norm"], F.col("org_norm"), (e["norm"] != "") & F.contains(text, e["norm"]))
    )
    single = F.array(
        F.when(F.col("entries").isNull(), probe("unknown", F.lit(late), officer)),
        F.when(F.col("applicant") != "", probe("applicant", F.lit(late + 1), F.col("applicant"), F.col("officer_norm"), F.col("applicant_norm"))),
        F.when((F.col("officer_norm") != "") & F.contains(text, F.col("officer_norm")), probe("mention", F.lit(late + 2), officer)),
    )
    full = known.join(cases.select("case_id", *parties, tx.name_norm("text").alias("text_norm")), "case_id")
    probes = full.select("case_id", "officer", "org", F.inline(F.concat(affiliated, F.filter(single, lambda p: p.isNotNull()))))
    judged = probes.join(scores, ["a", "b"], "left")
    kind, score = F.col("kind"), F.col("score")
    by_org = (kind == "affiliation") & (F.col("org") != "")
    reason = (
        F.when(by_org & (score >= fv.ORG_BLOCK), "affiliation_matches_org")
        .when(by_org & (score >= fv.ORG_WARN), "affiliation_resembles_org")
        .when((kind == "affiliation") & F.col("in_text") & (score < fv.ORG_WARN), "affiliation_in_text")
        .when(kind == "unknown", "officer_not_registered")
        .when((kind == "applicant") & (score >= fv.NAME_WARN), "name_resembles_applicant")
        .when(kind == "mention", "name_in_text")
    )
    found = judged.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return found.select(
        "case_id",
        "officer",
        (F.col("ord") + (F.col("reason") == "affiliation_in_text").cast("int")).alias("ord"),
        F.when(F.col("reason") == "affiliation_matches_org", "block").otherwise("warn").alias("level"),
        "reason",
        "detail",
        "score",
    )


def coi_check(assignments: DataFrame, officers: DataFrame, cases: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Highest level per assignment (none, warn, block), number of reasons and whether the officer is registered."""
    reasons = coi_reasons(assignments, officers, cases) if reasons is None else reasons
    rank = F.when(F.col("level") == "block", 2).otherwise(1)
    rolled = reasons.groupBy("case_id", "officer").agg(
        F.max(rank).alias("_rank"),
        F.count("*").alias("n_reasons"),
        count_where(F.col("reason") == "officer_not_registered").alias("_unknown"),
    )
    return assignments.select("case_id", "officer").join(rolled, ["case_id", "officer"], "left").select(
        "case_id",
        "officer",
        F.when(F.col("_rank") == 2, "block").when(F.col("_rank") == 1, "warn").otherwise("none").alias("level"),
        F.coalesce("n_reasons", F.lit(0)).alias("n_reasons"),
        (F.coalesce("_unknown", F.lit(0)) == 0).alias("registered"),
    )


def officer_roles(names: DataFrame, officers: DataFrame) -> DataFrame:
    """Role of each name in the register, null when not listed."""
    first = officers.select(tx.name_norm("name").alias("_norm"), "role", "ord").groupBy("_norm").agg(
        F.min_by("role", "ord").alias("role")
    )
    return join_keyed(names.withColumn("_norm", tx.name_norm("name")), first, ["_norm"], "left").drop("_norm")


def eligible_reviewers(levels: DataFrame) -> DataFrame:
    """Assignments whose level does not block the officer."""
    return levels.filter(F.col("level") != "block").select("case_id", "officer", "level")
