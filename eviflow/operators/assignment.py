"""Assignment pool: who of the whole officer register may take a case.

Conflicts are found from both ends without pairing officers with cases. Affiliations meet organisations, and officers'
names meet applicants, by the fuzzy candidate joins of ``names``, on distinct names. Mentions in texts come from automata
over the names and affiliations of the register: a text streams once through each automaton, however many names it holds.
What remains are the conflicts themselves, found once for cases that say the same; officers without one are counted, never
listed, and the first few of them come from the runs of places between the conflicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eviflow import fixed_values as fv
from eviflow.functions import text as tx
from eviflow.functions.similarity import name_score
from eviflow.operators.asof import as_of_join
from eviflow.operators.common import count_where, cut, with_position
from eviflow.operators.names import scored_pairs

#: Names that one automaton holds at most; a larger register is sliced.
SLICE_NAMES = 200_000


def registered(officers: DataFrame) -> DataFrame:
    """(officer, officer_norm, ord, affiliations): the first register row of each normalised name."""
    rows = officers.select(tx.name_norm("name").alias("officer_norm"), F.struct("ord", F.col("name").alias("officer"), "affiliations").alias("row"))
    first = rows.groupBy("officer_norm").agg(F.min_by("row", "row.ord").alias("row"))
    return first.select("row.officer", "officer_norm", "row.ord", "row.affiliations")


def mentions(texts: DataFrame, names: DataFrame, slice_names: int = SLICE_NAMES) -> DataFrame:
    """(case_id, norm) of every name of ``names (norm)`` that a normalised text of ``texts (case_id, text_norm)`` contains.

    The names are compiled into one automaton per slice of about ``slice_names``; each slice reads the texts once.
    """
    spark = texts.sparkSession
    wanted = names.filter(F.col("norm") != "").distinct()
    slices = max(1, -(-wanted.count() // slice_names))
    out = f"case_id {texts.schema['case_id'].dataType.simpleString()}, norm string"
    found = None
    for k in range(slices):
        part = wanted if slices == 1 else wanted.filter(F.pmod(F.xxhash64("norm"), F.lit(slices)) == k)
        held = spark.sparkContext.broadcast([r["norm"] for r in part.collect()])  # about slice_names names

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for name in held.value:
                automaton.add_word(name, name)
            automaton.make_automaton()
            for batch in batches:
                cases, norms = [], []
                if len(automaton):
                    for case, text in zip(batch["case_id"], batch["text_norm"]):
                        own = {name for _, name in automaton.iter(text)}
                        cases += [case] * len(own)
                        norms += own
                yield pd.DataFrame({"case_id": pd.Series(cases, dtype=batch["case_id"].dtype), "norm": pd.Series(norms, dtype="object")})

        met = texts.select("case_id", "text_norm").mapInPandas(run, out)
        found = met if found is None else found.unionByName(met)
    return found


def _similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(norm, other, score) of distinct names of both sides; short names count too."""
    asked = left.filter(F.col("norm") != "").distinct().select(F.col("norm").alias("query_id"), "norm")
    listed = right.filter(F.col("norm") != "").distinct().select(F.col("norm").alias("ord"), "norm")
    return scored_pairs(asked, listed, threshold, min_length=1).select(F.col("query_id").alias("norm"), F.col("ord").alias("other"), "score")


def conflicts(cases: DataFrame, officers: DataFrame, slice_names: int = SLICE_NAMES) -> DataFrame:
    """(case_id, officer, ord, level, reason, detail, score): every conflict of every registered officer with every case.

    ``cases (case_id, org, applicant, text)``, ``officers (ord, name, affiliations)``. The rows are those that a check of
    each officer against each case gives.
    """
    known = registered(officers)
    entries = known.select("officer", F.posexplode("affiliations").alias("pos", "affiliation"))
    entries = entries.select("officer", (F.col("pos") * 2).alias("ord"), F.col("affiliation").alias("detail"), tx.name_norm("affiliation").alias("norm"))
    parties = cases.select("case_id", tx.name_norm("org").alias("org_norm"), tx.name_norm("applicant").alias("applicant_norm"), F.col("applicant"))
    columns = ["case_id", "officer", "ord", "level", "reason", "detail", "score"]

    orgs = _similar(parties.select(F.col("org_norm").alias("norm")), entries.select("norm"), fv.ORG_WARN)
    same = F.col("score") >= fv.ORG_BLOCK
    listed = entries.select(F.col("norm").alias("other"), "officer", "ord", "detail")
    by_org = orgs.join(listed, "other").join(parties.select("case_id", F.col("org_norm").alias("norm")), "norm")
    by_org = by_org.withColumn("level", F.when(same, "block").otherwise("warn")).withColumn("reason", F.when(same, "affiliation_matches_org").otherwise("affiliation_resembles_org"))

    late = 1_000_000
    people = _similar(parties.select(F.col("applicant_norm").alias("norm")), known.select(F.col("officer_norm").alias("norm")), fv.NAME_WARN)
    named = known.select(F.col("officer_norm").alias("other"), "officer")
    by_name = people.join(named, "other").join(parties.select("case_id", F.col("applicant_norm").alias("norm"), F.col("applicant").alias("detail")), "norm")
    by_name = by_name.select("*", F.lit(late + 1).alias("ord"), F.lit("warn").alias("level"), F.lit("name_resembles_applicant").alias("reason"))

    texts = cases.select("case_id", tx.name_norm("text").alias("text_norm"))
    found = mentions(texts, entries.select("norm").unionByName(known.select(F.col("officer_norm").alias("norm"))), slice_names)
    held = found.join(parties.select("case_id", "org_norm"), "case_id").join(entries, "norm")
    scores = held.select("norm", "org_norm").distinct().withColumn("score", name_score("norm", "org_norm"))
    in_text = held.join(scores, ["norm", "org_norm"]).filter(F.col("score") < fv.ORG_WARN)
    in_text = in_text.select("*", F.lit("warn").alias("level"), F.lit("affiliation_in_text").alias("reason")).withColumn("ord", F.col("ord") + 1)
    met = found.join(known.select(F.col("officer_norm").alias("norm"), "officer"), "norm")
    met = met.select(
        "case_id", "officer", F.lit(late + 2).alias("ord"), F.lit("warn").alias("level"), F.lit("name_in_text").alias("reason"), F.col("officer").alias("detail"), F.lit(None).cast("double").alias("score")
    )
    parts = [by_org.select(*columns), by_name.select(*columns), in_text.select(*columns), met.select(*columns)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def conflict_levels(found: DataFrame) -> DataFrame:
    """(case_id, officer, level, n_reasons): the highest level of each pair in conflict."""
    rank = F.when(F.col("level") == "block", 2).otherwise(1)
    rolled = found.groupBy("case_id", "officer").agg(F.max(rank).alias("rank"), F.count("*").alias("n_reasons"))
    return rolled.select("case_id", "officer", F.when(F.col("rank") == 2, "block").otherwise("warn").alias("level"), "n_reasons")


def alike(cases: DataFrame) -> DataFrame:
    """(case_id, first): cases that say the same have the same conflicts; ``first`` is the least of them. A null id stays one."""
    said = cases.filter(F.col("case_id").isNotNull()).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("org", "applicant", "text"))).alias("rows"))
    marked = said.select("case_id", F.sha2(F.to_json("rows"), 256).alias("mark"))
    of = marked.join(marked.groupBy("mark").agg(F.min("case_id").alias("first")), "mark").select("case_id", "first")
    unnamed = cases.filter(F.col("case_id").isNull()).select("case_id", F.col("case_id").alias("first")).distinct()
    return of.unionByName(unnamed)


def _first_cases(cases: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of the first case of each class."""
    firsts = of.filter(F.col("case_id").eqNullSafe(F.col("first"))).select(F.col("first").alias("_first"))
    return cases.join(firsts, F.col("case_id").eqNullSafe(F.col("_first")), "left_semi")


def case_levels(cases: DataFrame, officers: DataFrame) -> DataFrame:
    """:func:`conflict_levels` of every case; cases that say the same are checked once and get the rows of the first."""
    of = alike(cases)
    levels = conflict_levels(conflicts(_first_cases(cases, of), officers)).withColumnRenamed("case_id", "_first")
    return levels.join(of, F.col("_first").eqNullSafe(F.col("first"))).select("case_id", "officer", "level", "n_reasons")


def _free_runs(levels: DataFrame, of: DataFrame, known: DataFrame, n: int, suggest: int) -> DataFrame:
    """(first, since, runs): the runs of places without conflict, twice around the register of ``n`` officers.

    A start from ``since`` on, up to the end of the first run, meets this run and the next ones, ``suggest`` in all.
    """
    busy = levels.filter(F.col("first").isNotNull()).join(known, "officer").select("first", "place").distinct()
    marks = busy.select("first", F.explode(F.array(F.col("place"), F.col("place") + n)).alias("at"))
    ends = of.filter(F.col("first").isNotNull()).select("first").distinct().select("first", F.explode(F.array(F.lit(0).cast("long"), F.lit(2 * n + 1).cast("long"))).alias("at"))
    order = Window.partitionBy("first").orderBy("at")
    run = marks.unionByName(ends).select("first", F.struct((F.col("at") + 1).alias("low"), (F.lead("at").over(order) - 1).alias("high")).alias("run"))
    run = run.filter(F.col("run.low") <= F.col("run.high"))
    order = Window.partitionBy("first").orderBy("run.low")
    following = F.array_compact(F.array(*[F.lead("run", k).over(order) for k in range(suggest)]))
    return run.select("first", (F.coalesce(F.lag("run.high").over(order), F.lit(0)) + 1).alias("since"), following.alias("runs"))


def _turn(case: Column, n: int) -> Column:
    """Where a case starts its walk around a register of ``n`` officers."""
    return F.conv(F.substring(F.md5(case.cast("string")), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))


def assignment_pool(cases: DataFrame, officers: DataFrame, levels: DataFrame | None = None, suggest: int = 3, folder: str | None = None) -> DataFrame:
    """(case_id, n_officers, n_blocked, n_warned, n_free, suggested) of every case.

    The pool of a case is the register without its blocked officers (``levels`` of :func:`conflict_levels`); those warned may
    take it with a reason. ``suggested`` are the first ``suggest`` officers without any conflict, in register order from
    a place that the case's hash picks, so that work spreads. Conflicts are found once for cases that say the same
    (:func:`alike`), and leave runs of free places; a case meets the run at its start and the next ones. Conflicts
    are read several times: with ``folder`` they are written there first.
    """
    if levels is None:
        of = alike(cases)
        levels = conflict_levels(conflicts(_first_cases(cases, of), officers))
        levels = cut(levels, folder) if folder else levels
    else:
        of = cases.select("case_id", F.col("case_id").alias("first")).distinct()
    levels = levels.withColumnRenamed("case_id", "first")
    known = with_position(registered(officers).select("officer", "ord"), [], "ord", "place")
    n = known.count()
    blocked = F.col("level") == "block"
    rolled = levels.groupBy("first").agg(count_where(blocked).alias("n_blocked"), count_where(~blocked).alias("n_warned")).join(of, "first")
    zero = F.lit(0).cast("long")
    counts = cases.select("case_id").join(rolled.drop("first"), "case_id", "left").select("case_id", F.coalesce("n_blocked", zero).alias("n_blocked"), F.coalesce("n_warned", zero).alias("n_warned"))
    asked = cases.groupBy("case_id").agg(F.count("*").cast("int").alias("n_rows")).join(of, "case_id").withColumn("start", _turn(F.col("case_id"), n) + 1)
    met = as_of_join(asked, _free_runs(levels, of, known, n, suggest), ["first"], "start", "since", ["runs"], width=1_000)
    start = F.col("start")
    spots = F.flatten(F.transform("runs", lambda r: F.sequence(F.greatest(r["low"], start), F.least(r["high"], F.greatest(r["low"], start) + suggest - 1))))
    spots = F.flatten(F.transform(F.filter(spots, lambda p: p < start + n), lambda p: F.array_repeat(p, F.col("n_rows"))))
    picks = met.select("case_id", F.posexplode(F.slice(spots, 1, suggest)).alias("rank", "spot")).withColumn("place", (F.col("spot") - 1) % F.lit(max(n, 1)) + 1)
    picks = picks.join(known.select("place", "officer"), "place")
    first = picks.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "officer"))).alias("picked"))
    return counts.join(first, "case_id", "left").select(
        "case_id",
        F.lit(n).cast("long").alias("n_officers"),
        "n_blocked",
        "n_warned",
        (F.lit(n) - F.col("n_blocked") - F.col("n_warned")).cast("long").alias("n_free"),
        F.coalesce(F.transform("picked", lambda p: p["officer"]), F.array().cast("array<string>")).alias("suggested"),
    )
