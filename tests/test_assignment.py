import itertools
import random

import pytest
from conftest import rows
from test_names import expected_score

from eviflow.operators import assignment, names as nm

FIRST, LAST = ["ANNA", "BORIS", "LI", "JO", "A B", "ELENA"], ["SMITH", "SMYTHE", "LEE", "NGUYEN", "KOWALSKA", "XU"]
ORGS = ["ACME PTY LTD", "ACME LTD", "ACNE PTY", "ABC", "ABCD", "AC", "RIVER WINE CO", "RIVERS WINE", "WINE RIVER COMPANY", "ORG", "X", ""]


def made(seed, n_officers=25, n_cases=60):
    rng = random.Random(seed)
    officers = [(i, f"{rng.choice(FIRST)} {rng.choice(LAST)}".title(), rng.sample(ORGS, rng.randrange(0, 3))) for i in range(n_officers)]
    cases = []
    for c in range(n_cases):
        said = " and ".join(rng.sample(ORGS + [o[1] for o in officers], 2))
        cases.append((c, rng.choice(ORGS + [None]), rng.choice([o[1] for o in officers] + ["Somebody Else", "", None]), rng.choice([f"We work with {said}.", "", None])))
    return officers, cases


def frames(frame, officers, cases):
    return frame("ord int, name string, affiliations array<string>", *officers), frame("case_id int, org string, applicant string, text string", *cases)


@pytest.mark.parametrize("slice_names", [assignment.SLICE_NAMES, 3])
def test_conflicts_equal_the_check_of_every_pair(spark, frame, slice_names):
    officers, cases = frames(frame, *made(1))
    pairs = cases.select("case_id").crossJoin(assignment.registered(officers).select("officer"))
    columns = ["case_id", "officer", "ord", "level", "reason", "detail", "score"]
    found = rows(assignment.conflicts(cases, officers, slice_names), *columns)
    assert found == rows(nm.coi_reasons(pairs, officers, cases), *columns)
    assert {r[4] for r in found} == {"affiliation_matches_org", "affiliation_resembles_org", "affiliation_in_text", "name_resembles_applicant", "name_in_text"}


def test_pool_equals_all_officers_without_conflict(spark, frame):
    officers, cases = frames(frame, *made(2))
    known = [r.officer for r in assignment.registered(officers).orderBy("ord").collect()]
    pairs = cases.select("case_id").crossJoin(assignment.registered(officers).select("officer"))
    level = {(r.case_id, r.officer): r.level for r in nm.coi_check(pairs, officers, cases).collect()}
    pool = assignment.assignment_pool(cases, officers, suggest=4).collect()
    assert len(pool) == cases.count()
    for r in pool:
        of = [level[r.case_id, o] for o in known]
        assert (r.n_officers, r.n_blocked, r.n_warned, r.n_free) == (len(known), of.count("block"), of.count("warn"), of.count("none"))
        free = [o for o, x in zip(known, of) if x == "none"]
        assert len(r.suggested) == min(4, len(free)) and set(r.suggested) <= set(free)
        places = [known.index(o) for o in r.suggested]
        assert sum(a > b for a, b in itertools.pairwise(places)) <= 1  # once around the register at most


def test_pool_without_officers_or_cases(spark, frame):
    officers, cases = frames(frame, *made(3, n_officers=2, n_cases=3))
    assert assignment.assignment_pool(cases.limit(0), officers).count() == 0
    alone = assignment.assignment_pool(cases, officers.limit(0)).collect()
    assert [(r.n_officers, r.n_free, r.suggested) for r in alone] == [(0, 0, [])] * 3


def test_cases_that_say_the_same_are_checked_once(spark, frame):
    officers, cases = made(4)
    cases += [(100 + c[0], *c[1:]) for c in cases] + [cases[0], cases[5], (None, *cases[7][1:])]
    officers, cases = frames(frame, officers, cases)
    of = dict(map(tuple, assignment.alike(cases).collect()))
    assert None in of and 7 in of and sum(c == f for c, f in of.items()) <= 63 < len(of) == 121  # two cases come twice, and the null id
    columns = ["case_id", "officer", "level", "n_reasons"]
    key = lambda r: tuple(str(x) for x in r)
    want = assignment.conflict_levels(assignment.conflicts(cases, officers))
    assert sorted(assignment.case_levels(cases, officers).select(columns).collect(), key=key) == sorted(want.select(columns).collect(), key=key)
    pool, given = (assignment.assignment_pool(cases, officers, levels).collect() for levels in (None, want))
    assert sorted(pool, key=key) == sorted(given, key=key) and len(pool) == 123


def test_pool_reads_runs_not_every_conflict(spark, frame):
    """An officer's conflicts are no steps of the case's walk: all but two of them are blocked."""
    officers = frame("ord int, name string, affiliations array<string>", *[(i, f"P{i}", []) for i in range(50)])
    cases = frame("case_id int, org string, applicant string, text string", *[(c, "O", "A", "") for c in range(9)])
    levels = cases.crossJoin(officers.filter("ord not in (3, 40)")).selectExpr("case_id", "name as officer", "'block' as level", "1L as n_reasons")
    pool = assignment.assignment_pool(cases, officers, levels)
    assert {tuple(sorted(r.suggested)) for r in pool.collect()} == {("P3", "P40")} and {r.n_free for r in pool.collect()} == {2}
    assert "sequence(0" not in pool._jdf.queryExecution().optimizedPlan().toString()


def short_names(rng, n):
    letters = "ABCDE "
    made = {" ".join("".join(rng.choices(letters, k=rng.randrange(1, 16))).split()) for _ in range(n)}
    return sorted(made - {""})


@pytest.mark.parametrize("threshold", [0.70, 0.74, 0.78, 0.82])
def test_low_thresholds_lose_no_match(spark, frame, threshold):
    """Names of few letters in any order, where no bigram is certain, against every pair."""
    rng = random.Random(7)
    left, right = short_names(rng, 160), sorted({*short_names(rng, 160), "ABC", "AC", "A", "AB"})
    q, r = frame("query_id string, norm string", *[(n, n) for n in left]), frame("ord string, norm string", *[(n, n) for n in right])
    got = nm.scored_pairs(q, r, threshold, min_length=1).collect()
    want = {(a, b, expected_score(a, b)) for a in left for b in right if expected_score(a, b) >= threshold}
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    ends = [(a, b) for a, b, _ in want if not set(zip(a, a[1:])) & set(zip(b, b[1:]))]
    assert ends or threshold > 0.74  # pairs without a common bigram are among them


def test_thresholds_under_the_bound_are_refused(spark, frame):
    one = frame("query_id string, norm string", ("A", "A"))
    with pytest.raises(ValueError, match="0.70"):
        nm.scored_pairs(one, one.withColumnRenamed("query_id", "ord"), 0.69)
