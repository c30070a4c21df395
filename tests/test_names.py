import itertools
import random
from difflib import SequenceMatcher

from conftest import rows

from eviflow.functions import text as tx
from eviflow.functions.similarity import name_score
from eviflow.operators import names as nm
from eviflow.sources.readers import banned_from, sanctions_from


def expected_score(a, b):
    if not a or not b:
        return 0.0
    r = SequenceMatcher(None, " ".join(sorted(a.split())), " ".join(sorted(b.split()))).ratio()
    x, y = set(a.split()), set(b.split())
    j = len(x & y) / len(x | y)
    return round(max(r, 0.55 * j + 0.45 * r), 3)


def sample_names(n, seed):
    rng = random.Random(seed)
    first = ["ANNA", "BORIS", "CHLOE", "DMITRI", "ELENA", "FARID", "JO", "LI", "A", "B", "AA"]
    last = ["SMITH", "SMYTHE", "SMITHSON", "KOWALSKI", "KOWALSKA", "NGUYEN", "O BRIEN", "OBRIEN", "LEE", "B B"]
    out = set()
    while len(out) < n:
        name = " ".join(rng.sample(first, rng.randint(1, 2)) + rng.sample(last, rng.randint(1, 2)))
        if rng.random() < 0.4:
            i = rng.randrange(len(name))
            name = name[:i] + rng.choice("ABEIOXZ") + name[i + 1 :]
        name = " ".join(name.split())
        if len(name) >= 4:
            out.add(name)
    return sorted(out)


def test_name_norm(spark, frame):
    df = frame(
        "name string", ("Renée  d'Árc",), ("Müller-Groß",), ("Nguyễn Văn A",), ("ﬁne ½",), ("Ōsaka 2²",), ("Иван Li",), (None,), ("Łódź",)
    )
    got = [r[0] for r in df.select(tx.name_norm("name")).collect()]
    assert got == ["RENEE D ARC", "MULLER GROSS", "NGUYEN VAN A", "FINE 1 2", "OSAKA 22", "LI", "", "ODZ"]


def test_scores_equal_definition(spark, frame):
    names = sample_names(40, 1)
    pairs = list(itertools.product(names, names[:10])) + [("", "AB"), ("AB", "")]
    got = frame("a string, b string", *pairs).select("a", "b", name_score("a", "b").alias("s")).collect()
    assert all(r.s == expected_score(r.a, r.b) for r in got)


def test_candidates_lose_no_match(spark, frame):
    queries, register = sample_names(150, 2), sample_names(150, 3) + ["LI", "B", "XYZ"]
    q = frame("query_id string, norm string", *[(n, n) for n in queries])
    r = frame("ord string, norm string", *[(n, n) for n in register])
    found = nm.name_candidates(q, r).collect()
    pairs = {(x.query_id, x.ord) for x in found}
    assert len(pairs) == len(found)
    wanted = {(a, b) for a in queries for b in register if expected_score(a, b) >= 0.78}
    assert wanted and wanted <= pairs
    scored = {(x.query_id, x.ord, x.score) for x in nm.scored_pairs(q, r).collect()}
    assert scored == {(a, b, expected_score(a, b)) for a, b in wanted}


def test_candidates_without_broadcast_agree(spark, frame):
    names = sample_names(60, 4)
    q = frame("query_id string, norm string", *[(n, n) for n in names])
    r = frame("ord string, norm string", *[(n, n) for n in names])
    small = rows(nm.name_candidates(q, r), "query_id", "ord")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(nm.name_candidates(q, r), "query_id", "ord") == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


BANNED = "ord int, BD_PER_NAME string, BD_PER_TYPE string, BD_PER_DOC_NUM string, BD_PER_START_DT string, BD_PER_END_DT string, BD_PER_ADD_STATE string, BD_PER_ADD_COUNTRY string"


def banned(frame):
    return banned_from(
        frame(
            BANNED,
            (1, "ABBOTT, BILL", "Disqualified", "1", "1/2/2020", "01/02/2021", "NSW", "AU"),
            (2, "ABBOTT, BILL", "Banned", "2", "1/2/2020", None, "VIC", "AU"),
            (3, "Abbot Bill", "Banned", "3", "1/2/2020", "31/12/2030", "VIC", "AU"),
            (4, "Someone Else", "Banned", "4", "", "", "", ""),
        ),
        "2026-01-01",
    )


def test_banned(spark, frame):
    reg = banned(frame)
    assert [r.active for r in reg.orderBy("ord").collect()] == [False, True, True, True]
    assert reg.filter("ord = 1").first().norms == ["ABBOTT BILL", "BILL ABBOTT"]
    hits = nm.match_banned(frame("norm string", ("BILL ABBOTT",), ("BIL",)), reg).orderBy("rank").collect()
    assert [(h.matched_name, h.score, h.active, h.strength) for h in hits] == [
        ("ABBOTT, BILL", 1.0, True, "strong"),
        ("ABBOTT, BILL", 1.0, False, "strong"),
        ("Abbot Bill", expected_score("BILL ABBOTT", "ABBOT BILL"), True, "strong"),
    ]
    assert hits[0].period == "1/2/2020 → ..."


SANCTIONS = "ord int, Reference string, `Name of Individual or Entity` string, Type string, `Name Type` string, `Date of Birth` string, Citizenship string, Committees string"


def sanctions(frame):
    return sanctions_from(
        frame(
            SANCTIONS,
            (1, "2", "Ivan Petrov", "", "Primary Name", "", "", "1267"),
            (2, "2a", "Iwan Petroff", "Individual", "Alias", "1970", "RU", "x"),
            (3, "3", "Petrov Trading Ltd", "Entity", "Primary Name", "", "", "C" * 80),
            (4, "", "nobody", "Entity", "", "", "", ""),
        )
    )


def test_sanctions(spark, frame):
    entries, aliases = sanctions(frame)
    assert rows(entries, "ref", "n_aliases", "type", "birth", "citizenship", "committees") == [
        ("2", 2, "Individual", "1970", "RU", "1267"),
        ("3", 1, "Entity", "", "", "C" * 80),
    ]
    names = frame("norm string", ("IVAN PETROV",), ("PETROV TRADING LTD",))
    person = nm.match_sanctions(names, entries, aliases, "individual")
    assert rows(person, "norm", "ref", "matched_name", "score", "detail") == [("IVAN PETROV", "2", "Ivan Petrov", 1.0, "RU · 1267")]
    entity = nm.match_sanctions(names, entries, aliases, "Entity")
    assert rows(entity, "norm", "ref", "detail") == [("PETROV TRADING LTD", "3", "C" * 80)]


def test_screen_cases(spark, frame):
    cases = frame(
        "case_id string, applicant string, org string",
        ("a", "Bill Abbott", "Good Farm"),
        ("b", "Nobody Here", "Petro Trade Ltd"),
        ("c", None, ""),
    )
    hits, risk = nm.screen_cases(cases, banned(frame), sanctions(frame))
    assert dict(rows(risk, "case_id", "risk")) == {"a": "review_strong", "b": "review", "c": "clear"}
    assert 0.78 <= expected_score("PETRO TRADE LTD", "PETROV TRADING LTD") < 0.9
    assert {r.party for r in hits.filter("case_id = 'b'").collect()} == {"org"}
    expired = nm.screen_risk(cases, frame("case_id string, active boolean, strength string", ("c", False, "strong")))
    assert dict(rows(expired, "case_id", "risk"))["c"] == "note_expired"


def test_registry_lookup(spark, frame):
    reg = frame(
        "ord int, abn string, name string, status string, entity_type string, state string, postcode string",
        *[(i, str(i), f"Common Pty Ltd {i}", "ACT", "PRV", "NSW", "2000") for i in range(60)],
        (100, "100", "Rivière Wines Pty Ltd", "ACT", "PRV", "NSW", "2000"),
        (101, "101", "Riviere Wines Holdings Pty Ltd", "CAN", "PRV", "NSW", "2000"),
    ).withColumn("norm", tx.name_norm("name"))
    tokens = nm.registry_tokens(reg)
    asked = frame("name string", ("Riviere Wines Pty Ltd",), ("Common Pty Ltd",), ("Absent Wines",), ("X",))
    found = nm.lookup_registry(asked.select(tx.name_norm("name").alias("norm")), reg, tokens)
    by_name = {}
    for r in found.orderBy("rank").collect():
        by_name.setdefault(r.norm, []).append(r.abn)
    assert by_name["RIVIERE WINES PTY LTD"] == ["100", "101"]
    assert by_name["COMMON PTY LTD"] == ["0", "1", "2", "3", "4"]
    assert set(by_name) == {"RIVIERE WINES PTY LTD", "COMMON PTY LTD"}
    banned_hits, sanction_hits, registry_hits = nm.lookup(asked, banned(frame), sanctions(frame), reg, tokens)
    assert (banned_hits.count(), sanction_hits.count(), registry_hits.count()) == (0, 0, 7)
    assert nm.registry_status(reg).first().n == 62


def test_coi(spark, frame):
    officers = frame(
        "ord int, name string, role string, affiliations array<string>",
        (0, "Rosa Keller", "officer", ["Grants Office", "Northfield State University"]),
        (1, "Hugo Brandt", "manager", ["Grants Office"]),
        (2, "Tomas Vidal", "officer", []),
    )
    cases = frame(
        "case_id string, applicant string, org string, text string",
        ("1", "Dr Ann Lee", "Northfield State University", "plain"),
        ("2", "Tomas Vidl", "Harbour College", "Letters by the GRANTS-office and Rosa  Keller."),
    )
    pairs = frame("case_id string, officer string", *itertools.product(["1", "2"], ["rosa keller", "Hugo Brandt", "Tomas Vidal", "Guest"]))
    levels = {(r.case_id, r.officer): (r.level, r.n_reasons, r.registered) for r in nm.coi_check(pairs, officers, cases).collect()}
    assert levels["1", "rosa keller"] == ("block", 1, True)
    assert levels["1", "Hugo Brandt"] == ("none", 0, True)
    assert levels["2", "Hugo Brandt"] == ("warn", 1, True)
    assert levels["2", "rosa keller"] == ("warn", 2, True)
    assert levels["2", "Tomas Vidal"] == ("warn", 1, True)
    assert levels["1", "Guest"] == ("warn", 1, False)
    reasons = nm.coi_reasons(pairs, officers, cases).filter("case_id = '2' AND officer = 'rosa keller'").orderBy("ord")
    assert [r.reason for r in reasons.collect()] == ["affiliation_in_text", "name_in_text"]
    roles = nm.officer_roles(frame("name string", ("hugo  brandt",), ("x",)), officers)
    assert rows(roles, "name", "role") == [("hugo  brandt", "manager"), ("x", None)]
    assert nm.eligible_reviewers(nm.coi_check(pairs, officers, cases)).count() == 7
