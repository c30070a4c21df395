import re

from conftest import rows
from pyspark.sql import functions as F

from eviflow.functions import text as tx
from eviflow.operators import crosscheck as xck
from eviflow.operators import segment as sg

DOSSIER = """APPLICATION 1

Total requested budget: $1,250,000 over five years. The work runs on two sites with partners from the region and is reported every quarter to the office. Revenue last year was $ 500,000.
The Ph.D. was awarded in 2019. Project Description has 12 pages.

=== DOCUMENT: Accounts ===

Intro line.
[TABLE 1]
| Item | 2020 | 2021 |
| Total costs | $10,000 | $1,300,000 |
| grand total | $900 |
[/TABLE 1]
Turnover for the year: $1,500,000.00. Start date 2022, end date 2021. Filed 03/04/2031.

===  DOCUMENT:  CV  ===
PhD degree from Cornell (2018). The letter has 3 pages.
"""


def test_split_documents(spark, frame):
    docs = sg.split_documents(frame("case_id string, text string", ("a", DOSSIER), ("b", "=== DOCUMENT: Only ===\nx"), ("c", "plain")))
    assert [r[:3] for r in rows(docs, "case_id", "doc_ord", "doc")] == [
        ("a", 0, "Main form"), ("a", 1, "Accounts"), ("a", 2, "CV"), ("b", 1 - 1, "Only"), ("c", 0, "Main form"),
    ]


def test_crosscheck(spark, frame):
    cases = frame("case_id string, text string", ("a", DOSSIER), ("b", "Total budget $5,000. Nothing else."))
    values = xck.extract_values(sg.split_documents(cases)).filter("case_id = 'a'")
    assert rows(values, "category", "value", "source") == sorted(
        [
            ("budget_total", 1250000, "Main form"), ("revenue", 500000, "Main form"), ("phd_year", 2019, "Main form"),
            ("pd_pages", 12, "Main form"), ("budget_total", 1300000, "Accounts · TABLE 1"), ("budget_total", 900, "Accounts · TABLE 1"),
            ("revenue", 1500000, "Accounts"), ("phd_year", 2018, "CV"), ("letter_pages", 3, "CV"),
        ],
        key=lambda r: tuple((True, str(x)) for x in r),
    )
    findings, risk = xck.crosscheck(cases, "2026-01-01")
    got = {(r.category, r.severity, r.low_value, r.high_value, r.value) for r in findings.collect()}
    assert got == {
        ("budget_total", "high", 900, 1300000, None), ("revenue", "high", 500000, 1500000, None), ("phd_year", "medium", 2018, 2019, None),
        ("date_order", "high", None, None, "2022 → 2021"), ("date_future", "medium", None, None, "03/04/2031"),
    }
    assert dict(rows(risk, "case_id", "risk")) == {"a": "mismatch_high", "b": "consistent"}
    assert risk.filter("case_id = 'a'").first().n_checked == 9


def test_context_is_the_slice(spark, frame):
    text = "x" * 200 + " total budget is $7,000 and\n  then " + "y" * 200
    got = xck.extract_values(frame("case_id int, doc_ord int, doc string, body string", (1, 0, "d", text))).first()
    m = re.search(r"\$7,000", text)
    assert got.context == " ".join(text[m.start() - 55 : m.end() + 55].split())


def test_document_rows_and_report_agree(spark, frame):
    cases = frame("case_id string, text string", ("a", DOSSIER), ("b", "Total budget $5,000 and total cost $6,000."), ("c", "none"))
    docs = sg.split_documents(cases)
    values = xck.extract_values(docs)
    found = xck.discrepancies(values)
    long = xck.case_risk(cases, docs, values, found.unionByName(xck.date_findings(docs, "2026-01-01"), allowMissingColumns=True))
    _, risk = xck.crosscheck(cases, "2026-01-01")
    assert rows(long, *risk.columns) == rows(risk)


def test_parse_money(spark, frame):
    df = frame("s string", ("1,520,000",), ("25,000.50",), ("1.500",), ("12",))
    assert [r[0] for r in df.select(tx.parse_money("s")).collect()] == [1520000, 25000, 1500, 12]


def test_chunk_offsets_slice_back(spark, frame):
    texts = ["  a b\n\nc\n \n\n  d é ü \n\n\n a b ", "one", "", "\n\n x \n\n x\n\nx"]
    df = frame("case_id int, text string", *enumerate(texts))
    got = sg.chunks(df).collect()
    assert all(texts[r.case_id][r.start : r.end] == r.text for r in got)
    for i, text in enumerate(texts):
        want = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
        mine = sorted((r for r in got if r.case_id == i), key=lambda r: r.chunk_id)
        assert [r.text for r in mine] == want and [r.chunk_id for r in mine] == list(range(len(want)))
        ends = [0] + [r.end for r in mine]
        assert all(r.start >= e for r, e in zip(mine, ends))


def test_guard_text(spark, frame):
    cases = {
        "does **not** own": "does not own", "A$1,000 and AUD 2,000": "$1,000 and $2,000", "3,000 AUD": "$3,000",
        "5 dollars": "$5", "$7,000 dollars": "$7,$000", "it’s – ok\tnow\n x": "it's - ok now\n x",
    }
    got = frame("s string", *[(k,) for k in cases]).select("s", tx.guard_norm("s").alias("n")).collect()
    assert {r.s: r.n for r in got} == cases


def test_sentences_and_containment(spark, frame):
    text = " One. Two!  Three?\nfour éa. "
    got = frame("case_id int, text string", (1, text), (2, " "))
    assert rows(sg.sentences(got), "case_id", "sent_ord", "sentence") == [(1, 0, "One."), (1, 1, "Two!"), (1, 2, "Three?"), (1, 3, "four éa.")]
    pair = frame("t string, p string", ("A  big\nCat", "big cat"), ("x", ""), ("x", None))
    assert [r[0] for r in pair.select(tx.contains_norm("t", "p")).collect()] == [True, False, False]
    alt = frame("t string", ("A related entity owns it. No.",), ("A related entity does not own it.",))
    assert [r[0] for r in alt.select(tx.alt_satisfied("t", "(?iu)related entit", "(?iu)own")).collect()] == [True, False]


def test_pipe_tables(spark, frame):
    cells = frame("doc_id int, table_no int, row_no int, cells array<string>", (1, 1, 1, ["a \n b", None]), (1, 1, 2, [" ", ""]), (1, 1, 3, ["c", "d"]))
    lines = [r.line for r in sg.tables_to_pipe(cells).orderBy("row_no").collect()]
    assert lines == ["[TABLE 1]", "| a b |  |", "| c | d |", "[/TABLE 1]"]


def test_matches_against_python(spark, frame):
    text = "ab$1 cd $22ef$333" + "z" * 100 + "$4"
    got = frame("t string", (text,)).select(F.inline(tx.matches("t", r"\$(\d+)", {"whole": 0, "n": 1}, before=5, ahead=3, after=4))).collect()
    want = [(m.group(0), m.group(1), text[max(0, m.start() - 5) : m.start()], text[m.start() : m.start() + 3], text[m.end() : m.end() + 4]) for m in re.finditer(r"\$(\d+)", text)]
    assert [tuple(r) for r in got] == want


def test_attach(spark, frame):
    cases = frame("case_id string, status string, text string, officer string", ("a", "assessed", "form \n", "o"), ("b", "signed", "form", "o"), ("c", "new", "form", "o"))
    verdicts = frame("case_id string, rule_id string", ("a", "R1"), ("b", "R1"))
    ten = "w " * 10
    docs = frame("case_id string, name string, text string", ("a", " Plan ", f"\r\n{ten}"), ("b", "Plan", ten), ("c", "Plan", "too short"), ("z", "Plan", ten))
    merged, valid, refused = sg.attach_documents(cases, verdicts, docs)
    assert merged.filter("case_id = 'a'").first().text == "form\n\n=== DOCUMENT: Plan ===\n\n" + ten.strip()
    assert rows(merged, "case_id", "status", "officer") == [("a", "new", None), ("b", "signed", "o"), ("c", "new", "o")]
    assert rows(valid) == [("b", "R1")]
    assert rows(refused, "case_id", "reason") == [("b", "signed"), ("c", "too_short"), ("z", "unknown_case")]


def test_attach_several_to_one_case(spark, frame):
    cases = frame("case_id string, status string, text string, officer string", ("a", "new", "form", "o"))
    ten = ("w " * 10).strip()
    docs = frame("case_id string, ord int, name string, text string", ("a", 2, "B", ten), ("a", 1, "C", ten), ("a", 3, "A", "short"))
    merged, _, refused = sg.attach_documents(cases, frame("case_id string, rule_id string", ("a", "R")), docs)
    assert [r.text for r in merged.collect()] == [f"form\n\n=== DOCUMENT: C ===\n\n{ten}\n\n=== DOCUMENT: B ===\n\n{ten}"]
    assert refused.count() == 1


def test_whitespace_other_than_single_blanks_is_rewritten(spark, frame):
    texts = ["a b c", " a  b ", "a\tb", "a \t b", "\x1c a\n\n b c\xa0d", "", "  ", "a\x1fb c  "]
    got = [r[0] for r in frame("t string", *[(x,) for x in texts]).select(tx.collapse_space("t")).collect()]
    assert got == [" ".join(x.split()) for x in texts]
    blanks = frame("t string", ("x  y\t\tz w \t v",)).select(tx.guard_norm("t")).first()[0]
    assert blanks == "x y z w v"
    money = frame("t string", ("A$ 5 and aud 7, 9 Australian Dollars; 3 doLLars – ’tis﷐﷑ _8_ AUD",)).select(tx.guard_norm("t")).first()[0]
    assert money == "$5 and $7, $9; $3 - 'tis﷐﷑ $8"


def test_context_is_worked_out_for_its_readers_only(spark, frame):
    from eviflow.operators import crosscheck as xck

    docs = frame("case_id int, doc_ord int, doc string, body string", (1, 0, "D", "the total  budget is\n$12,000 now﷐. Letter of 3 pages. PH.D. 1999"), (2, 0, "E", None), (3, 0, "F", ""))
    found = xck.extract_values(docs)
    assert sorted((r.category, r.value, r.context) for r in found.collect()) == [
        ("budget_total", 12000, "the total budget is $12,000 now. Letter of 3 pages. PH.D. 1999"),
        ("letter_pages", 3, "the total budget is $12,000 now. Letter of 3 pages. PH.D. 1999"),
        ("phd_year", 1999, "the total budget is $12,000 now. Letter of 3 pages. PH.D. 1999"),
    ]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert tx.UNEVEN_SPACE in plan(found) and tx.UNEVEN_SPACE not in plan(found.select("case_id", "category", "value"))
