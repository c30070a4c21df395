import json

from conftest import rows

from eviflow.operators import crosscheck as xck
from eviflow.operators import names as nm
from eviflow.sources import readers, writers
from eviflow.streaming import intake


def dump(path, doc):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc), encoding="utf-8")


def test_rulesets(spark, tmp_path):
    rule = {"id": "R1", "type": "qualitative", "title": "t", "quote": "q"}
    dump(tmp_path / "index.json", {"default": "b", "rulesets": [{"id": "a", "file": "a.json", "name": "From index", "region": "AU", "version": "7"}, {"id": "b", "file": "b.json"}]})
    dump(tmp_path / "a.json", {"id": "a", "rules": [rule, {**rule, "id": "R2"}], "status": "draft"})
    dump(tmp_path / "b.json", {"id": "b", "name": "Own", "version": "2", "rules": [rule]})
    dump(tmp_path / "unlisted.json", {"id": "u", "rules": [rule]})
    sets, rules = readers.read_rulesets(spark, str(tmp_path))
    assert rows(sets, "ruleset_id", "name", "version", "region", "is_default") == [("a", "From index", "7", "AU", False), ("b", "Own", "2", "", True)]
    assert rows(rules, "ruleset_id", "rule_id", "ord") == [("a", "R1", 0), ("a", "R2", 1), ("b", "R1", 0)]
    assert readers.select_ruleset(sets).first().ruleset_id == "b"
    assert readers.select_ruleset(sets, "a", require_approved=True).count() == 0


def test_applications(spark, tmp_path):
    dump(tmp_path / "apps" / "manifest.json", {"cases": [{"id": "A1", "file": "a 1.txt", "tags": ["x"], "ruleset": "s"}, {"id": "A2", "file": "generated/b.txt"}]})
    dump(tmp_path / "apps" / "a 1.txt", "one\ntwo")
    dump(tmp_path / "apps" / "generated" / "b.txt", "drei")
    got = readers.read_applications(spark, str(tmp_path / "apps"))
    assert rows(got, "case_id", "text", "ruleset_id") == [("A1", "one\ntwo", "s"), ("A2", "drei", None)]


def test_registers(spark, tmp_path):
    dump(tmp_path / "b.csv", "﻿BD_PER_NAME,BD_PER_TYPE,BD_PER_DOC_NUM,BD_PER_START_DT,BD_PER_END_DT,BD_PER_ADD_STATE,BD_PER_ADD_COUNTRY\n\"LEE, ANN\",Banned,1,01/01/2020,bad,NSW,AU\nSOLO,Banned,2,01/01/2020,5/1/2021,,\n")
    got = readers.read_banned(spark, str(tmp_path / "b.csv"), "2022-01-01").orderBy("ord").collect()
    assert [(r.name, r.norms[1], r.active) for r in got] == [("LEE, ANN", "ANN LEE", True), ("SOLO", "SOLO", False)]
    dump(tmp_path / "s.csv", "Reference,Name of Individual or Entity,Type,Name Type,Date of Birth,Citizenship,Committees\n12,Max,Individual,Primary,1970,,C\n12a,Maxi,,Alias,,DE,\n")
    entries, aliases = readers.read_sanctions(spark, str(tmp_path / "s.csv"))
    assert rows(entries, "ref", "n_aliases", "citizenship") == [("12", 2, "DE")] and aliases.count() == 2


def test_registry_xml_and_index(spark, tmp_path):
    dump(
        tmp_path / "r.xml",
        """<Transfer><ABR><ABN status="ACT">01</ABN><EntityType><EntityTypeInd>PUB</EntityTypeInd></EntityType><MainEntity><NonIndividualName>
<NonIndividualNameText>Acme Pty Ltd</NonIndividualNameText></NonIndividualName><BusinessAddress><AddressDetails><State>NT</State><Postcode>0800</Postcode>
</AddressDetails></BusinessAddress></MainEntity></ABR><ABR><ABN status="CAN">02</ABN><LegalEntity><IndividualName><GivenName>Ann</GivenName>
<GivenName>B</GivenName><FamilyName>Lee</FamilyName></IndividualName></LegalEntity></ABR><ABR><ABN status="ACT">03</ABN></ABR></Transfer>""",
    )
    reg = readers.read_registry_xml(spark, str(tmp_path / "r.xml"))
    assert rows(reg, "abn", "name", "status", "entity_type", "state", "postcode") == [("01", "Acme Pty Ltd", "ACT", "PUB", "NT", "0800"), ("02", "Ann B Lee", "CAN", "", "", "")]
    writers.build_registry_index(reg, str(tmp_path / "idx"))
    stored, tokens = writers.read_registry_index(spark, str(tmp_path / "idx"))
    found = nm.lookup_registry(spark.createDataFrame([("ACME",)], "norm string"), stored, tokens)
    assert tokens.count() == 6 and found.count() == 0
    assert nm.lookup_registry(spark.createDataFrame([("LTD ACME PTY",)], "norm string"), stored, tokens).first().abn == "01"


def test_people_labels_and_results(spark, tmp_path):
    dump(tmp_path / "o.json", {"sla_days": {"new": 2}, "officers": [{"name": "A", "role": "manager", "affiliations": ["X"], "password": "secret"}]})
    officers, sla = readers.read_officers(spark, str(tmp_path / "o.json"))
    assert "password" not in officers.columns and rows(sla) == [("new", 2)] and officers.first().ord == 0
    dump(tmp_path / "l.json", {"labels": {"c": {"R1": "met", "R2": "not_met"}}, "bias_pairs": [["c", "d"]]})
    truth, pairs = readers.read_labels(spark, str(tmp_path / "l.json"))
    assert rows(truth) == [("c", "R1", "met"), ("c", "R2", "not_met")] and rows(pairs) == [("c", "d")]
    case = {"id": "A", "target": "R1", "labels": {"R1": "not_met", "R2": "met"}, "weak_labels": ["R2"], "status": "approved"}
    dump(tmp_path / "t" / "g.json", {"ruleset": "s", "approved": True, "cases": [case]})
    sets, cases, labels = readers.read_testsets(spark, str(tmp_path / "t"))
    assert rows(sets, "ruleset_id", "label_scope") == [("s", "full")] and rows(cases, "case_id", "target") == [("A", "R1")]
    assert rows(labels, "rule_id", "truth", "weak", "control") == [("R1", "not_met", False, False), ("R2", "met", True, False)]
    dump(tmp_path / "e" / "e.json", {"ruleset": "s", "target": {"correct": 1, "total": 2, "false_pass": 0}, "control": None, "provisional": False})
    assert rows(readers.read_evals(spark, str(tmp_path / "e")), "ruleset_id", "target_correct", "false_alarm") == [("s", 1, None)]


def test_feedback_and_tuning_files(spark, tmp_path):
    assert readers.read_feedback(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([("c", "R1", "q", ["a", "b"], "met", ""), ("d", "R1", "q", [], "met", "")], "case string, rule string, rule_quote string, facts array<string>, final_verdict string, officer_reason string")
    writers.write_feedback(df, str(tmp_path / "f"))
    writers.write_feedback(df, str(tmp_path / "f"))
    assert readers.read_feedback(spark, str(tmp_path / "f")).count() == 4
    writers.write_sft(df, str(tmp_path / "sft"), "You judge.")
    line = json.loads(spark.read.text(str(tmp_path / "sft")).first().value)
    assert [m["role"] for m in line["messages"]] == ["system", "user", "assistant"]
    assert "1. a\n2. b" in line["messages"][1]["content"] and json.loads(line["messages"][2]["content"])["supporting_fact"] == 1
    writers.write_eval(df.select("case"), str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev")).count() == 2


def test_intake(spark, frame):
    df = frame("text binary", (b"w " * 39 + b"\xff end\r\nx ",), (b"short",))
    got = readers.intake_text(df).collect()
    assert [(r.n_words, r.accepted) for r in got] == [(42, True), (1, False)] and got[0].text.endswith("end\nx")


def test_streams_equal_batches(spark, frame, tmp_path):
    cases = frame("case_id string, ruleset_id string, applicant string, org string, text string",
                  ("a", "s", "Max Power", "X", "Total budget $5,000 and total cost $6,000."), ("b", "s", "Nobody", "Y", "plain"))
    cases.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cases.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rules = frame("ruleset_id string, rule_id string, quote string", ("s", "r", "A total budget of at least $7,000."))
    intake.assess_stream(stream, "2026-01-01", str(tmp_path / "out"), str(tmp_path / "ck"), rules).awaitTermination()
    findings, _ = xck.crosscheck(cases, "2026-01-01")
    assert rows(intake.written_findings(spark, str(tmp_path / "out")), *findings.columns) == rows(findings)
    assert rows(spark.read.parquet(str(tmp_path / "out" / "hits")), "case_id", "verdict") == [("a", "not_met")]
    banned = readers.banned_from(frame(
        "ord int, BD_PER_NAME string, BD_PER_TYPE string, BD_PER_DOC_NUM string, BD_PER_START_DT string, BD_PER_END_DT string, BD_PER_ADD_STATE string, BD_PER_ADD_COUNTRY string",
        (1, "POWER, MAX", "Banned", "1", "", "", "", "")), "2026-01-01")
    none = frame("ord int, " + ", ".join(f"`{c}` string" for c in readers.SANCTION_COLUMNS))
    intake.screen_stream(stream, banned, readers.sanctions_from(none), str(tmp_path / "s"), str(tmp_path / "ck2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "s" / "risk")), "case_id", "risk") == [("a", "review_strong"), ("b", "clear")]
