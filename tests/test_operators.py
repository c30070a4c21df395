import hashlib
import os
import shutil
from difflib import SequenceMatcher

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eviflow.operators import audit as au
from eviflow.operators import common as cm
from eviflow.operators import curate as cu
from eviflow.operators import evaluate as ev
from eviflow.operators import evidence as ec
from eviflow.operators import feedback as fb
from eviflow.operators import retrieval as rt
from eviflow.operators import review as rv

LOG = "seq bigint, ts string, case_id string, actor string, role string, action string, detail string"


def log(frame, n=40):
    rows_ = [(i * 3, f"t{i}", f"c{i % 2}" if i % 5 else None, "a", None if i % 3 else "r", "did", None if i % 4 else "{}") for i in range(n)]
    return frame(LOG, *rows_)


def test_chain_is_the_definition(spark, frame):
    built = au.build_chain(log(frame)).orderBy("seq").collect()
    prev = "GENESIS"
    for r in built:
        want = hashlib.sha256("|".join([prev, r.ts, r.case_id or "", r.actor, r.role or "", r.action, r.detail or ""]).encode()).hexdigest()
        assert (r.prev_hash, r.hash) == (prev, want)
        prev = want


@pytest.mark.parametrize("width", [7, 1000])
def test_verify_finds_edits_and_deletions(spark, frame, width):
    built = au.build_chain(log(frame)).cache()
    intact = au.verify_chain(built, width=width).first()
    assert intact.ok and intact.total == 40 and intact.head == built.orderBy(F.desc("seq")).first().hash
    for seq in (0, 21, 57):
        edited = built.withColumn("actor", F.when(F.col("seq") == seq, "x").otherwise(F.col("actor")))
        assert au.verify_chain(edited, width=width).first().broken_at_seq == seq
        deleted = built.filter(F.col("seq") != seq)
        assert au.verify_chain(deleted, width=width).first().broken_at_seq == seq + 3


def test_chain_in_batches(spark, frame, tmp_path):
    whole = rows(au.build_chain(log(frame)), "seq", "hash")
    assert rows(au.build_chain_in_batches(log(frame), str(tmp_path / "one"), chain=None), "seq", "hash") == whole
    with pytest.raises(ValueError):
        au.build_chain_in_batches(log(frame), str(tmp_path / "long"), chain=None, batch_rows=9)
    folder = str(tmp_path / "chain")
    per_case = rows(au.build_chain(log(frame), "case_id"), "seq", "hash")
    assert rows(au.build_chain_in_batches(log(frame), folder, "case_id", batch_rows=3), "seq", "hash") == per_case
    # A second run does not mix with the first; a resumed one goes on from what is there.
    with pytest.raises(ValueError):
        au.build_chain_in_batches(log(frame).limit(5), folder, "case_id", batch_rows=3)
    last = max(p for p in os.listdir(folder) if p.startswith("batch="))
    shutil.rmtree(f"{folder}/{last}")
    assert rows(au.build_chain_in_batches(log(frame), folder, "case_id", batch_rows=3, resume=True), "seq", "hash") == per_case


def test_chain_of_numbered_cases(spark, frame):
    built = au.build_chain(log(frame).withColumn("case_id", F.col("seq") % 3), "case_id")
    assert all(r.ok for r in au.verify_chain(built, "case_id").collect())


def test_each_fact_is_judged_alone(spark, frame):
    facts = frame(
        "ruleset_id string, case_id string, rule_id string, fact string, votes array<string>",
        ("s", "c", "R1", "this sentence names R99 as its own rule", ["no"]), ("s", "c", "R2", "this sentence names nothing of the kind here", ["no"]),
    )
    rules = frame("ruleset_id string, rule_id string", ("s", "R99"))
    done = cu.confirm_facts(facts, rules, facts.limit(0)).select("rule_id", "problem", "confirmed_by")
    assert rows(done) == [("R1", "leak", None), ("R2", None, "verifier")]


def test_nothing_is_cut_by_default(spark, frame):
    facts = [(f"fact {i}", 1, "k") for i in range(9)]
    df = frame("facts array<struct<fact:string,chunk_id:int,key_phrase:string>>, hits array<int>, coverage string", (facts, [1], None))
    assert len(ec.clean_facts(df).first().facts) == 9 and len(ec.clean_facts(df, limit=4).first().facts) == 4
    pool = spark.range(60).select(F.col("id").alias("case_id"), F.lit("R").alias("rule_id"))
    assert rv.post_audit_sample(pool, 45).count() == 45
    long = " ".join(f"word{i}" for i in range(90)) + "."
    quote = frame("chunk_text string, key_phrase string", (long, "word3 word4"))
    assert ec.best_sentence(quote).first().aq == long and len(ec.best_sentence(quote, max_words=40).first().aq.split()) == 41


def test_previous_and_position_over_buckets(spark, frame):
    df = frame("k string, seq bigint, v string", *[("ab"[i % 2], i * i, str(i)) for i in range(30)])
    for width in (10, 10**6):
        got = {(r.k, r.seq): r.p for r in cm.with_previous(df, ["k"], "seq", {"v": "p"}, width).collect()}
        assert got == {("ab"[i % 2], i * i): (str(i - 2) if i >= 2 else None) for i in range(30)}
        pos = {(r.k, r.seq): r.position for r in cm.with_position(df, ["k"], "seq", width=width).collect()}
        assert pos == {("ab"[i % 2], i * i): i // 2 + 1 for i in range(30)}


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = cm.top_k(df, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


# --- evidence ------------------------------------------------------------------------------------
def test_consistency_lock(spark, frame):
    df = frame(
        "id int, verdict string, confidence string, note string, supporting_fact int, n_facts int, coverage string",
        (1, "not_met", "high", "x", 0, 3, "partial"), (2, "not_met", "high", "x", 1, 3, "none"), (3, "not_met", "high", "x", 2, 3, "direct"),
        (4, "met", "medium", "x", 0, 3, "direct"), (5, "met", "high", "x", 9, 3, "direct"), (6, "unclear", "low", "x", None, 2, "partial"),
    )
    got = {r.id: r for r in ec.consistency_lock(df).collect()}
    assert [(got[i].verdict, got[i].confidence, got[i].supporting_fact) for i in range(1, 7)] == [
        ("unclear", "low", 1), ("unclear", "low", 1), ("not_met", "high", 2), ("met", "medium", 1), ("met", "high", 1), ("unclear", "low", 1),
    ]
    assert "[CONSISTENCY LOCK]" in got[1].note and got[3].note == "x"


def best(sentences, phrase):
    kp, top, score = " ".join(phrase.split()).lower(), sentences[0], -1.0
    for s in sentences:
        n = " ".join(s.split()).lower()
        value = SequenceMatcher(None, kp, n).ratio() + (1.0 if kp in n else 0.0)
        if value > score:
            top, score = s, value
    return top


def test_best_sentence(spark, frame):
    text = "The budget is fixed. The budget for pumps is $10,000 here. The budget for pumps is $10,000. Grain is sold. " + "word " * 60 + "end."
    parts = ["The budget is fixed.", "The budget for pumps is $10,000 here.", "The budget for pumps is $10,000.", "Grain is sold.", ("word " * 60 + "end.")]
    phrases = ["budget for pumps", "grain was solt", "nothing like it", "GRAIN  is", "the budget is"]
    got = {r.key_phrase: r.aq for r in ec.best_sentence(frame("key_phrase string, chunk_text string", *[(p, text) for p in phrases]), max_words=40).collect()}
    for p in phrases:
        want = best(parts, p).split()
        assert got[p] == (" ".join(want) if len(want) <= 40 else " ".join(want[:40]) + " ...")
    edge = ec.best_sentence(frame("key_phrase string, chunk_text string", ("", text), (None, text), ("x", "  ")))
    assert [r.aq for r in edge.collect()] == ["The budget is fixed.", "The budget is fixed.", "  "]
    long = ec.best_sentence(frame("key_phrase string, chunk_text string", ("word word end", text)), max_words=40).first().aq
    assert long.endswith(" ...") and ec.cite_ok(F.lit(long), F.lit(text)) is not None


def test_attestation_span(spark, frame):
    source = "The farm holds 120 cattle on the north block and sells grain."
    df = frame(
        "attestation string, source string",
        ("I saw: the FARM holds 120 cattle on the north paddock", source), ("farm holds 120 cattle", source), ("nothing that is in there at all", source),
        ("holds 120 cattle on the, and the north block and sells grain. yes", source),
    )
    assert [r.span for r in ec.attestation_span(df).collect()] == [
        "the farm holds 120 cattle on the north", None, None, "the north block and sells grain.",
    ]


def test_redact(spark, frame):
    letter = "Mail a@b.org or c@d.org today. Call +61 2 5550 1234. Due 2026-01-09, sent 2026-01-02 or x2026-01-03."
    out = ec.redact_letters(frame("letter string, allowed string", (letter, "known: a@b.org 2026-01-02")), "2026-01-02").first().letter
    # The phone pattern comes first and takes dates that the input does not hold.
    phone = "{CONTACT PHONE — to be completed by staff}"
    mail = "{CONTACT EMAIL — to be completed by staff}"
    assert out == f"Mail a@b.org or {mail} today. Call {phone}. Due {phone}, sent 2026-01-02 or x{phone}."


def test_retrieval_fills_with_zero_scores(spark, frame):
    chunks = frame("case_id string, chunk_id int, text string", ("a", 0, "zebra"), ("a", 1, "wine sales"), ("a", 2, "?"), ("a", 3, "wine"), ("b", 0, "wine"))
    sets = frame("case_id string, ruleset_id string", ("a", "s"), ("b", "s"))
    rules = frame("ruleset_id string, rule_id string, title string, quote string", ("s", "r", "Wine", "wine sales"), ("z", "q", "x", "x"))
    got = rt.retrieve(chunks, sets, rules, 3).orderBy("case_id", "rank").collect()
    assert [(r.case_id, r.chunk_id) for r in got] == [("a", 1), ("a", 3), ("a", 0), ("b", 0)]
    assert got[2].score == 0.0 and got[0].score > got[1].score > 0


def test_dense(spark, frame):
    vectors = frame("case_id string, chunk_id int, vector array<float>", ("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("a", 2, [0.6, 0.8]))
    queries = frame("case_id string, query_id string, query array<float>", ("a", "x", [1.0, 0.0]), ("a", "y", [0.0, 1.0]))
    got = rt.dense_topk(queries, vectors, 2)
    assert rows(got, "query_id", "chunk_id", "score") == [("x", 0, 1.0), ("x", 2, 0.6), ("y", 1, 1.0), ("y", 2, 0.8)]


# --- review, curation, feedback ------------------------------------------------------------------
def test_confirmation_rules(spark, frame):
    verdicts = frame(
        "case_id string, rule_id string, ai_verdict string, final_verdict string, note string, guard_level string, aq string, officer_reason string, confirmed_at string, evidence_ack boolean",
        ("c", "1", "met", "not_addressed", "", "code-guarded", "", "", "t", False), ("c", "2", "met", "not_met", "", "code-guarded", "", "short", "t", False),
        ("c", "3", "met", "met", "", "llm-only", "quote", "", "t", True), ("c", "4", "met", "met", "", "needs-manual-guard", "quote", "we saw the farm", "t", True),
        ("c", "5", "met", "met", "", "llm-only", "", "we saw the farm holds 120 cattle", "t", False), ("c", "6", "met", "met", "", "llm-only", "", "we believe that it is fine", "t", False),
        ("c", "7", "met", "met", "", "needs-manual-guard", "", "the farm holds 120 cattle on it", "t", False), ("c", "8", "met", "met", "", "llm-only", "", "The farm  holds 120 cattle on it", "t", False),
        ("c", "9", "met", "met", "", "code-guarded", "", "", "t", False),
    )
    cases = frame("case_id string, text string", ("c", "Here the farm holds 120 cattle."))
    got = {r.rule_id: (r.attestation, r.problem) for r in rv.confirmation_audit(verdicts, cases).collect()}
    assert got == {
        "1": (None, "bad_final"), "2": (None, "reason_required"), "3": ("ai_quote_ack", None), "4": (None, "attestation_too_short"),
        "5": ("officer_quote", None), "6": (None, "no_verbatim_quote"), "7": (None, "duplicate_attestation"), "8": (None, "duplicate_attestation"), "9": (None, None),
    }


def test_transitions(spark, frame):
    history = frame(
        "case_id string, seq bigint, status string, reason string",
        ("a", 1, "assessed", ""), ("a", 2, "in_review", ""), ("a", 3, "signed", ""), ("a", 4, "in_review", "no"), ("a", 5, "letter_approved", ""), ("b", 9, "signed", ""),
    )
    got = rv.transition_violations(history, rv.state_machine(spark))
    assert rows(got, "case_id", "seq", "problem") == [("a", 4, "reason_required"), ("a", 5, "edge_not_allowed"), ("b", 9, "edge_not_allowed")]


def test_separation_of_duties(spark, frame):
    cases = frame("ruleset_id string, case_id string, target string, target_label_clear boolean, status string", ("s", "A", None, None, "pending_review"), ("s", "B", "R1", False, "needs_review"))
    labels = frame("ruleset_id string, case_id string, rule_id string, truth string, weak boolean, control boolean", ("s", "A", "R1", "met", False, True), ("s", "B", "R1", "not_met", False, False))
    edits = frame("ruleset_id string, case_id string, rule_id string, seq int, action string, by string",
                  ("s", "B", None, 1, "confirm_target", None), ("s", "B", None, 2, "dispute", "Hugo"), ("s", "A", "R1", 3, "flag_weak", None))
    new_cases, new_labels, _ = cu.apply_edits(cases, labels, edits)
    assert rows(new_cases, "case_id", "status", "target_label_clear") == [("A", "pending_review", False), ("B", "disputed", True)]
    assert rows(new_labels, "case_id", "weak", "control") == [("A", True, False), ("B", False, False)]
    ask = frame("ruleset_id string, approver string", ("s", "Hugo"), ("s", "Petra"), ("t", "Petra"))
    texts = frame("ruleset_id string, case_id string, text string", ("s", "B", "This violates R1."))
    rules = frame("ruleset_id string, rule_id string", ("s", "R1"))
    report = cu.approval_report(ask, new_cases, edits, texts, rules)
    assert rows(report, "approver", "outcome") == [("Hugo", "approver_is_reviewer"), ("Petra", "approved"), ("Petra", "no_testset")]
    early = cu.approval_report(ask, cases, edits.filter("false"), texts, rules)
    assert dict(rows(early.filter("ruleset_id = 's'"), "approver", "outcome")) == {"Hugo": "cases_need_review", "Petra": "cases_need_review"}


def test_text_gates(spark, frame):
    rules = frame("ruleset_id string, rule_id string", ("s", "R1"), ("s", "R-2"))
    texts = frame(
        "ruleset_id string, case_id string, text string, fact string",
        ("s", "a", "We farm. This violates R1. We keep R12 goats.\nAll is well.", "We keep R12 goats."), ("s", "b", "We hold R-2 land. [[FACT]] Sheep.", None), ("s", "c", "We farm.", "We sail."),
    )
    leaks = {r.case_id: (r.n_ids, r.comment, r.marker_left) for r in cu.leak_problems(texts, rules).collect()}
    assert leaks == {"a": (1, "violates", False), "b": (1, None, True)}
    fixed = cu.repair_meta(texts, rules)
    assert rows(fixed, "case_id", "text", "removed") == [
        ("a", "We farm. We keep R12 goats.\nAll is well.", ["This violates R1."]), ("b", "[[FACT]] Sheep.", ["We hold R-2 land."]), ("c", "We farm.", []),
    ]
    assert rows(cu.gate_texts(fixed, rules), "case_id", "problem") == [("a", None), ("b", None), ("c", "fact_missing")]
    planted = frame("id int, text string, fact string", (1, "A [[FACT]] B [[FACT]] C. F one. D", "F one."), (2, "A  ", "F one."))
    assert rows(cu.insert_fact(planted), "id", "text", "placement") == [
        (1, "A F one. B C. D", "marker"), (2, "A\n\nAdditional Details\nF one.", "appended"),
    ]


def test_false_pass_counts_unassessed_rules(spark, frame):
    pred = frame("case_id string, rule_id string, pred string", ("a", "1", "met"))
    truth = frame("case_id string, rule_id string, truth string", ("a", "1", "not_met"), ("a", "2", "not_met"), ("b", "1", "not_met"))
    assert tuple(ev.false_pass(pred, truth).first()) == (1, 2)


def test_fewshot_block(spark, frame):
    feedback = frame(
        "ord int, rule string, ruleset string, kind string, facts array<string>, ai_verdict string, final_verdict string, officer_reason string",
        *[(i, "R1", None, "override", [f"f{i}", "g", "h", "i"], "met", "not_met", "z" * 200) for i in range(4)], (9, "R1", None, "override", [], "met", "met", ""),
    )
    block = fb.fewshot_block(fb.fewshot(feedback), facts=3, reason_chars=160).first()
    assert block.ruleset == "nsf-22-586" and block.block.index("f2; g; h") < block.block.index("f3; g; h") and "z" * 161 not in block.block
    assert "f1;" not in block.block and not block.block.count("; i")
