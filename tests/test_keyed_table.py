import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eviflow.sources.keyed_table import KeyedTable, replace_rows
from eviflow.sources.writers import upsert_verdicts

SCHEMA = "case_id long, rule_id string, ai_verdict string, final_verdict string"


def files(path):
    return {os.path.join(d, f) for d, _, found in os.walk(f"{path}/data") for f in found if f.startswith("part-")}


@pytest.fixture
def table(spark, frame, tmp_path):
    made = KeyedTable.create(spark, str(tmp_path / "verdicts"), ["case_id", "rule_id"], frame(SCHEMA).schema, buckets=16)
    made.merge(frame(SCHEMA, *[(c, "R1", "met", "met") for c in range(200)]), "load", lambda current, changes: changes)
    return made


def test_only_touched_buckets_are_rewritten(spark, frame, table):
    before = files(table.path)
    assert len(before) == 16 and table.read().count() == 200
    changes = frame("case_id long, rule_id string, ai_verdict string, seq int", (7, "R1", "unclear", 1), (7, "R1", "not_met", 2), (500, "R9", "met", 1))
    touched = table.merge(changes, "b1", upsert_verdicts)
    new = files(table.path) - before
    assert before <= files(table.path) and {int(f.split("bucket=")[1].split("/")[0]) for f in new} == touched and len(new) == len(touched) <= 2
    found = {r.case_id: (r.ai_verdict, r.final_verdict) for r in table.read().collect()}
    assert found[7] == ("not_met", None) and found[500] == ("met", None) and found[8] == ("met", "met") and len(found) == 201


def test_a_repeated_batch_changes_nothing(spark, frame, table):
    changes = frame("case_id long, rule_id string, ai_verdict string, seq int", (3, "R1", "unclear", 1))
    table.merge(changes, "b1", upsert_verdicts)
    before, state = files(table.path), rows(table.read())
    assert table.merge(changes.withColumn("ai_verdict", F.lit("other")), "b1", upsert_verdicts) == set()
    assert files(table.path) == before and rows(table.read()) == state


def test_a_merge_without_commit_is_not_seen(spark, frame, table, monkeypatch):
    changes = frame("case_id long, rule_id string, ai_verdict string, seq int", (3, "R1", "unclear", 1))
    state = rows(table.read())
    monkeypatch.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.merge(changes, "b1", upsert_verdicts)
    assert rows(table.read()) == state
    monkeypatch.undo()
    table.merge(changes, "b1", upsert_verdicts)  # takes the place of the dead one
    assert rows(table.read().filter("case_id = 3"), "ai_verdict") == [("unclear",)]


def test_emptied_buckets_and_empty_batches(spark, frame, table):
    gone = frame(SCHEMA, *[(c, "R1", "met", "met") for c in range(200)])
    assert table.merge(gone.limit(0), "nothing", lambda current, changes: current) == set()
    assert table.merge(gone.limit(0), "nothing", lambda current, changes: current) == set()
    table.merge(gone, "clear", lambda current, changes: current.join(changes, ["case_id", "rule_id"], "left_anti"))
    assert table.read().count() == 0
    table.merge(gone.limit(5), "again", lambda current, changes: changes)
    assert table.read().count() == 5


def test_open_and_lookup(spark, frame, table):
    same = KeyedTable.open(spark, table.path)
    assert (same.keys, same.buckets, same.schema) == (table.keys, table.buckets, table.schema)
    found = same.lookup(frame("case_id long, rule_id string", (5, "R1"), (5, "R1"), (5, "R2"), (9999, "R1")))
    assert rows(found, "case_id", "rule_id") == [(5, "R1")]
    assert len({f.split("data/")[1].split("/part")[0] for f in found.inputFiles()}) <= 3  # of 16 buckets


def test_replace_rows_takes_the_last_change(spark, frame, table):
    changes = frame(SCHEMA + ", seq int", (1, "R1", "a", "x", 2), (1, "R1", "b", "y", 3), (1, "R1", "c", "z", 1))
    table.merge(changes, "b", replace_rows(table, ["seq"]))
    assert rows(table.read().filter("case_id = 1"), "ai_verdict", "final_verdict") == [("b", "y")]


def test_wrong_tables_are_refused(spark, frame, tmp_path):
    with pytest.raises(ValueError, match="columns"):
        KeyedTable.create(spark, str(tmp_path / "a"), ["nope"], frame(SCHEMA).schema)
    with pytest.raises(ValueError, match="buckets"):
        KeyedTable.create(spark, str(tmp_path / "b"), ["case_id"], frame(SCHEMA).schema, buckets=0)
