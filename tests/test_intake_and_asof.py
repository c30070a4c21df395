import json
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eviflow.operators.asof import as_of_join
from eviflow.sources import readers
from eviflow.streaming import intake

START = datetime(2020, 1, 1)


@pytest.mark.parametrize("width", [3_600, 86_400, 10**9])
def test_as_of_join_equals_brute_force(spark, frame, width):
    rng = random.Random(width)
    time = lambda: rng.choice([None, START + timedelta(hours=rng.randrange(0, 400))])
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), time()) for i in range(300)]
    right = [(key(), time(), rng.randrange(50)) for _ in range(150)]
    found = as_of_join(frame("id int, k string, at timestamp_ntz", *left), frame("k string, since timestamp_ntz, version int", *right), ["k"], "at", "since", ["version", "since"], width)
    want = []
    for i, k, at in left:
        held = [(s, v) for kk, s, v in right if kk == k and s is not None and at is not None and s <= at]
        last = max(held, default=(None, None))
        want.append((i, k, at, last[1], last[0]))
    assert rows(found) == sorted(want, key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert any(r[3] is None for r in want) and any(r[3] is not None for r in want)


def poisoned(fails):
    """Work that breaks on some cases."""

    def work(batch, label):
        n = F.when(F.col("case_id").isin(fails), F.raise_error(F.lit("cannot be read"))).otherwise(F.length("text"))
        return {"sizes": batch.select("case_id", n.alias("n"))}

    return work


def test_bad_rows_do_not_hold_up_the_others(spark, frame, tmp_path):
    batch = frame("case_id long, text string", *[(i, "x" * i) for i in range(60)]).coalesce(1)
    bad = intake.isolated(batch, poisoned([7, 31]), str(tmp_path), "b0")
    assert sorted(k for k, _ in bad) == ["31", "7"] and all("cannot be read" in e for _, e in bad)
    assert sorted(r.case_id for r in spark.read.parquet(f"{tmp_path}/sizes").collect()) == [i for i in range(60) if i not in (7, 31)]


def test_a_fault_of_the_system_is_raised(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(intake, "PARTS", 3)
    batch = frame("case_id long, text string", *[(i, "x") for i in range(100)]).coalesce(1)
    with pytest.raises(Exception, match="cannot be read"):
        intake.isolated(batch, poisoned(list(range(100))), str(tmp_path), "b0")


def test_stream_lists_bad_rows_and_replays_them(spark, frame, tmp_path):
    frame("case_id long, text string", *[(i, "x" * i) for i in range(20)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("case_id long, text string").parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    intake._each_batch(stream, f"{tmp_path}/state", poisoned([5]), out, True).awaitTermination()
    assert spark.read.parquet(f"{out}/sizes").count() == 19
    assert [(r.case_id, r.text) for r in spark.read.parquet(f"{out}/quarantine").collect()] == [(5, "x" * 5)]
    assert intake.replay(spark, out, poisoned([])) == []
    assert sorted(r.n for r in spark.read.parquet(f"{out}/sizes").collect()) == list(range(20))


def test_applications_in_folders_of_one_name(spark, tmp_path):
    """The folder's name occurs twice in the path, and holds characters that patterns read otherwise."""
    folder = tmp_path / "apps (1)+" / "x" / "apps (1)+"
    (folder / "sub").mkdir(parents=True)
    (folder / "a b.txt").write_text("one")
    (folder / "sub" / "c.txt").write_text("two")
    cases = [{"id": "A", "file": "a b.txt"}, {"id": "B", "file": "sub/c.txt"}, {"id": "C", "file": "none.txt"}]
    (folder / "manifest.json").write_text(json.dumps({"cases": cases}))
    assert rows(readers.read_applications(spark, str(folder)), "case_id", "text") == [("A", "one"), ("B", "two"), ("C", None)]
