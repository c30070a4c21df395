"""The appended audit log against chains built and verified whole."""

import pytest
from pyspark.sql import functions as F

from eviflow.operators import audit as au
from eviflow.sources import audit_log

CASES = [None, "", *[f"c{i}" for i in range(300)]]
ROWS = [(i, CASES[(i * i + i // 7) % len(CASES)], f"2024-01-{i % 28 + 1:02}", "a", None, "edit", f"d{i}") for i in range(900)]
SCHEMA = "seq bigint, case_id string, ts string, actor string, role string, action string, detail string"


@pytest.fixture(scope="module")
def logged(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("audit") / "log")
    assert audit_log.last_epoch(spark, folder) == 0
    for n, (lo, hi) in enumerate([(0, 400), (400, 600), (600, 900)]):
        assert audit_log.append(spark.createDataFrame(ROWS[lo:hi], SCHEMA), folder) == n + 1
    return folder


def found(df):
    return sorted(map(tuple, df.select("case_id", "ok", "broken_at_seq", "total", "head").collect()), key=repr)


def test_epochs_equal_one_chain(spark, logged):
    whole = au.build_chain(spark.createDataFrame(ROWS, SCHEMA), "case_id")
    assert {(r.seq, r.hash) for r in audit_log.tail(spark, logged, 0).collect()} == {(r.seq, r.hash) for r in whole.collect()}
    with pytest.raises(ValueError):
        audit_log.append(spark.createDataFrame(ROWS[5:6], SCHEMA), logged)
    assert audit_log.last_epoch(spark, logged) == 3


def test_tail_finds_what_the_full_check_finds(spark, logged):
    edited = lambda df: df.withColumn("detail", F.when(F.col("seq").isin(610, 777, 899), "x").otherwise(F.col("detail")))
    full = found(au.verify_chain(edited(audit_log.tail(spark, logged, 0)), "case_id", width=50))
    assert sum(not r[1] for r in full) == 3
    for epoch in (1, 2):
        rows = audit_log.tail(spark, logged, epoch)
        assert "(epoch#" in (pruned := rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]) and f" > {epoch})" in pruned
        assert found(audit_log.verify_tail(edited(rows), audit_log.heads_at(spark, logged, epoch), width=50)) == full


def test_tree_and_proofs(spark, logged):
    assert audit_log.last_good(spark, logged) == 3
    root = spark.read.parquet(f"{logged}/nodes").filter("epoch = 2 and level = 0").first()["hash"]
    for key in (None, "", "c17"):
        bucket, above = audit_log.proof(spark, logged, 2, key)
        start = "null|" if key is None else f"={key}|"
        mine = [line for line in bucket if line.startswith(start)]
        for line in mine:
            assert len(above) == 1 and audit_log.proven(root, line, key, bucket, above)
            assert not audit_log.proven(root, line + "0", key, bucket, above)
            assert not audit_log.proven(root, line, key, [b + "0" if b != line else b for b in bucket] + ["z"], above)


def test_changed_heads_are_found(spark, logged, tmp_path):
    """A head of the last epoch is changed: its bucket and the root differ, and the epoch before is the last good one."""
    folder = str(tmp_path / "copy")
    heads = spark.read.parquet(f"{logged}/heads")
    key = heads.filter("epoch = 3 and case_id is not null").agg(F.min("case_id")).first()[0]
    changed = F.when((F.col("epoch") == 3) & (F.col("case_id") == key), F.lit("0")).otherwise(F.col("hash"))
    heads.withColumn("hash", changed).write.partitionBy("epoch").parquet(f"{folder}/heads")
    spark.read.parquet(f"{logged}/nodes").write.partitionBy("epoch").parquet(f"{folder}/nodes")
    assert sorted(r["level"] for r in audit_log.damaged(spark, folder, 3).collect()) == [0, 1]
    assert audit_log.last_good(spark, folder) == 2


def test_empty_append(spark, tmp_path):
    folder = str(tmp_path / "log")
    audit_log.append(spark.createDataFrame([], SCHEMA), folder)
    assert audit_log.last_epoch(spark, folder) == 0
    assert audit_log.append(spark.createDataFrame(ROWS[:3], SCHEMA), folder) == 1
    assert audit_log.append(spark.createDataFrame([], SCHEMA), folder) == 2
