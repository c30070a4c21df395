"""The confirmation audit finds the latest lines once and searches short attestations without Python."""

from pyspark.sql import functions as F

from eviflow.operators import evidence as ec
from eviflow.plans import registry, review_queries

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_confirmation_audit_finds_the_latest_lines_once(spark):
    got = review_queries.confirmation_audit(registry.Tables(spark, SF_DIR))
    assert "lineitem" not in plan_of(got) and "l_orderkey" not in plan_of(got)


def test_attestations_short_and_long(frame):
    source = "The Form lists\n five red  barns in full"
    many = " ".join(f"w{i}" for i in range(200))
    cases = [
        ("he said form lists five red BARNS here", source, True), ("form lists five red", source, False), ("", source, False), (None, source, False),
        ("form lists five red barns", None, False), ("a form lists five blue red barns in full", source, False), (many, source, False),
        (f"{many} the form lists five red {many}", source, True), ("rm lists five red barn", "form lists five red barns", True),
    ]
    got = frame("a string, s string, want boolean", *cases).select("want", ec.attestation_found(F.col("a"), F.col("s")).alias("got"))
    assert all(r.got is r.want for r in got.collect())


def test_short_attestations_need_no_python(frame):
    short = frame("a string, s string", ("form lists five red barns", "the form lists five red barns")).select(F.length(F.col("a")).alias("n"), "a", "s")
    plan = plan_of(short.select(ec.attestation_found(F.col("a"), F.col("s"))))
    sent = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(sent) == 1 and f"> {ec.LONG_ATTESTATION}" in sent[0]
