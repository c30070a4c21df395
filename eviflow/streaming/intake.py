"""Intake streams: every arriving dossier is screened and cross-checked, and its verdicts are guarded as they come.

For screening and cross-checks a dossier is one row, so nothing is kept between batches; results of a batch are written
under its batch id, which makes a repeated batch overwrite itself. Guarded verdicts need what came before: the ruleset
that a case was first assessed under, the hits on its latest text and its latest verdicts are keyed state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eviflow.operators import crosscheck, guards, names
from eviflow.operators.common import cut


#: A failing batch is tried again in this many parts; parts that fail are cut in turn.
PARTS = 8
#: More bad keys than this in a batch are taken for a fault of the system.
MAX_BAD = 1000

Work = Callable[[DataFrame, str], dict[str, DataFrame]]


def isolated(batch: DataFrame, work: Work, out: str, label: str, key: str = "case_id") -> list[tuple[str, str]]:
    """Write ``work(batch, label)`` (result name -> rows) under ``out``; returns the keys that cannot be worked on.

    If the batch fails, it is tried again in ``PARTS`` parts by the key's hash, and so on down to single keys, so one bad
    row holds up nothing but itself. A part that failed leaves empty results. Where every part of every part fails, or more
    than ``MAX_BAD`` keys do, it is no matter of bad rows, and the error is raised.
    """

    def attempt(rows: DataFrame, name: str) -> Exception | None:
        done = []
        try:
            for result, found in work(rows, name).items():
                done.append((f"{out}/{result}/batch={name}", found))
                found.write.mode("overwrite").parquet(done[-1][0])
        except Exception as error:  # which one does not matter: the rows behind it are looked for
            for path, found in done:
                found.sparkSession.createDataFrame([], found.schema).write.mode("overwrite").parquet(path)
            return error
        return None

    def split(rows: DataFrame, name: str, error: Exception, depth: int) -> list[tuple[str, str]]:
        keys = rows.select(F.col(key).cast("string")).distinct().limit(2).collect()
        if len(keys) <= 1:
            return [(keys[0][0], f"{type(error).__name__}: {error}"[:1000])] if keys else []
        part = F.pmod(F.xxhash64(F.lit(depth), key), F.lit(PARTS))
        failed = [(k, attempt(rows.filter(part == k), f"{name}-{k}")) for k in range(PARTS)]
        failed = [(k, e) for k, e in failed if e is not None]
        whole[depth] = whole.get(depth, True) and len(failed) == PARTS
        if depth == 1 and whole[0] and whole[1]:
            raise error
        for k, e in failed:
            bad.extend(split(rows.filter(part == k), f"{name}-{k}", e, depth + 1))
            if len(bad) > MAX_BAD:
                raise error
        return []

    bad: list[tuple[str, str]] = []
    whole: dict[int, bool] = {}
    error = attempt(batch, label)
    if error is not None:
        bad.extend(split(batch, label, error, 0))
    return bad


def _each_batch(stream: DataFrame, checkpoint: str, work: Work, out: str, once: bool) -> StreamingQuery:
    """Run ``work`` on each batch; rows that it fails on go to ``quarantine`` under ``out`` with their error."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            bad = isolated(batch, work, out, f"b{batch_id}")
            if bad:
                spark = batch.sparkSession
                listed = spark.createDataFrame(bad, "key string, error string")
                held = batch.join(F.broadcast(listed), F.col("case_id").cast("string") == F.col("key"))
                held.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/quarantine/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def replay(spark: SparkSession, out: str, work: Work) -> list[tuple[str, str]]:
    """Work on the quarantined rows again, once what made them fail is mended; returns those that still fail."""
    held = spark.read.parquet(f"{out}/quarantine")
    return isolated(held.drop("key", "error", "batch", "batch_id"), work, out, "replay")


def screening(banned: DataFrame, sanctions: tuple[DataFrame, DataFrame], out: str) -> Work:
    """Register hits and risk of a batch of cases."""

    def work(batch: DataFrame, label: str) -> dict[str, DataFrame]:
        hits = cut(names.screen_hits(batch, banned, sanctions), f"{out}/work/{label}")
        return {"hits": hits, "risk": names.screen_risk(batch, hits)}

    return work


def screen_stream(
    cases: DataFrame,
    banned: DataFrame,
    sanctions: tuple[DataFrame, DataFrame],
    out: str,
    checkpoint: str,
    once: bool = True,
) -> StreamingQuery:
    """Register hits and screening risk of newly uploaded cases ``(case_id, applicant, org)``, one folder per batch.

    A case that cannot be screened does not hold up the others; it is listed in ``quarantine``, for :func:`replay`.
    """
    return _each_batch(cases, checkpoint, screening(banned, sanctions, out), out, once)


def assess_stream(
    cases: DataFrame, as_of: str, out: str, checkpoint: str, rules: DataFrame | None = None, once: bool = True
) -> StreamingQuery:
    """Cross-check report and compiled-guard hits of arriving dossiers ``(case_id, ruleset_id, text)``.

    The report of a dossier is one row with its findings inside, so a batch is read once and written once;
    :func:`written_findings` unfolds it.
    """
    constraints = guards.compile_rules(rules) if rules is not None else None

    def work(batch: DataFrame, label: str) -> dict[str, DataFrame]:
        found = {"report": crosscheck.dossier_report(batch, as_of).drop("figures")}
        if constraints is not None:
            found["hits"] = guards.evaluate_constraints(constraints, batch)
        return found

    return _each_batch(cases, checkpoint, work, out, once)


def written_findings(spark: SparkSession, out: str) -> DataFrame:
    """Findings of all batches written so far, one row each."""
    return spark.read.parquet(f"{out}/report").select("case_id", F.inline_outer("findings")).filter("category IS NOT NULL")
