"""Guard-checked verdicts of dossiers and verdicts that arrive one by one.

Two keyed states, one after the other. The first holds the ruleset that a case was first uploaded under: a later upload
is read by that one, whatever it names. Texts only pass through; between the states they are reduced to their guard
hits. The second holds, per case, the hits on its latest upload and the latest verdict of each rule since, and gives a
row whenever a verdict or the hits under it change. Both states are small: no text is kept. Each is one value per case,
read once and written once per batch, since every call to the state store is a round trip between Python and the JVM; a
checkpoint written with a map entry per rule can't be resumed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.window import Window

from eviflow.operators import guards

PASSED = "case_id {key}, seq bigint, ruleset_id string, text string, directorate string"
GUARDED = (
    "case_id {key}, seq bigint, rule_id string, ruleset_id string, upload bigint, verdict string, confidence string, note string, "
    "hit_verdict string, source string, reason string"
)
HELD = (
    "upload bigint, ruleset_id string, hits array<struct<rule_id:string,verdict:string,source:string,reason:string>>, "
    "verdicts array<struct<rule_id:string,seq:bigint,verdict:string,confidence:string,note:string>>"
)
EVENT = ["case_id", "seq", "ruleset_id", "hits", "rule_id", "verdict", "confidence", "note"]


class LockedRuleset(StatefulProcessor):
    """Dossiers with the ruleset of the case's first upload."""

    def init(self, handle) -> None:
        self.lock = handle.getValueState("ruleset", "ruleset_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        uploads = sorted(rows, key=lambda r: r.seq)
        held = self.lock.get()
        if held is not None:
            locked = held[0]
        else:
            locked = uploads[0].ruleset_id
            self.lock.update((locked,))
        for r in uploads:
            yield Row(case_id=r.case_id, seq=r.seq, ruleset_id=locked, text=r.text, directorate=r.directorate)

    def close(self) -> None:
        pass


def merge_hits(hits: list[dict]) -> dict[str, tuple[str, str, str]]:
    """rule -> (verdict, source, reason), as :func:`guards.merged` gives them for hits of all layers."""
    first: dict[tuple[str, bool], tuple] = {}
    for h in hits:
        at = (h["rule_id"], h["layer"] == guards.COMPILED)
        found = (h["layer"], h["ord"], h["verdict"], h["reason"])
        if at not in first or found[:2] < first[at][:2]:
            first[at] = found
    out = {}
    for rule in {rule for rule, _ in first}:
        hand, compiled = first.get((rule, False)), first.get((rule, True))
        if hand and compiled:
            strict = "not_met" in (hand[2], compiled[2])
            out[rule] = ("not_met" if strict else hand[2], "hand+compiler", f"{hand[3]} | {compiled[3]}")
        else:
            one = hand or compiled
            out[rule] = (one[2], "hand" if hand else "compiler", one[3])
    return out


class LatestVerdicts(StatefulProcessor):
    """Verdicts with the hit on the latest upload, again whenever either changes.

    An upload voids the verdicts before it. A verdict that arrives ahead of its upload waits for it; uploads and
    verdicts older than what is held change nothing.
    """

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        uploads, given = {}, {}
        for r in rows:
            if r.rule_id is None:
                uploads.setdefault(r.seq, []).append(r)
            elif r.rule_id not in given or r.seq > given[r.rule_id].seq:
                given[r.rule_id] = r
        at, ruleset, hits, verdicts = self.held.get() or (None, None, [], [])
        hits, verdicts = {h[0]: tuple(h[1:]) for h in hits}, {v[0]: tuple(v[1:]) for v in verdicts}
        fresh = bool(uploads) and (at is None or max(uploads) > at)
        if fresh:
            at = max(uploads)
            ruleset = uploads[at][0].ruleset_id
            hits = merge_hits([h for r in uploads[at] for h in r.hits])
        changed = []
        for rule, r in given.items():
            if rule not in verdicts or r.seq >= verdicts[rule][0]:
                verdicts[rule] = (r.seq, r.verdict, r.confidence, r.note)
                changed.append(rule)
        out = []
        for rule in [] if at is None else sorted(verdicts) if fresh else changed:
            seq, verdict, confidence, note = verdicts[rule]
            if seq < at:
                del verdicts[rule]
                verdict = confidence = note = None
            hit = hits.get(rule, (None, None, None)) if verdict is not None else (None, None, None)
            out.append((seq, rule, verdict, confidence, note, *hit))
        if fresh or changed:
            self.held.update((at, ruleset, [(rule, *hit) for rule, hit in hits.items()], [(rule, *v) for rule, v in verdicts.items()]))
        for seq, rule, verdict, confidence, note, hit_verdict, source, reason in out:
            yield Row(
                case_id=key[0], seq=seq, rule_id=rule, ruleset_id=ruleset, upload=at, verdict=verdict, confidence=confidence, note=note,
                hit_verdict=hit_verdict, source=source, reason=reason,
            )

    def close(self) -> None:
        pass


def guarded_stream(dossiers: DataFrame, verdicts: DataFrame, rules: DataFrame, whole_percent: bool = True) -> DataFrame:
    """Stream of guard-checked verdicts (case_id, rule_id, ruleset_id, upload, seq, verdict, confidence, note, source, reason, action).

    ``dossiers (case_id, seq, ruleset_id, text[, directorate])`` and ``verdicts (case_id, seq, rule_id, verdict, confidence,
    note)`` are streams, ``rules`` is a table; ``seq`` orders what happens to a case. A row replaces those of its (case_id,
    rule_id) with a smaller (upload, seq); a null verdict tells that an upload voided it. :func:`current_verdicts` reads
    the state of things from what was written.
    """
    key = dossiers.schema["case_id"].dataType.simpleString()
    if "directorate" not in dossiers.columns:
        dossiers = dossiers.withColumn("directorate", F.lit(""))
    passed = PASSED.format(key=key)
    arriving = dossiers.select("case_id", F.col("seq").cast("long").alias("seq"), "ruleset_id", "text", "directorate")
    locked = arriving.groupBy("case_id").transformWithState(LockedRuleset(), passed, "Append", "None")
    book = guards.rule_book(guards.compile_rules(rules), rules)
    read = guards.book_arrays(book, locked, whole_percent, guards.fund_rules(rules))
    none = F.lit(None).cast("string")
    uploads = read.select("case_id", "seq", "ruleset_id", "hits", *[none.alias(c) for c in EVENT[4:]])
    given = verdicts.select(
        "case_id", F.col("seq").cast("long").alias("seq"), none.alias("ruleset_id"), F.lit(None).cast(guards.HIT).alias("hits"), *EVENT[4:]
    )
    met = uploads.unionByName(given).groupBy("case_id").transformWithState(LatestVerdicts(), GUARDED.format(key=key), "Append", "None")
    done = guards.apply_guard(guards.decided(met, rules, guards.hand_coverage(rules.sparkSession)))
    return done.drop("hit_verdict")


def verdict_stream(dossiers: DataFrame, verdicts: DataFrame, rules: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write :func:`guarded_stream` as Parquet under ``out``, exactly once per row."""
    writer = guarded_stream(dossiers, verdicts, rules).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def current_verdicts(written: DataFrame) -> DataFrame:
    """The last row of each (case, rule), without those that were voided."""
    last = Window.partitionBy("case_id", "rule_id").orderBy(F.desc("upload"), F.desc("seq"))
    return written.withColumn("_n", F.row_number().over(last)).filter((F.col("_n") == 1) & F.col("verdict").isNotNull()).drop("_n")
