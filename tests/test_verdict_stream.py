import random

from conftest import rows
from pyspark.sql import Row

from eviflow.operators import guards as gd
from eviflow.streaming.verdicts import LatestVerdicts, current_verdicts, verdict_stream

RULES = "ruleset_id string, rule_id string, type string, title string, quote string"
DOSSIER = "case_id long, seq long, ruleset_id string, text string, directorate string"
VERDICT = "case_id long, seq long, rule_id string, verdict string, confidence string, note string"


def rules(frame):
    return frame(
        RULES,
        ("F", "A1", "quantitative", "t", "Projects need a total requested budget of at least $200,000"),
        ("F", "A2", "qualitative", "t", "The requested budget may not exceed $300,000"),
        ("F", "A3", "quantitative", "t", "No annual turnovers are permitted in the form"),
        ("F", "A4", "quantitative", "t", "The plan must reach a minimum of $150,000"),
        ("G", "A1", "quantitative", "t", "Projects need a total requested budget of at least $900,000"),
        ("nsf-22-586", "R11", "quantitative", "t", "budget floor"),
        ("nsf-22-586", "R05", "quantitative", "t", "no tenure"),
    )


def text(budget, turnover=False):
    return f"The total requested budget is ${budget:,} over two years." + (" The annual turnover was $5,000,000." if turnover else "")


def batches(seed):
    """Arriving batches of (dossiers, verdicts) and what a batch job sees in the end."""
    rng = random.Random(seed)
    of_set = {"F": ["A1", "A2", "A3", "A4"], "G": ["A1"], "nsf-22-586": ["R11", "R05"]}
    out, locked, latest, verdicts, seq = [], {}, {}, {}, 0
    for _ in range(3):
        dossiers, given = [], []
        for case in rng.sample(range(12), 7):
            if case not in locked or rng.random() < 0.5:
                seq += 1
                named = rng.choice(list(of_set))
                locked.setdefault(case, named)
                latest[case] = (seq, text(rng.choice([100_000, 250_000, 400_000, 950_000]), rng.random() < 0.4), rng.choice(["BIO", None]))
                dossiers.append((case, seq, named, *latest[case][1:]))
                verdicts[case] = {}
            for rule in of_set[locked[case]]:
                if rng.random() < 0.7:
                    seq += 1
                    verdicts[case][rule] = (rng.choice(["met", "met", "unclear"]), "medium", "n")
                    given.append((case, seq, rule, *verdicts[case][rule]))
        out.append((dossiers, given))
    return out, locked, latest, verdicts


def test_arriving_batches_equal_the_batch_job(spark, frame, tmp_path):
    arriving, locked, latest, verdicts = batches(1)
    for k, (dossiers, given) in enumerate(arriving):
        frame(DOSSIER, *dossiers).coalesce(1).write.parquet(f"{tmp_path}/dossiers/batch={k}")
        frame(VERDICT, *given).coalesce(1).write.parquet(f"{tmp_path}/verdicts/batch={k}")
        # Each batch arrives after the one before is done; the stream starts again from its checkpoint.
        read = lambda name, schema: spark.readStream.schema(f"{schema}, batch int").parquet(f"{tmp_path}/{name}")
        verdict_stream(read("dossiers", DOSSIER), read("verdicts", VERDICT), rules(frame), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    cases = frame("case_id long, ruleset_id string, text string, directorate string", *[(c, locked[c], *latest[c][1:]) for c in latest])
    sheet = frame("case_id long, rule_id string, ruleset_id string, verdict string, confidence string, note string", *[(c, r, locked[c], *v) for c, of in verdicts.items() for r, v in of.items()])
    columns = ["case_id", "rule_id", "ruleset_id", "verdict", "confidence", "note", "source", "reason", "action"]
    want = rows(gd.guard_verdicts(sheet, cases, rules(frame)), *columns)
    found = rows(current_verdicts(spark.read.parquet(f"{tmp_path}/out")), *columns)
    assert found == want
    assert {r[-1] for r in found} >= {"override", "confirm", None} and {r[-3] for r in found} >= {"hand", "compiler", None}


class CountedValue:
    """A value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value


def test_a_case_costs_two_state_calls_however_many_rules(spark):
    value = CountedValue()
    handle = type("Handle", (), {"getValueState": lambda self, *_: value})()
    state = LatestVerdicts()
    state.init(handle)
    hits = [{"rule_id": "R1", "layer": gd.COMPILED, "ord": 0, "verdict": "not_met", "reason": "r"}]
    nothing = dict(case_id=1, rule_id=None, ruleset_id="F", verdict=None, confidence=None, note=None)
    verdict = lambda k, seq: Row(**nothing | {"seq": seq, "hits": None, "rule_id": f"R{k}", "verdict": "met"})
    first = list(state.handleInputRows((1,), iter([Row(**nothing, seq=1, hits=hits), *[verdict(k, 2 + k) for k in range(30)]]), None))
    assert len(first) == 30 and {r.rule_id for r in first if r.hit_verdict} == {"R1"} and value.calls == 2
    again = list(state.handleInputRows((1,), iter([verdict(1, 40), verdict(2, 1), Row(**nothing, seq=35, hits=[])]), None))
    assert value.calls == 4 and len(again) == 30
    assert [(r.rule_id, r.seq, r.hit_verdict) for r in again if r.verdict] == [("R1", 40, None)]
    assert list(state.handleInputRows((1,), iter([verdict(2, 50)]), None))[0].seq == 50 and value.calls == 6
