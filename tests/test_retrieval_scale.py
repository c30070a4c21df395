"""Retrieval against brute force; what it deals by rule, and how much a task of a shuffle takes."""

import math
import re
from collections import Counter, defaultdict

import pytest

from eviflow.operators import retrieval as rt
from eviflow.plans import registry

CHUNKS = [
    ("a", 0, "Wine sales rise and wine sells"), ("a", 1, "wine is red"), ("a", 2, None), ("a", 3, "the red barn"), ("a", 3, "barn sales"),
    ("b", 0, "red wine"), ("b", 1, "nothing here"), ("c", 0, "wine"), (None, 0, "wine sales"), ("d", 5, "?"),
]
SETS = [("a", "s"), ("a", "z"), ("b", "z"), ("d", "s"), ("e", "s")]
RULES = [("s", "r1", "Wine", "wine sales"), ("s", "r2", None, "red barn"), ("z", "r3", "Red", "red red wine"), ("z", "r4", "nil", None)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def words_of(text):
    tokens = re.findall(r"\b\w\w+\b", (text or "").lower())
    return Counter(tokens + [f"{x} {y}" for x, y in zip(tokens, tokens[1:], strict=False)])


def brute(k):
    tf, n = defaultdict(Counter), Counter()
    for case, chunk, text in CHUNKS:
        tf[case, chunk].update(words_of(text))
        n[case] += 1
    df = Counter((case, term) for (case, _), terms in tf.items() for term in terms)
    found = []
    for case, ruleset in SETS:
        for of, rule, title, quote in RULES:
            if of != ruleset:
                continue
            idf = {t: math.log((1 + n[case]) / (1 + d)) + 1 for (c, t), d in df.items() if c == case}
            asked = {t: (1 + math.log(m)) * idf[t] for t, m in words_of(f"{title or ''} — {quote or ''}").items() if t in idf}
            scores = []
            for (c, chunk), terms in tf.items():
                if c == case:
                    w = {t: (1 + math.log(m)) * idf[t] for t, m in terms.items()}
                    dot = sum(asked[t] * w[t] for t in asked if t in w)
                    scores.append((-round(dot / math.sqrt(sum(x * x for x in w.values()) * sum(x * x for x in asked.values())), 10) if dot else 0.0, chunk))
            found += [(case, rule, chunk, i, round(-s, 4)) for i, (s, chunk) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("k", [1, 3, 9])
def test_retrieval_is_brute_force(frame, k):
    chunks = frame("case_id string, chunk_id int, text string", *CHUNKS)
    rules = frame("ruleset_id string, rule_id string, title string, quote string", *RULES)
    got = rt.retrieve(chunks, frame("case_id string, ruleset_id string", *SETS), rules, k)
    want = brute(k)
    if k > 3:  # chunks without a shared term come from the first k only
        assert len(want) > 9
    assert [(c, r, h, i, round(s, 4) + 0.0) for c, r, h, i, s in sorted(tuple(r) for r in got.collect())] == want


def test_terms_are_summed_before_they_are_dealt_by_rule(frame):
    chunks = frame("case_id string, chunk_id int, text string", *CHUNKS)
    rules = frame("ruleset_id string, rule_id string, title string, quote string", *RULES)
    plan = plan_of(rt.retrieve(chunks, frame("case_id string, ruleset_id string", *SETS), rules, 3))
    assert len(re.findall(r"hashpartitioning\(case_id#\w+, rule_id#", plan)) == 1


def test_tasks_of_shuffles_are_bounded_unless_the_session_says_so(spark):
    key, most = registry.TASK_BYTES
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        assert registry.bounded(spark).conf.get(key) == most
        spark.conf.set(key, "16k")
        assert registry.bounded(spark).conf.get(key) == "16k"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
