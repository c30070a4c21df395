"""Near copies at scale: what meets by chance or in a crowd is not sent as sets, and keys are shuffled part by part."""

import numpy as np
import pytest

from eviflow.llm import jaccard
from eviflow.llm.components import local_components


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_wide_parities_tell_large_sets_apart():
    draw = np.random.default_rng(3)
    for n, m in ((2000, 2100), (300, 700), (1, 5), (0, 0)):
        a, b = (np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64)) for size in (n, m))
        x, y = jaccard.wide_parity(a), jaccard.wide_parity(b)
        apart = len(np.setxor1d(a, b))
        assert jaccard.wide_differ(x, y) == jaccard.wide_differ(y, x) <= apart  # never more than the shingles of one set only
        assert jaccard.wide_differ(x, x) == 0
    a, b = (np.unique(draw.integers(0, 1 << 63, 2000, dtype=np.uint64)) for _ in range(2))
    assert 9 * jaccard.wide_differ(jaccard.wide_parity(a), jaccard.wide_parity(b)) > len(a) + len(b)


def test_large_texts_that_meet_in_a_passage_are_not_compared(spark, folder):
    draw = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} " + " ".join(f"w{x}" for x in draw.integers(0, 1 << 30, 1500)) for _ in range(12)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    found = jaccard.near_copies(rows, folder).collect()
    assert sorted(map(tuple, found)) == [(i, i) for i in range(12)]
    assert sum(spark.read.parquet(f"{folder}/pairs-{k}").count() for k in (1, 2)) == 0


def test_a_crowd_is_linked_by_more_rounds_before_pairs_are_made(spark, folder):
    draw = np.random.default_rng(6)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(w if draw.random() > 0.02 else f"x{draw.integers(1 << 30)}" for w in base) for _ in range(160)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    found = dict(map(tuple, jaccard.near_copies(rows, folder).collect()))
    sets = [set(jaccard.shingles(t.encode()).tolist()) for t in texts]
    near = [(i, j) for i in range(160) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = local_components(160, *(np.array(x) for x in zip(*near, strict=True)))
    assert [found[i] for i in range(160)] == [min(j for j in range(160) if label[j] == label[i]) for i in range(160)]
    assert spark.read.parquet(f"{folder}/left-2").first()[0] > 160  # so there was a round more
    assert spark.read.parquet(f"{folder}/links-3").count() < len(near) / 10
