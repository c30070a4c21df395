"""The pairs that queries meet in a shard are scored without a copy of both vectors for each pair."""

import tracemalloc

import numpy as np

from eviflow.llm import vptree


def test_a_shard_holds_no_vectors_of_pairs():
    draw = np.random.default_rng(5)
    points, queries = draw.normal(size=(2048, 64)), draw.normal(size=(3000, 64))
    points[7] = points[3]
    tracemalloc.start()
    found = vptree.shard_search(np.arange(2048), points, np.arange(5000, 8000), queries, 5, 1.0)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 150, f"{most:.0f} MB"
    assert len(found) == 3000 * 5
    scores = queries @ points.T
    for query, rows in found[found["query_id"] % 100 == 0].groupby("query_id"):
        own = scores[query - 5000]
        assert rows["vec_id"].tolist() == sorted(range(2048), key=lambda i: (-round(own[i], 9), i))[:5]
