"""The multi-index against brute force; traversal order; odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from tramwise.llm import neighbours


def brute(rows, every, k):
    found = {}
    for q, v in rows:
        if q % every == 0:
            scored = sorted((-(np.array(v) * np.array(w)).sum(), i) for i, w in rows if i != q)
            found[q] = [(i, -s) for s, i in scored[:k]]
    return found


def ranked(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_recall(small):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in small("embeddings").collect()]
    expected, found = brute(rows, 20, 20), ranked(neighbours.nearest(small("embeddings")))
    assert found.keys() == expected.keys()
    hits = [len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) / 20 for q in found]
    assert np.mean(hits) >= 0.9
    score = {q: {i: float((np.array(v) * np.array(w)).sum()) for i, w in rows} for q, v in rows if q % 20 == 0}
    for q, own in found.items():
        assert all(abs(s - score[q][i]) < 1e-12 for i, s in own)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_whole_search_is_exact_in_any_blocks(small):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in small("embeddings").collect()]
    how = neighbours.MultiIndex(centroids=5, share=1.0, queries=3, vectors=40)
    found = ranked(neighbours.nearest(small("embeddings"), k=7, how=how))
    expected = brute(rows, 20, 7)
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in expected.items()}


def test_traverse_visits_the_best_cells():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.random(7), rng.random(5)
        counts = rng.integers(0, 4, (7, 5))
        wanted = rng.integers(1, 30)
        visited = neighbours.traverse(a, b, counts, wanted)
        order = np.argsort(-(a[:, None] + b[None]).ravel(), kind="stable")
        held = np.cumsum(counts.ravel()[order])
        last = np.searchsorted(held, wanted)
        expected = np.zeros(35, bool)
        expected[order[: last + 1]] = True
        assert (visited.ravel() == (expected & (counts.ravel() > 0))).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]),
        (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
        (9, [1.0]), (10, []), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (40, None),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    found = ranked(neighbours.nearest(table))
    assert found == {
        0: [(1, 1.0), (2, 1.0), (3, 0.5), (20, 0.0)],
        20: [(3, 0.5), (0, 0.0), (1, 0.0), (2, 0.0)],
    }
    assert neighbours.nearest(table.where("false")).count() == 0
    assert neighbours.nearest(table.where("vec_id = 0")).count() == 0
    assert neighbours.nearest(table.where("vec_id in (1, 2)")).count() == 0
