import math
import random

import numpy as np
import pytest

from lectern.llm import topk as K


def brute(rows, k, every):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(seed=1, n=500, d=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, d)) / math.sqrt(d)
    rows = [(i, [float(x) for x in np.float32(centers[i % 5] + rng.normal(size=d) * 0.1)]) for i in range(n)]
    return rows + [(n, rows[0][1]), (n + 1, None), (n + 2, [None] * d), (n + 3, [float("nan")] * d), (n + 4, [float("inf")] * d), (n + 20, [0.0] * d), (n + 40, [1.0, 2.0]), (n + 41, [1.0]), (None, rows[1][1]), (n + 60, [])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize(("k", "every", "portion", "block"), [(20, 20, 1 << 14, 1 << 13), (3, 5, 64, 16), (7, 1, 128, 1 << 13)])
def test_matches_brute_force(spark, monkeypatch, k, every, portion, block):
    monkeypatch.setattr(K, "PORTION", portion)
    monkeypatch.setattr(K, "BLOCK", block)
    rows = vectors()
    got = sorted(tuple(r) for r in K.top_k(frame(spark, rows), k, every).collect())
    assert got == brute(rows, k, every)


def test_stops_only_on_proof():
    rng = np.random.default_rng(3)
    v = np.floor(64 * rng.normal(size=(4000, 32)) * np.exp(rng.normal(size=32))).astype(np.int64)
    ids = np.arange(4000)
    queries = v[::100]
    limits = K.thresholds(ids[::100], queries, np.arange(len(queries)), 5)
    index = K.Index(ids, v)
    for i, found, scores in index.search(ids[::100], queries, limits, 5):
        exact = v @ v[i]
        order = [j for j in np.lexsort((ids, -exact)) if j != i and exact[j] >= limits[i // 100]][:5]
        assert found.tolist() == order and scores.tolist() == exact[order].tolist()
    assert len(index.segments) == len(K.SEGMENTS) and sum(len(at) for postings, _, _ in index.segments for at, _ in postings) == np.count_nonzero(v)


def test_edges(spark):
    assert K.top_k(frame(spark, [])).count() == 0
    assert K.top_k(frame(spark, [(0, [1.0])])).count() == 0
    rng = random.Random(1)
    rows = [(0, [0.5, 0.5]), (0, [0.5, 0.5]), *((i, [rng.choice([0.25, 0.5]), 0.25]) for i in range(1, 9))]
    got = K.top_k(frame(spark, rows).selectExpr("*", "1 as v", "2 as rank", "3 as score")).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 9)) and all(a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id) for a, b in zip(got, got[1:]))


def test_segments_hold_postings_by_impact():
    rng = np.random.default_rng(4)
    v = rng.integers(-9, 10, (300, 8))
    index = K.Index(np.arange(300), v)
    seen = np.zeros_like(v)
    for postings, most, left in index.segments:
        for j, (at, impact) in enumerate(postings):
            assert (seen[at, j] == 0).all() and (v[at, j] == impact).all()
            seen[at, j] = impact
        rest = v - seen
        assert np.abs(rest).max() <= most and np.allclose(left, np.sqrt((rest**2).sum(axis=1)))
    assert (seen == v).all()


def test_searches_stop_before_the_last_segment():
    """Vectors with a few large components: the first segments prove most of them out."""
    rng = np.random.default_rng(5)
    v = np.floor(64 * rng.normal(size=(3000, 32)) ** 5).astype(np.int64)
    limits = K.thresholds(np.arange(3000), v, np.arange(100), 5)
    index = K.Index(np.arange(3000), v)
    index.segments = index.segments[:2]  # the rest isn't needed by most

    exact, few = index._exact, []
    index._exact = lambda *a: few.append(len(a[3])) or exact(*a)
    list(index.search(np.arange(100), v[:100], limits, 5))
    assert np.median(few) <= 3000 * K.FEW
