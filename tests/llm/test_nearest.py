import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarlake.llm import nearest as N

SCHEMA = "vec_id long, embedding array<double>, key string, vec int, id int, no string, pivot string, n int"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, v, None, 1, None, "x", None, 2) for i, v in pairs], SCHEMA)


def brute(pairs, k, chosen):
    held = {}
    for i, v in pairs:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            held[i, tuple(v)] = v
    out = {}
    for i, v in held:
        if chosen(i):
            found = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for j, w in held if j != i and len(w) == len(v))
            out[i, v] = [(j, -s) for s, j in found[:k]]
    return out


def got(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_small_tables_are_exact_with_ties_copies_and_bad_vectors(spark):
    r = np.random.default_rng(5)
    pairs = [(i, [float(x) for x in r.integers(-3, 4, 4)]) for i in range(60)]
    pairs += [(100 + i, [1.0, 2.0, 0.0, -1.0]) for i in range(30)]  # more copies than a query needs
    pairs += [(200, None), (201, []), (202, [0.0, -0.0, 0.0, 0.0]), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan"), 1.0, 0.0, 0.0]), (205, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    pairs += [(3, pairs[3][1])] * 2 + [(300, [1.0, 2.0]), (305, [2.0, 2.0])]
    found = got(N.nearest_neighbours(rows_of(spark, pairs), lambda i: i % 5 == 0, 7))
    want = {i: w for (i, _), w in brute(pairs, 7, lambda i: i % 5 == 0).items()}
    assert {i: [(j, s) for _, j, s in rows] for i, rows in found.items()} == {i: w for i, w in want.items() if w}
    assert all([r for r, _, _ in rows] == list(range(1, len(rows) + 1)) for rows in found.values())


def test_empty_and_single(spark):
    assert N.nearest_neighbours(rows_of(spark, []), lambda i: i % 20 == 0).count() == 0
    assert N.nearest_neighbours(rows_of(spark, [(0, [1.0])]), lambda i: i % 20 == 0).count() == 0
    assert N.nearest_neighbours(rows_of(spark, [(1, [1.0]), (2, [2.0])]), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("norms", [False, True])
def test_recall_and_cut_files(spark, monkeypatch, norms):
    r = np.random.default_rng(11)
    vec = r.normal(size=(3000, 24))
    vec = vec * r.lognormal(0, 0.3, (3000, 1)) if norms else vec / np.linalg.norm(vec, axis=1, keepdims=True)
    vec[1000:1400] = vec[7] + r.normal(size=(400, 24)) * 0.01  # a crowd that fills files
    monkeypatch.setattr(N, "FILE_BLOCK", 100)
    monkeypatch.setattr(N, "QUERY_BLOCK", 40)
    frame = rows_of(spark, [(i, [float(x) for x in v]) for i, v in enumerate(vec)])
    found = got(N.nearest_neighbours(frame, lambda i: i % 20 == 0))
    hits = 0
    for i in range(0, 3000, 20):
        s = vec @ vec[i]
        s[i] = -np.inf
        hits += len({j for _, j, _ in found[i]} & set(np.argsort(-s)[:20].tolist()))
        assert len(found[i]) == 20 and all(math.isclose(x, s[j]) for _, j, x in found[i])
    assert hits / (150 * 20) >= 0.9


def test_the_order_of_pivots_decides_what_is_reranked(spark, monkeypatch):
    """Without the share that footrule distance lets through, and without files to visit, neighbours are lost."""
    r = np.random.default_rng(3)
    frame = rows_of(spark, [(i, [float(x) for x in r.normal(size=16)]) for i in range(2000)]).where("embedding IS NOT NULL").persist()
    whole = got(N.nearest_neighbours(frame, lambda i: i % 100 == 0))
    monkeypatch.setattr(N, "SHARE", 0.02)
    monkeypatch.setattr(N, "LEAST", 2)
    monkeypatch.setattr(N, "PROBED", 3)
    less = got(N.nearest_neighbours(frame.where(F.lit(True)), lambda i: i % 100 == 0))
    lost = sum(len({j for _, j, _ in whole[i]} - {j for _, j, _ in less.get(i, [])}) for i in whole)
    assert lost > 20


def test_a_query_that_finds_too_few_visits_all_files(spark, monkeypatch):
    monkeypatch.setattr(N, "PROBED", 1)
    monkeypatch.setattr(N, "POSTED", 1)
    r = np.random.default_rng(8)
    pairs = [(i, [float(x) for x in r.normal(size=6)]) for i in range(300)]
    found = got(N.nearest_neighbours(rows_of(spark, pairs), lambda i: i % 50 == 0))
    assert all(len(rows) == 20 for rows in found.values()) and len(found) == 6


def test_footrule_of_two_orders():
    a, b = np.array([[3, 1, 0]]), np.array([[1, 3, 4]])
    place = lambda order, p: order.index(p) if p in order else 3
    foot = sum(abs(place([3, 1, 0], p) - place([1, 3, 4], p)) for p in range(5))
    agree = np.minimum(N._weights(a, 5), N._weights(b, 5)).sum()
    assert foot == 2 * (3 + 2 + 1) - 2 * agree
