import random

import numpy as np

from scholarlake.llm import quality as Q
from tests.llm.conftest import prose


def good(i):
    return ". ".join(s.capitalize() for s in (prose(i, 12), prose(i + 1, 9))) + "."


def bad(i):
    r = random.Random(i)
    return " ".join(w + r.choice(["***", "&&&", "!!"]) for w in prose(i, 25).upper().split())


ROWS = [(i, good(i) if i % 3 else bad(i)) for i in range(300)]


def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(7, 1, 0), (None, 1, 0), (9, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, frame):
    docs = frame(ROWS)
    ranker = Q.train(docs, Q.learned_from(labels(spark)))
    got = {r.doc_id: r.score for r in Q.score_quality(docs, ranker).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    import zlib

    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and sum((got[i] >= Q.DECISION) == (i % 3 > 0) for i in held) / len(held) > 0.95


def test_filter_takes_effect_and_keeps_columns(spark, frame):
    docs = frame([*ROWS, (900, None), (901, ""), (None, good(5)), (902, good(3) * 2000), (7, good(7))])
    ranker = Q.train(docs, Q.learned_from(labels(spark)))
    out = Q.quality_filter(docs, ranker)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    scores = [(r.doc_id, r.score) for r in Q.score_quality(docs, ranker).collect()]
    assert len(scores) == 305 and sorted(map(str, kept)) == sorted(str(d) for d, s in scores if s >= Q.DECISION)
    assert None in kept and kept.count(7) == 2 and 902 in kept


def test_without_labels(spark, frame):
    docs, none = frame(ROWS[:5]), labels(spark).limit(0)
    assert Q.train(docs, none) is None and Q.train(frame([]), labels(spark)) is None
    assert {r.score for r in Q.score_quality(docs, None).collect()} == {0.5}
    assert Q.quality_filter(docs, None).count() == 5
    assert Q.score_quality(frame([]), None).collect() == []


def test_pairs_learn_the_order():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 5))
    y = (x @ np.array([2.0, -1, 0, 0, 0]) + 0.1 * rng.standard_normal(400) > 0).astype(int)
    r = Q.fit(x, y, max_pairs=20_000)
    s = r.score(x)
    assert ((s >= Q.DECISION) == (y == 1)).mean() > 0.97
    assert Q.fit(x, np.ones(400, int)) is None


def test_fit_equals_a_plain_gradient_loop():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 4)) * [1, 2, 0.5, 3] + [0, 5, 0, -2]
    y = (x @ np.array([1.5, -0.7, 0, 0.2]) + rng.standard_normal(120) > np.median(x @ np.array([1.5, -0.7, 0, 0.2]))).astype(int)
    r = Q.fit(x, y, max_pairs=3_000, l2=0.01, rounds=50)
    z = [[max(-Q.REACH, min(Q.REACH, (v - m) / (s + 1e-3))) for v, m, s in zip(row, x.mean(0), x.std(0), strict=True)] for row in x]
    draw = np.random.default_rng(7)
    a, b = draw.choice(np.flatnonzero(y == 1), 3_000), draw.choice(np.flatnonzero(y == 0), 3_000)
    d, w = np.array(z)[a] - np.array(z)[b], np.zeros(4)
    for _ in range(4_000):
        w -= 0.2 * (0.01 * w - (d * (1 - 1 / (1 + np.exp(-d @ w)))[:, None]).mean(0))
    assert np.allclose(r.weights, w, atol=1e-3)
    assert ((r.score(x) >= Q.DECISION).sum()) == (y == 1).sum()  # the quantile at the share of bad rows
    third = Q.fit(x, y, max_pairs=3_000, quantile=1 / 3)
    assert (third.score(x) >= Q.DECISION).sum() == 80


def test_distinct_long_prose_is_judged_like_short(spark, frame):
    rows = [*ROWS, *((1000 + i, " ".join(good(7 * i + j) for j in range(500))) for i in range(5)), *((2000 + i, " ".join(bad(7 * i + j) for j in range(500))) for i in range(5))]
    docs = frame(rows)
    got = {r.doc_id: r.score for r in Q.score_quality(docs, Q.train(docs, Q.learned_from(labels(spark)))).collect()}
    assert all(got[1000 + i] >= Q.DECISION > got[2000 + i] for i in range(5))


def test_repeated_ids_are_learned_from_once(spark, frame):
    docs, again = frame(ROWS), frame([*ROWS, *ROWS, *ROWS[:40]])
    one, other = (Q.train(d, Q.learned_from(labels(spark)), max_labelled=100) for d in (docs, again))
    assert np.allclose(one.weights, other.weights) and one.cut == other.cut
