import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholarlake.llm import hmm as H
from tests.llm.conftest import prose

ROWS = [(i, prose(i % 7, 30 + 40 * (i % 3))) for i in range(60)] + [(100, None), (101, ""), (102, "A a\x0bB\x1cc  É"), (103, prose(200, 20_000)), (104, "zz " * 30), (104, "zz " * 30), (None, "null id words")]


def brute(rows):
    train = [x for x in rows if x[0] is None or zlib.crc32(str(x[0]).encode()) % 7 != 2]
    words = lambda t: (t or "").encode().lower().split()
    c = Counter(w for _, t in train for w in words(t))
    total, distinct, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    log = lambda n: math.log10((n + 1) / (total + distinct + 1))
    return c, total, [(d, len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + 1, sum(log(c[w]) for w in words(t)) + log(ends)) for d, t in rows]


@pytest.mark.parametrize("dictionary", [1 << 18, 5])
def test_counts_and_base_scores(frame, monkeypatch, dictionary):
    monkeypatch.setattr(H.count_words, "__defaults__", (dictionary, 3))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in H.score_texts(frame(ROWS), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 2, rounds=1).collect()), key=str)
    assert got == sorted(((d, n, k, round(s, 6)) for d, n, k, s in brute(ROWS)[2]), key=str)


def test_buckets_follow_the_words(spark):
    words = [b"a", b"ab", b"abc", b"abcd", "é".encode(), "日本".encode()]
    rows = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select((F.crc32(F.expr("substring(word, -3, 3)")) % H.BUCKETS).alias("b")).collect()
    assert [r.b for r in rows] == [H.bucket_of(w) for w in words]


def model(states=3, classes=5, seed=1):
    r = np.random.default_rng(seed)
    p = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(r.random(s) + 0.1)
    return H.Hmm(p(states), p(states, states), p(states, classes).T)


def test_forward_is_exact():
    m = model()
    for ids in ([0], [1, 4], [2, 2, 3, 0, 1]):
        want = 0.0
        for path in itertools.product(range(3), repeat=len(ids)):
            x = m.start[path[0]] * m.emit[ids[0], path[0]]
            for a, b, i in zip(path, path[1:], ids[1:], strict=False):
                x *= m.move[a, b] * m.emit[i, b]
            want += x
        assert math.isclose(H.log10_likelihood(m, np.array(ids), np.array([0]), np.array([len(ids)]))[0], math.log10(want))
    flat = np.random.default_rng(0).integers(0, 5, 500)
    begins, sizes = np.array([0, 10, 11, 300]), np.array([10, 1, 289, 200])
    both = H.log10_likelihood(m, flat, begins, sizes)
    assert np.allclose(both, [H.log10_likelihood(m, flat, np.array([b]), np.array([n]))[0] for b, n in zip(begins, sizes, strict=True)])


def test_expected_counts_equal_enumeration():
    m, ids = model(), [2, 0, 3, 3]
    emitted, starts, moves = np.zeros((5, 3)), np.zeros(3), np.zeros((3, 3))
    total = 0.0
    for path in itertools.product(range(3), repeat=4):
        x = m.start[path[0]] * m.emit[ids[0], path[0]]
        for a, b, i in zip(path, path[1:], ids[1:], strict=False):
            x *= m.move[a, b] * m.emit[i, b]
        total += x
        starts[path[0]] += x
        for t, s in enumerate(path):
            emitted[ids[t], s] += x
        for a, b in itertools.pairwise(path):
            moves[a, b] += x
    got = np.zeros((5, 3))
    s, v = H.expected_counts(m, np.array(ids), np.array([0]), np.array([4]), got)
    assert np.allclose(got, emitted / total, atol=1e-5) and np.allclose(s, starts / total, atol=1e-5) and np.allclose(v, moves / total, atol=1e-5)


def test_model_is_a_distribution_and_beats_the_base(frame):
    rows = [(i, " ".join(np.random.default_rng(i).choice([f"{'ab'[i % 2]}{k}" for k in range(30)], 80))) for i in range(120)]
    got = H.score_texts(frame(rows), F.col("doc_id") % 7 == 2).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_emissions_sum_to_one(spark, frame):
    docs = frame(ROWS).select("doc_id", F.lit(False).alias("held_out"), "text")
    vocabulary, counts = H.count_words(docs)
    m = H.baum_welch(H.encode(docs, counts), counts.classes, 2, 2)
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.move.sum(1), 1) and math.isclose(m.start.sum(), 1)
    within = Counter()
    for i, r in enumerate(vocabulary.orderBy(F.desc("n"), "word").collect()):
        if i >= counts.top:
            within[H.bucket_of(bytes(r.word))] += (r.n + 1) / counts.bucket_total[H.bucket_of(bytes(r.word))]
    assert all(v < 1 for v in within.values())


def test_empty(frame):
    assert H.score_texts(frame([]), F.lit(False)).collect() == []
    only = H.score_texts(frame([(1, "all held out")]), F.lit(True)).first()
    assert (only.train_tokens, only.n_known, only.n_tokens) == (0, 0, 4)


def test_inner_segments_have_no_part_in_the_starts():
    m, ids = model(), np.array([2, 0, 3, 3, 1, 4])
    at = lambda *x: np.array(x)
    whole, inner = np.zeros((5, 3)), np.zeros((5, 3))
    starts, _ = H.expected_counts(m, ids, at(0, 3), at(3, 3), whole, at(True, False))
    alone, _ = H.expected_counts(m, ids, at(0), at(3), inner)
    assert np.allclose(starts, alone, atol=1e-5) and np.isclose(whole.sum(), 6, atol=1e-4)
    settled = H.Hmm(np.linalg.matrix_power(m.move, 256)[0], m.move, m.emit)
    H.expected_counts(settled, ids, at(3), at(3), inner)
    assert np.allclose(whole, inner, atol=1e-4)
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([[1] * (H.SEGMENT + 3), [2], [3] * (2 * H.SEGMENT)])})
    _, begins, sizes, opening = H._segments(batch)
    assert sizes.tolist() == [H.SEGMENT, 3, 1, H.SEGMENT, H.SEGMENT] and opening.tolist() == [True, False, True, True, False] and begins[2] == H.SEGMENT + 3


def test_counts_over_cuts_are_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(H, "SEGMENT", 16)
    monkeypatch.setattr(H, "BATCH_TOKENS", 50)
    r = np.random.default_rng(3)
    m = H.Hmm(model(4, 9).start, 0.9 * np.eye(4) + 0.1 * model(4, 9).move, model(4, 9).emit)
    listed = [r.integers(0, 9, n).tolist() for n in (1, 16, 17, 5, 160, 33, 7)]
    flat, begins, sizes, opening = H._segments(pa.RecordBatch.from_pydict({"ids": pa.array(listed, pa.list_(pa.int32()))}))
    enter, leave, moves = H.messages(m, flat, begins, sizes, opening)
    emitted, starts = np.zeros((9, 4)), np.zeros(4)
    for part in H._cut(sizes, 50):
        s, v = H.expected_counts(m, flat, begins[part], sizes[part], emitted, opening[part], enter[part], leave[part])
        starts, moves = starts + s, moves + v
    n = np.array([len(x) for x in listed])
    want = np.zeros((9, 4))
    s, v = H.expected_counts(m, flat, np.cumsum(n) - n, n, want)
    assert np.allclose(emitted, want, atol=1e-3) and np.allclose(starts, s, atol=1e-4) and np.allclose(moves, v, atol=1e-3)
    assert math.isclose(moves.sum(), n.sum() - len(n), rel_tol=1e-4)


def test_products_survive_unlikely_words():
    emit = np.full((3, 2), 1e-30)
    emit[0] = [1, 1e-12]
    m = H.Hmm(np.array([0.5, 0.5]), np.array([[0.999999, 1e-6], [1e-6, 0.999999]]), emit)
    out = H._products(m, np.array([0, 1, 2] * 700), np.array([0, 3]), np.array([3, 2_097]))
    assert np.isfinite(out).all() and np.allclose(out.sum((1, 2)), 1)


def test_joined_scores_equal_a_plain_forward_loop(spark, frame, monkeypatch):
    """score: the classes' forward recursion times the shares of pooled words in their classes, for a model taken as trained."""
    monkeypatch.setattr(H.count_words, "__defaults__", (6, 3))
    kept = {}
    train = H.baum_welch
    monkeypatch.setattr(H, "baum_welch", lambda coded, classes, states, rounds: kept.setdefault("m", train(coded, classes, states, rounds)))
    rows = [(i, prose(i % 5, 20 + i) + " often" * (3 + i % 2) + " seldom" * (i % 3) * 2 + " rarer" * (i % 4)) for i in range(30)] + [(50, "never seen words"), (51, ""), (52, None)]
    got = {r.doc_id: r.score for r in H.score_texts(frame(rows), F.col("doc_id") >= 50, 2, 2).collect()}
    m, words = kept["m"], lambda t: (t or "").encode().lower().split()
    c = Counter(w for d, t in rows if d < 50 for w in words(t))
    least = sorted(c.values(), reverse=True)
    least = next(v for v in sorted(set(least)) if sum(x >= v for x in c.values()) <= 6)
    top = [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n >= least][:3]
    total = Counter()
    for w, n in c.items():
        if w not in top:
            total[H.bucket_of(w)] += n + 1
    for doc_id, text in rows:
        a, out = m.start, 0.0
        for i, w in enumerate([*words(text), None]):
            k = len(top) + H.BUCKETS if w is None else top.index(w) if w in top else len(top) + H.bucket_of(w)
            a = (a @ m.move if i else a) * m.emit[k]
            out += math.log10(a.sum()) + (0 if w is None or w in top else math.log10((c[w] + 1) / (total[H.bucket_of(w)] + 1)))
            a = a / a.sum()
        assert math.isclose(got[doc_id], out, rel_tol=1e-9, abs_tol=1e-9)
