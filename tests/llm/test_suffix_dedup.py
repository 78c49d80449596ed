import random

import numpy as np
import pytest

from scholarlake.llm import suffix_dedup as S
from scholarlake.llm.suffix_dedup import WINDOW, remove_repeats, runs_of


def brute(rows):
    """(id, text) in position order -> n_bytes, spans, kept."""
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        cut = bytearray(len(b))
        for p in range(len(b) - WINDOW + 1):
            w = b[p : p + WINDOW]
            if w in seen:
                cut[p : p + WINDOW] = b"\1" * WINDOW
            seen.add(w)
        spans = [p for p in range(len(b)) if cut[p] and (p == 0 or not cut[p - 1])]
        out.append((doc_id, len(b), sum(cut), len(spans), bytes(c for c, k in zip(b, cut, strict=True) if not k)))
    return out


def random_text(r, n):
    return "".join(r.choice("abcdefghij klmnop\n") for _ in range(n))


def cases():
    r = random.Random(5)
    a, b, c = random_text(r, 400), random_text(r, 150), random_text(r, 99)
    return [
        (1, a),
        (2, "x" + a + "y"),
        (3, b + random_text(r, 50) + a[100:260] + b),
        (4, c), (5, c),
        (6, a[:WINDOW]), (7, a[:WINDOW - 1]),
        (8, None), (9, ""),
        (10, "z" * 700), (11, "z" * 130 + "q" + "z" * 99),
        (12, "ab" * 300), (13, "é" * 90 + a[50:170]),
        (14, a[:200] + "!" + a[201:]), (15, a[:200] + "?" + a[201:]),
        (16, random_text(r, 3000) + a[7:107]), (-5, a[20:140]),
    ]


def got_of(docs):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect())


def test_equals_brute_force(frame):
    rows = cases()
    assert got_of(frame(rows)) == sorted(brute(sorted(rows)))


@pytest.mark.parametrize("salted", [True, False])
def test_hot_anchors_and_long_texts(frame, monkeypatch, salted):
    r = random.Random(8)
    passage = random_text(r, 260)
    rows = [(i, random_text(r, 120) + passage + random_text(r, 80)) for i in range(60)] + [(100, random_text(r, 1_200_000) + passage)]
    if salted:
        grams = S.ranks_of(np.frombuffer(passage.encode(), np.uint8), S.GRAM).view(np.int64).tolist()
        monkeypatch.setattr(S, "_hot_anchors", lambda keyed: grams)
    assert got_of(frame(rows)) == sorted(brute(rows))


def test_repeated_ids(frame):
    r = random.Random(3)
    a = random_text(r, 300)
    same = [(1, a), (1, a), (2, a + "tail"), (None, a[:150])]
    got = got_of(frame(same[:3]))
    assert [g[1:4] for g in got] == [(300, 0, 0), (300, 0, 0), (304, 300, 1)]
    by_id = {g.doc_id: g for g in remove_repeats(frame(same)).collect()}
    assert by_id[None].n_removed == 0 and by_id[1].n_removed == 150


def test_empty_and_one_row(frame):
    assert remove_repeats(frame([])).collect() == []
    assert got_of(frame([(1, "short")])) == [(1, 5, 0, 0, b"short")]


def test_runs_cover_each_window_once():
    raw = np.frombuffer(random_text(random.Random(1), 5000).encode() + b"w" * 600, np.uint8)
    begins, ends = np.array([0, 2000, 2050]), np.array([2000, 2050, 5600])
    first, more, place, _, _ = runs_of(raw, begins, ends)
    windows = np.concatenate([np.arange(s, s + m + 1) for s, m in zip(first, more, strict=True)])
    want = np.concatenate([np.arange(a, b - WINDOW + 1) for a, b in zip(begins, ends, strict=True) if b - a >= WINDOW])
    assert sorted(windows.tolist()) == want.tolist()
    assert (place >= more).all() and (place < S.ANCHORS).all()
