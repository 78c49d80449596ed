import random
from fractions import Fraction

import numpy as np
import pytest

from scholarlake.llm import jaccard_join as J
from scholarlake.llm.shingles import shingle_set, word_hashes
from tests.llm.conftest import prose


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, t):
    sets = [shingles(x, n) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= t:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)), key=str)


def edited(text, seed, edits):
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"edit{r.random()}"
    return " ".join(words)


def family(base, size, most, start):
    return [(start + i, edited(base, start + i, i % (most + 1))) for i in range(size)]


ROWS = (
    family(prose(1, 300), 40, 12, 100)
    + family(prose(2, 60), 20, 4, 200)
    + family(prose(3, 12), 8, 1, 300)
    + [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "one  TWO"), (8, "two one"), (9, "a b c"), (9, "a b c"), (None, "a b c"), (None, prose(2, 60)), (None, edited(prose(1, 300), 77, 1)), (None, edited(prose(77, 90), 1, 0)), (98, edited(prose(77, 90), 1, 1))]
    + [(400 + i, prose(50 + i, 200) + " " + prose(9, 100)) for i in range(6)]
    + [(500, prose(11, 30_000)), (501, edited(prose(11, 30_000), 1, 500)), (502, prose(11, 30_000) + " end")]
)


@pytest.mark.parametrize(("n", "t"), [(3, "0.9"), (5, "0.8"), (2, "0.5")])
def test_equals_brute_force(frame, n, t):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(frame(ROWS), n, t).collect()), key=str)
    assert got == brute(ROWS, n, Fraction(t))


@pytest.mark.parametrize("parts", [False, True])
def test_both_kinds_of_keys_give_the_same(frame, monkeypatch, parts):
    monkeypatch.setattr(J, "BLOCK_DOCS", 9)
    passage = prose(31, 60)
    rows = family(prose(4, 200), 30, 12, 1000) + [(2000 + i, prose(100 + i, 90) + " " + passage + " " + prose(500 + i // 2, 70)) for i in range(40)] + [(3000 + i, edited(prose(100 + i, 90) + " " + passage, i, 2)) for i in range(20)]
    for n, t in ((3, "0.9"), (5, "0.7"), (2, "0.45")):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(frame(rows), n, t, parts=parts).collect()), key=str)
        assert got == brute(rows, n, Fraction(t))


@pytest.mark.parametrize("common", [False, True])
def test_families_over_many_blocks(frame, monkeypatch, common):
    monkeypatch.setattr(J, "BLOCK_DOCS", 7)
    if common:  # most shingles of the families count as frequent
        monkeypatch.setattr(J, "frequent_shingles", lambda rows, n: np.union1d(shingle_set(prose(4, 200).encode(), n), shingle_set(prose(5, 40).encode(), n)))
    rows = family(prose(4, 200), 60, 25, 1000) + family(prose(5, 40), 30, 4, 2000)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(frame(rows), 3, "0.9").collect()), key=str)
    assert got == brute(rows, 3, Fraction("0.9"))


def test_linked_sets_share_a_key():
    r = np.random.default_rng(2)
    for words in (1, 2, 9, 10, 11, 25, 90, 400):
        base = prose(words, words)
        for edits in range(0, 6):
            a, b = shingle_set(base.encode(), 3), shingle_set(edited(base, edits, edits).encode(), 3)
            inter = len(set(a.tolist()) & set(b.tolist()))
            for t in ("0.9", "0.8", "0.5"):
                for share in (0, 0.3, 0.7, 1):  # whatever counts as frequent
                    frequent = np.unique(np.concatenate([a, b]))
                    frequent = frequent[r.random(len(frequent)) < share]
                    if Fraction(inter, len(a) + len(b) - inter) >= Fraction(t):
                        assert set(J.part_keys(a, Fraction(t), frequent).tolist()) & set(J.part_keys(b, Fraction(t), frequent).tolist())


@pytest.mark.parametrize("t", ["0.3", "0.5", "0.6", "0.65", "0.7", "0.8", "0.95"])
def test_subsets_share_a_key(t):
    r = np.random.default_rng(5)
    for n in (3, 10, 40, 137, 600):
        whole = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        for size in {n, -(-n * Fraction(t).numerator // Fraction(t).denominator), n - 1}:
            part = np.sort(r.permutation(whole)[:size])
            if size and Fraction(size, n) >= Fraction(t):
                frequent = whole[r.random(n) < 0.6]
                for keys, counts in ((J.part_keys, ()), (J.prefix_keys, ()), (J.prefix_keys, (r.integers(2, 9, len(frequent)),))):
                    assert np.intersect1d(keys(whole, Fraction(t), frequent, *counts), keys(part, Fraction(t), frequent, *counts)).size
                    assert np.intersect1d(keys(whole, Fraction(t), whole[:0]), keys(part, Fraction(t), whole[:0])).size


def test_products_of_blocks():
    r = np.random.default_rng(6)
    for m, k, low in ((5, 9, 4), (40, 30, 3), (70, 90, 60)):
        left, right = ([np.unique(np.concatenate([r.integers(0, 50, 20), r.integers(0, 5_000, low)])).astype(np.int64) for _ in range(n)] for n in (m, k))
        want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
        assert J.overlaps(left, right).tolist() == want
        own = J.overlaps(left)
        assert all(own[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(left) for j, b in enumerate(left) if i != j)
        links = J.block_links(np.arange(m + k), left + right, Fraction("0.4"), m)
        sure = {(i, m + j) for i in range(m) for j in range(k) if Fraction(want[i][j], len(left[i]) + len(right[j]) - want[i][j]) >= Fraction("0.4")}
        groups = lambda pairs: {frozenset(x) for x in _classes(m + k, pairs)}
        assert groups(links) == groups(sure)


def _classes(n, pairs):
    of = {i: {i} for i in range(n)}
    for a, b in pairs:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for x in of[a]:
                of[x] = of[a]
    return of.values()


def test_word_hashes_follow_the_definition():
    assert len(word_hashes(b"")) == len(word_hashes(b" \t\n\x0b\x0c\r")) == 0
    assert (word_hashes("É a b A".encode()) == word_hashes("É a b a".encode())).all() and len(word_hashes("É a b A".encode())) == 3
    long = (b"ab " * 400_000) + b"x" * 2_000_000
    assert len(set(word_hashes(long).tolist())) == 2


def test_near_dedup_keeps_least(frame):
    docs = frame(ROWS)
    out = J.near_dedup(docs)
    assert out.columns == docs.columns
    want = [(d, c) for d, _, c in brute(ROWS, 5, Fraction("0.8"))]
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((d for d, c in want if d is None or d == c), key=str)


def test_empty_table(frame):
    assert J.jaccard_components(frame([])).collect() == []
    assert J.near_dedup(frame([(1, None), (2, None)])).count() == 2


def test_sketches_never_deny_a_link():
    r = np.random.default_rng(8)
    for n in (1, 5, 63, 64, 65, 200, 1500):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        for gone, new in ((0, 0), (1, 0), (0, 1), (n // 9, n // 9), (n // 5, 0), (0, n // 4), (n // 2, n)):
            b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 1 << 63, new, dtype=np.uint64)]))
            inter, both = len(np.intersect1d(a, b)), len(a) + len(b)
            assert J.bits_apart(J.sketch(a), J.sketch(b)) <= both - 2 * inter
            for t in ("0.5", "0.8", "0.9"):
                if inter and Fraction(inter, both - inter) >= Fraction(t):
                    assert J.may_link(J.sketch(a), J.sketch(b), both, Fraction(t))
    a, b = (np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64)) for _ in range(2))
    assert not J.may_link(J.sketch(a), J.sketch(b), 800, Fraction("0.8"))


@pytest.mark.parametrize("paired", [1, 3, 32])
def test_ties_whatever_the_batches(monkeypatch, paired):
    monkeypatch.setattr(J, "PAIRED", paired)
    r = np.random.default_rng(9)
    t = Fraction("0.8")
    rows = sorted({(int(r.integers(0, 60)), int(2 * r.integers(20, 30) + r.integers(0, 2)), int(r.integers(0, 400))) for _ in range(300)})
    want = {frozenset((c, d)) for i, (k, size, c) in enumerate(rows) for k2, size2, d in rows[i + 1 :] if k == k2 and c != d and size & 1 == 0 and 5 * (size >> 1) >= 4 * (size2 >> 1)}
    for step in (1, 2, 7, 1000):
        parts = [rows[i : i + step] for i in range(0, len(rows), step)]
        batches = [J.pa.RecordBatch.from_pydict({"key": J.pa.array([x[0] for x in p], J.pa.int64()), "salt": J.pa.array([-1] * len(p), J.pa.int32()), "size": J.pa.array([x[1] for x in p], J.pa.int32()), "c1": J.pa.array([x[2] for x in p], J.pa.int64())}) for p in parts]
        found = [(a, b, kind) for out in J._tie(t)(iter(batches)) for a, b, kind in zip(*(out.column(x).to_pylist() for x in ("a", "b", "kind")), strict=True)]
        if paired == 32:
            assert {kind for *_, kind in found} == {2} and {frozenset(x[:2]) for x in found} >= want
        together = {x: {x} for _, _, x in rows}
        for a, b, _ in found:
            if together[a] is not together[b]:
                together[a] |= together[b]
                for x in together[a]:
                    together[x] = together[a]
        assert all(len({id(together[x]) for x in pair}) == 1 for pair in want)


def test_texts_that_share_a_shingle_by_chance_are_no_family(frame):
    rows = [(i, prose(100 + i, 150) + f" shared {i // 2} by two texts alone " + prose(900 + i, 150)) for i in range(20)] + family(prose(4, 200), 3, 2, 1000)
    source = J._identified(frame(rows), "doc_id", "text")
    sets = J.shingle_rows(source, 5).where("n > 0")
    of = {r.c1: r.doc_id for r in sets.collect()}
    ties = J.ties_of(source, 5, Fraction("0.8"), False, sets.select("n", "c1", "c2", "sketch")).collect()
    assert {of[x] for r in ties for x in (r.a, r.b)} == {1000, 1001, 1002}
