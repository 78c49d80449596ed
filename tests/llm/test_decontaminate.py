import random

import numpy as np

from scholarlake.llm import decontaminate as D
from tests.llm.conftest import prose

ITEMS = [(i, prose(1000 + i, 18 + i, 50).capitalize() + ". " + prose(2000 + i, 7) + ".") for i in range(20)]
BENCH = "item_id long, text string, doc_id string"


def bench(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "clash") for r in rows], BENCH)


def altered(text, seed, share):
    r = random.Random(seed)
    return " ".join("changed" if r.random() < share else w for w in text.split())


def brute(docs, items):
    """Best LCS ratio of all items over all windows of all documents; the same decision."""
    it = D.read_items([type("Row", (), {"item_id": i, "text": t}) for i, t in items])
    found = {}
    for doc_id, text in docs:
        ids = [it.vocabulary.get(w, -1) for w in D.words_of(text or "")]
        for k, words in enumerate(it.words):
            masks = {}
            for p, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << p
            for at in range(0, max(1, len(ids)), D.STRIDE):
                ratio = D.lcs(masks, len(words), ids[max(0, at - D.STRIDE) : at + 3 * D.STRIDE]) / len(words)
                found[doc_id, it.ids[k]] = max(found.get((doc_id, it.ids[k]), 0), ratio)
    return found


def rows():
    out = [(i, prose(i, 150)) for i in range(60)]
    for i, (_, text) in enumerate(ITEMS):
        out.append((100 + i, prose(300 + i, i * 3) + " " + text.upper() + " " + prose(400 + i, 40)))
        out.append((200 + i, prose(500 + i, 30) + "\n" + altered(text, i, 0.1) + "\n" + prose(600 + i, 50)))
    return [*out, (300, None), (301, ""), (302, "!!! ..."), (303, prose(5, 20_000) + " " + ITEMS[3][1] + " " + prose(6, 5_000)), (100, out[60][1]), (None, ITEMS[4][1])]


def test_equals_brute_force(spark, frame):
    docs = rows()
    got = {(r.doc_id, r.item_id): r.ratio for r in D.find_leaks(frame(docs), bench(spark)).collect()}
    want = {k: v for k, v in brute(docs, ITEMS).items() if v >= D.SURE}
    assert {k for k, v in got.items() if v >= D.SURE} == set(want)
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert {d for d, _ in got} >= {100 + i for i in range(20)} | {200 + i for i in range(20)} | {303, None}
    assert not {d for d, _ in got} & (set(range(60)) | {300, 301, 302})


def test_blocks_of_items(spark, frame, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 6)
    docs = rows()[60:80]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(frame(docs), bench(spark)).collect()}
    assert got == {k for k, v in brute(docs, ITEMS).items() if v >= D.PARAPHRASE}


def test_short_null_and_repeated_items(spark, frame):
    items = [(1, "one two three"), (2, None), (3, ""), (4, ITEMS[0][1]), (4, ITEMS[0][1])]
    got = D.find_leaks(frame([(1, "one two three"), (2, ITEMS[0][1])]), bench(spark, items)).collect()
    assert [(r.doc_id, r.item_id, r.ratio) for r in got] == [(2, 4, 1.0)]


def test_filter(spark, frame):
    docs = frame(rows())
    out = D.decontaminate(docs, bench(spark))
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([*range(60), 300, 301, 302, None], key=str)


def test_empty(spark, frame):
    assert D.find_leaks(frame([]), bench(spark)).collect() == []
    assert D.find_leaks(frame([(1, "a")]), bench(spark, [])).collect() == []


def test_lcs():
    masks = {1: 0b1001, 2: 0b0010, 3: 0b0100}  # the item 1 2 3 1
    assert [D.lcs(masks, 4, w) for w in ([1, 2, 3, 1], [3, 2, 1], [9], [1, 1], [2, 9, 3, 9, 1])] == [4, 2, 0, 2, 3]


def test_directions_of_many_items_are_kept(spark, frame):
    items = D.read_items([type("Row", (), {"item_id": i, "text": prose(3000 + i, 25)}) for i in range(600)])
    weight = np.ones(len(items.vocabulary), np.float32)
    basis = D.latent_basis(D._code(frame([(i, prose(3000 + i, 25)) for i in range(10)]), items), items, weight, 8)
    vectors = items.vectors(weight)
    assert np.allclose(np.linalg.norm(vectors @ basis, axis=1), np.linalg.norm(vectors, axis=1), rtol=1e-3)


def test_more_items_than_a_block(spark, frame):
    items = [(i, prose(3000 + i, 25)) for i in range(D.ITEMS + 88)]
    docs = [(i, prose(i, 40) + " " + text + " " + prose(-i, 40)) for i, text in items]
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(frame(docs), bench(spark, items)).collect()} >= {(i, i) for i, _ in items}


def test_item_in_a_third_of_all_rows(spark, frame):
    docs = [(i, prose(i, 60)) for i in range(200)] + [(1000 + i, prose(7, 30) + " " + ITEMS[0][1] + " " + prose(8, 100)) for i in range(100)]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(frame(docs), bench(spark)).collect()}
    assert got == {(1000 + i, 0) for i in range(100)}


def test_copy_among_rarer_benchmark_words(spark, frame):
    hot = ITEMS[0][1]
    other = " ".join(text for _, text in ITEMS[1:])
    docs = [(i, prose(i, 60)) for i in range(200)] + [(1000 + i, hot) for i in range(100)]
    words = other.split()
    docs.append((5000, " ".join(words[:200:2] + hot.split() + words[1:200:2])))
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(frame(docs), bench(spark)).collect()}
    assert got >= {(1000 + i, 0) for i in range(100)} | {(5000, 0)}


def test_long_items(spark, frame):
    items = [(n, prose(9000 + n, n)) for n in (60, 130, 200, 1_000)]
    docs = [(n, prose(n, 500) + " " + text + " " + prose(-n, 500)) for n, text in items]
    docs += [(10_000 + n, prose(n, 31) + " " + altered(text, n, 0.1) + " " + prose(-n, 5)) for n, text in items]
    docs += [(20_000 + n, " ".join(text.split()[: n // 2])) for n, text in items]
    got = {(r.doc_id, r.item_id): r.ratio for r in D.find_leaks(frame(docs), bench(spark, items)).collect()}
    it = D.read_items([type("Row", (), {"item_id": i, "text": t}) for i, t in items])
    want = {}
    for doc_id, text in docs:  # whole texts
        words = [it.vocabulary.get(w, -1) for w in D.words_of(text)]
        for i, item in zip(it.ids, it.words, strict=True):
            masks = {}
            for p, w in enumerate(item):
                masks[w] = masks.get(w, 0) | 1 << p
            want[doc_id, i] = D.lcs(masks, len(item), words) / len(item)
    assert got == {k: v for k, v in want.items() if v >= D.SURE} and len(got) == 8


def matrix(docs, items, weight):
    """A plain loop: a row for each passage of two chunks, laid end to end."""
    out = []
    for _, text in docs:
        ids = [items.vocabulary.get(w, -1) for w in D.words_of(text or "")]
        for at in range(0, max(1, len(ids)), 2 * D.STRIDE):
            row = np.zeros(len(weight))
            for w in ids[at : at + 2 * D.STRIDE]:
                if w >= 0:
                    row[w] += weight[w]
            out.append(row)
    return np.array(out)


def read(rows):
    return D.read_items([type("Row", (), {"item_id": i, "text": t}) for i, t in rows])


def test_singular_space_equals_numpy(spark, frame):
    docs = [*rows()[:100], (900, prose(5, 1_000) + " " + ITEMS[3][1])]
    items = read(ITEMS)
    weight = np.random.default_rng(1).random(len(items.vocabulary)).astype(np.float32)
    weight[::9] = 0
    a = matrix(docs, items, weight)
    _, size, right = np.linalg.svd(a, full_matrices=False)
    vectors, values = D.singular_space(D._code(frame(docs), items), weight, 12)
    assert np.allclose(values, size[:12], rtol=0.05)
    assert (np.linalg.norm(a @ vectors, axis=0) ** 2).sum() > 0.98 * (size[:12] ** 2).sum()  # as much of the passages as any 12 directions hold


def test_latent_search_alone_finds_paraphrases(spark, frame, monkeypatch):
    """Recall without the exact bound, for more items than a block holds, each in one document of many."""
    items = [(i, prose(3000 + i, 25 + i % 20)) for i in range(D.ITEMS + 88)]
    docs = [(i, prose(i, 60) + " " + altered(text, i, 0.1 * (i % 3)) + " " + prose(-i, 60)) for i, text in items]
    docs += [(10_000 + i, prose(90_000 + i, 200)) for i in range(300)]
    masks = {i: len(t.split()) for i, t in items}
    want = {(i, i) for i, text in items if sum(w != "changed" for w in altered(text, i, 0.1 * (i % 3)).split()) >= D.SURE * masks[i]}
    monkeypatch.setattr(D.Overlap, "candidates", lambda self, c: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert len(want) > 400
    for space in ("latent", "joint"):
        got = {(r.doc_id, r.item_id) for r in D.find_leaks(frame(docs), bench(spark, items), space).collect()}
        assert len(want & got) >= 0.9 * len(want), space


def test_paraphrases_with_and_without_the_answer(spark, frame):
    """Both branches against whole-text loops of the test's own."""
    body, answer = prose(1, 24).split(), prose(2, 6).split()
    items = [(1, " ".join(body) + ". " + " ".join(answer) + ".")]
    n = len(body) + len(answer)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    docs, want = [], set()
    for drop in range(0, 20):
        for with_answer in (True, False):
            text = body[: len(body) - drop] + (answer if with_answer else ["other"] * 6)
            ratio = lcs(body + answer, text) / n
            docs.append((len(docs), prose(50 + drop, 40) + " " + " ".join(text) + " " + prose(70 + drop, 40)))
            if ratio >= 0.8 or ratio >= 0.6 and with_answer:
                want.add(docs[-1][0])
    got = {r.doc_id for r in D.find_leaks(frame(docs), bench(spark, items)).collect()}
    assert got == want and 5 < len(want) < 30


def test_the_space_decides_what_is_compared(spark, frame, monkeypatch):
    """A basis without directions finds nothing but what the bound for lost items adds; with the space, recall at 40, 200 and 600 items."""
    nothing = lambda coded, weight: (np.zeros((len(weight), 1), np.float32), np.zeros(1))
    for n in (40, 200, 600):
        items = [(i, prose(3000 + i, 25 + i % 20)) for i in range(n)]
        docs = frame([(i, prose(i, 60) + " " + altered(text, i, 0.1 * (i % 2)) + " " + prose(-i, 60)) for i, text in items] + [(10_000 + i, prose(90_000 + i, 100)) for i in range(100)])
        whole = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench(spark, items), exact=True).collect()}
        alone = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench(spark, items), kept=0).collect()}
        both = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench(spark, items)).collect()}
        assert alone <= both <= whole and len(alone) >= 0.9 * len(whole) and len(both) >= 0.98 * len(whole) > 0.8 * n
        with monkeypatch.context() as m:
            m.setattr(D, "singular_space", nothing)
            assert D.find_leaks(docs, bench(spark, items), kept=0).count() == 0
            assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench(spark, items)).collect()} == whole  # all items are lost, so the bound searches for all
