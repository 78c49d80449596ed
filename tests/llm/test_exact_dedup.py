import hashlib

from scholarlake.llm.exact_dedup import exact_dedup, exact_groups


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(text or "", []).append((doc_id is not None, doc_id or 0, doc_id))
    return {t: (max(g)[2], len(g)) for t, g in groups.items()}


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (5, "b"), (6, "b"), (6, "b"), (7, "long " * 50_000), (8, "A"), (None, "only"), (9, "x"), (9, "y")]


def test_groups_equal_brute_force(frame):
    want = brute(ROWS)
    for counters in (2, 1024):  # with two counters most groups are cold
        got = exact_groups(frame(ROWS), counters=counters).collect()
        assert len(got) == len(ROWS)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
        for r in got:
            assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
        kept = {}
        for r in got:
            kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert set(kept.values()) == {1}  # also where id and text repeat


def test_hot_group_is_verified(frame):
    rows = [(i, "hot" if i % 2 else f"cold {i}") for i in range(300)]
    got = {r.doc_id: r for r in exact_groups(frame(rows), counters=8).collect()}
    assert got[299].kept and got[1].keep_id == 299 and got[1].group_size == 150 and not got[1].kept
    assert all(got[i].kept for i in range(0, 300, 2))


def test_filter_keeps_columns_and_one_row(frame):
    docs = frame(ROWS)
    out = exact_dedup(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(2, "a"), (4, ""), (6, "b"), ROWS[8], (8, "A"), (None, "only"), (9, "x"), (9, "y")], key=str)


def test_filter_of_frequent_and_other_texts(frame):
    rows = [(i, ("hot", "hot", f"pair {i // 12}", f"one {i}")[i % 4]) for i in range(240)] + [(None, "hot"), (None, "pair 3"), (None, "alone"), (237, "hot"), (237, "hot")]
    want = {}
    for doc_id, text in rows:
        want[text] = max(want.get(text, -1), -1 if doc_id is None else doc_id)
    for counters in (2, 8, 1024):  # from most texts cold to every repeated one hot
        got = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in exact_dedup(frame(rows), counters=counters).collect()]
        assert sorted(got) == sorted((d, t) for t, d in want.items())


def test_empty_table(frame):
    assert exact_groups(frame([])).collect() == []
    assert exact_dedup(frame([])).collect() == []
