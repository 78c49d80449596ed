import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from scholarlake.llm import collocations as P

SCHEMA = "doc_id long, text string, lang string, phrase string, a int, l string, r string, n string, score string, depth int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, "x", None, "y", None, "z", None, 3) for i, (t, lang) in enumerate(docs)], SCHEMA)


def brute(docs, least=30, top=2000):
    counts, total = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for d in range(1, 5):
                for i in range(len(words) - d + 1):
                    counts[lang, tuple(words[i : i + d])] = counts.get((lang, tuple(words[i : i + d])), 0) + 1
    held = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    covered = set()
    for (lang, w), a in held.items():
        for d in range(2, len(w)):
            for i in range(len(w) - d + 1):
                if 100 * a >= 80 * held[lang, w[i : i + d]]:
                    covered.add((lang, w[i : i + d]))
    out = {}
    for (lang, w), a in held.items():
        if (lang, w) not in covered:
            cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, counts[lang, w[:k]], counts[lang, w[k:]]))
    rows = []
    for lang, found in out.items():
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), a, left, right, total[lang], -score))
    return sorted(rows)


def documents(seed, n=80):
    r = random.Random(seed)
    words = ["the", "The", "data", "of", "é", "a", "zz", "x\x85y", "b\x00", "ÄB", "äb", "in", "set-up", "𝒳"]
    docs = []
    for _ in range(n):
        text = ""
        for _ in range(r.randrange(0, 160)):
            text += r.choice(words[:5]) if r.random() < 0.6 else r.choice(words)
            text += r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?", " - "])
        docs.append((text, r.choice(["en", "de", None, "und", ""])))
    return [*docs, (None, "en"), ("", "fr"), ("one", None), (" .\n", "en")]


def rows(found):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


@pytest.mark.parametrize(("seed", "parts", "top"), [(1, 1, 2000), (2, 9, 2000), (3, 40, 5)])
def test_against_plain_counting(spark, monkeypatch, seed, parts, top):
    monkeypatch.setattr(P, "SAMPLED", 2)
    docs = documents(seed)
    docs += [(docs[0][0], "en")] * 5 + [("the data of the data of " * 3000, "en")]  # copies and a very long text
    want = brute(docs, 12, top)
    assert rows(P.collocations(frame(spark, docs).repartition(5), least=12, top=top, parts=parts)) == want and len(want) > 10


def test_shards_that_are_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD_NODES", 150)
    monkeypatch.setattr(P, "STEP", 700)
    monkeypatch.setattr(P, "SAMPLED", 1)
    docs = documents(4, 50)
    assert rows(P.collocations(frame(spark, docs), least=10, parts=6)) == brute(docs, 10)


def test_words_longer_than_borders(spark, monkeypatch):
    monkeypatch.setattr(P, "SAMPLED", 1)
    monkeypatch.setattr(P, "BORDER_BYTES", 2)
    docs = [(" ".join(f"long{w}" * (1 + w) if w % 3 else f"w{w}" for w in range(i % 7, i % 7 + 12)), "en") for i in range(60)] + documents(9, 40)
    assert rows(P.collocations(frame(spark, docs), least=8, parts=9)) == brute(docs, 8)


def test_full_bits_change_nothing(spark, monkeypatch):
    docs = documents(6, 60)
    monkeypatch.setattr(P, "MOST_BITS", 1 << 6)
    assert rows(P.collocations(frame(spark, docs), least=10, parts=3)) == brute(docs, 10)


def test_sql_agrees():
    docs = documents(5, 120)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert sorted(con.execute(P.OP12_SQL).fetchall()) == brute(docs)


def test_empty_and_rare(spark):
    assert P.collocations(frame(spark, [])).count() == 0
    assert P.collocations(frame(spark, [(None, None), ("a b c", "en")])).count() == 0


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000
    found = spark.createDataFrame([("en", "a", 1, big + 1, []), ("en", "b", 1, big, []), ("en", "a b", 2, big, [big + 1])], "lang string, phrase string, depth int, a long, lefts array<long>")
    assert P.scored(found).first().score == 2000000 * big // (2 * big + 1)
    held = spark.createDataFrame([("en", "a b", 2, 10 * big), ("en", "a b c", 3, 8 * big - 1), ("en", "b c", 2, 10 * big - 10), ("en", "x y", 2, 1)], "lang string, phrase string, depth int, a long")
    assert {r.phrase for r in P.kept(held).collect()} == {"a b", "a b c", "x y"}


def test_ranges_hold_every_node_once_and_the_way_to_it():
    texts = [(t or "").encode() for t, _ in documents(8, 30)]
    trie = P.grow([t for t in texts if t], [b"en"] * sum(bool(t) for t in texts), 4)
    borders = sorted({trie.path(2, i) for i in range(0, len(trie.levels[2][0]), 7)} | {(b"en", b"a", b""), (b"zz", b"a", b"b")})
    parts = [(r, P.unpack(P.pack(t))) for r, t in P.cut(trie, borders)]
    for d in (2, 3, 4):
        paths = [(p.path(d, i), int(p.levels[d][2][i])) for _, p in parts for i in range(len(p.levels[d][0]))]
        assert sorted(paths) == sorted((trie.path(d, i), int(trie.levels[d][2][i])) for i in range(len(trie.levels[d][0])))
    ones = {trie.path(1, i): int(trie.levels[1][2][i]) for i in range(len(trie.levels[1][0]))}
    assert all(ones[p.path(1, i)] == p.levels[1][2][i] for _, p in parts for i in range(len(p.levels[1][0])))
    twice = P.merge([trie, trie])
    assert all(np.array_equal(2 * a[2], b[2]) for a, b in zip(trie.levels, twice.levels, strict=True)) and twice.words.equals(trie.words)
    assert isinstance(trie.words, pa.Array)
