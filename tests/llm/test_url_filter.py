import math
import zlib

import pytest
from pyspark.sql import functions as F

from scholarlake.llm import url_filter as U
from scholarlake.llm.url_filter import filter_urls, train_url_model

URLS = "page_id long, url string, rule string, good string"


def rows_of(spark, urls):
    return spark.createDataFrame([(i, u, "x", None) for i, u in enumerate(urls)], URLS)


def test_hosts_paths_and_rules(spark):
    want = [
        ("http://A.Example.com/EN/x?q#f", "a.example.com", "/EN/x", "com/", "allow"),
        ("http://a.example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("ftp://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
        ("http://b.net/fr/", "b.net", "/fr/", "net/fr/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://c.com", "c.com", "", None, None),
        ("http://c.com?x=http://y.com/", "c.com", "", None, None),
        ("http://com/", "com", "/", "com/", "allow"),
        ("no scheme", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("http://ÉX.com:80/p", "Éx.com:80", "/p", None, None),
        ("http://a.org/" + "p" * 50_000, "a.org", "/" + "p" * 50_000, None, None),
    ]
    got = {r.page_id: r for r in filter_urls(rows_of(spark, [w[0] for w in want])).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(want):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_model_separates_what_rules_do_not_decide(spark):
    good = [f"http://site{i}.com/article/{i}" for i in range(200)]
    bad = [f"http://casino{i}.net/es/win-{i}" for i in range(200)]
    asked = [f"http://site{i}.org/article/9{i}" for i in range(20)] + [f"http://casino{i}.org/win-{i}" for i in range(20)]
    got = {r.page_id: r for r in filter_urls(rows_of(spark, good + bad + asked)).collect()}
    assert sum(got[400 + i].verdict == "allow" for i in range(20)) >= 18
    assert sum(got[420 + i].verdict == "block" for i in range(20)) >= 18


def test_one_kind_or_nothing(spark):
    only = filter_urls(rows_of(spark, ["http://a.com/", "http://a.org/", "http://a.org/"])).collect()
    assert [r.verdict for r in only] == ["allow"] * 3
    assert filter_urls(rows_of(spark, [])).collect() == []
    assert train_url_model(spark.createDataFrame([], "page_id long, url string, good boolean")) is None


def brute_scores(urls, learned):
    """A plain dictionary model: urls -> scores; learned: (url, good)."""
    counts = ({}, {})
    for url, good in learned:
        s = b"\x02" * U.ORDER + url.encode() + b"\x03"
        for i in range(U.ORDER, len(s)):
            for o in range(U.ORDER + 1):
                row = counts[good].setdefault((o, s[i - o : i]), {})
                row[s[i]] = row.get(s[i], 0) + 1

    def p(k, s, i):
        out = 1 / 256
        for o in range(U.ORDER + 1):
            row = counts[k].get((o, s[i - o : i]), {})
            out = (row.get(s[i], 0) + U.STRENGTH * out) / (sum(row.values()) + U.STRENGTH)
        return out

    scores = []
    for url in urls:
        s = b"\x02" * U.ORDER + url.encode() + b"\x03"
        at = range(U.ORDER, len(s))
        scores.append(sum(math.log(p(1, s, i)) - math.log(p(0, s, i)) for i in at) / len(at) if url else 0.0)
    return scores


@pytest.mark.parametrize("carried", [1 << 20, 40, 0])
def test_equals_a_dictionary_model(spark, monkeypatch, carried):
    monkeypatch.setattr(U, "CARRIED", carried)
    urls = [f"http://site{i}.com/article/{i}" for i in range(40)] + [f"http://casino{i}.net/es/win-{i}" for i in range(40)]
    urls += ["http://site1.org/article/é", "http://casino.org/win", "", "no scheme", urls[0], "http://a.org/" + "p" * 3000]
    got = {r.page_id: r for r in filter_urls(rows_of(spark, urls)).collect()}
    ruled = [(i, u, u.startswith("http://site")) for i, u in enumerate(urls) if got[i].rule]
    held = [r for r in ruled if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    want = brute_scores(urls, [(u, g) for i, u, g in ruled if (i, u, g) not in held])
    assert all(abs(got[i].url_score - w) < 1e-9 for i, w in enumerate(want))
    bins = sorted({round(1000 * max(-8, min(8, want[i]))) for i, _, _ in held})
    share = lambda b, good: sum(round(1000 * want[i]) <= b for i, _, g in held if g == good) / sum(g == good for _, _, g in held)
    gains = [share(b, False) - share(b, True) for b in bins]
    at = gains.index(max(gains))
    cut = (bins[at] + bins[min(at + 1, len(bins) - 1)]) / 2000
    assert all(got[i].verdict == ("allow" if w >= cut else "block") for i, w in enumerate(want) if got[i].rule is None)


def test_probabilities_sum_to_one(spark):
    learned = spark.createDataFrame([(f"http://site{i % 7}.com/a{i}", i % 3 > 0) for i in range(60)], "url string, good boolean")
    seen = U.window_counts(learned)
    contexts = [b"http:", b"\x02\x02\x02\x02\x02", b"site1", b".com/", b"zzzzz"]
    asked = [(int.from_bytes(c + bytes([b]), "big"), 0, 0, 0) for c in contexts for b in range(256)]
    rows = U.probabilities(seen.unionByName(spark.createDataFrame(asked, seen.schema)).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "hits"))))
    found = {r.c: r for r in rows.groupBy(F.shiftright("key", 8).alias("c")).agg(F.sum("p0").alias("p0"), F.sum("p1").alias("p1"), F.count("*").alias("n")).collect()}
    for c in contexts:
        r = found[int.from_bytes(c, "big")]
        assert r.n == 256 and abs(r.p0 - 1) < 1e-9 and abs(r.p1 - 1) < 1e-9
