"""Examples of each scalar function, evaluated by Spark."""

import pytest
from pyspark.sql import functions as F

from scholarlake.functions import doi as D
from scholarlake.functions import records as R
from scholarlake.functions import text as T
from scholarlake.functions import urls as U

CASES = [
    (D.validate_doi, "10.1234/abc", "10.1234/abc"),
    (D.validate_doi, " doi:10.1234/abc. ", "10.1234/abc"),
    (D.validate_doi, "https://doi.org/10.1234/a-b_c", "10.1234/a-b_c"),
    (D.validate_doi, "http://dx.doi.org/10.1234/a;", "10.1234/a"),
    (D.validate_doi, "10.6084/m9.figshare.99(table 4).", "10.6084/m9.figshare.99"),
    (D.validate_doi, "11.1234/abc", None),
    (D.validate_doi, "10.12/abc", None),
    (D.validate_doi, "", None),
    (D.validate_doi, None, None),
    (D.first_doi, "see 10.1234/x.1, and 10.9999/y", "10.1234/x.1"),
    (D.first_doi, "nothing", None),
    (D.doi_key, " 10.1234/ABC ", "10.1234/abc"),
    (D.doi_key, "HTTPS://doi.org/10.1234/ABC", "10.1234/abc"),
    (U.canonical, "no link \u200bhere __ ; !!abc and more", "no link here  and more"),
    (D.doi_href, "10.1234/a", "https://doi.org/10.1234/a"),
    (D.doi_href, "https://x.org", "https://x.org"),
    (D.candidates, "doi:10.1234/a 10.5281/zenodo.1 https://doi.org/10.1234/a 10.2345/b,", ["10.1234/a", "10.2345/b"]),
    (D.front_matter, "Title\n References\n10.1/x", "Title\n"),
    (lambda c: D.front_matter(c, 3), "abcdef", "abc"),
    (T.collapse, " a \n\t b ", "a b"),
    (T.dehyphenate, "exam-\nple", "example"),
    (T.repair_scheme, "http : / / x.org https :/ /y", "http://x.org https://y"),
    (T.join_lines, "one\ntwo.\nthree\n\nfour", "one two.\nthree\n\nfour"),
    (T.compact_letters, "see d a t a s e t here", "see dataset here"),
    (T.compact_letters, "a b c d is short", "a b c d is short"),
    (T.compact_letters, "https://x.org/a stays", "https://x.org/a stays"),
    (T.sentences, "One two. Three! four; 5 six? Seven", ["One two.", "Three! four;", "5 six?", "Seven"]),
    (T.sentences, "", []),
    (T.statement_sentences, "A is here. B is there; C.", ["A is here.", "B is there; C."]),
    (T.normalize, "exam-\nple text\ngoes on. Next one", "example text goes on.\nNext one"),
    (T.paragraphs, "a\r\nb\n \n\n c \n\n", ["a b", "c"]),
    (U.clean_paragraph, "a — b , c", "a - b, c"),
    (U.clean_paragraph, "Received 5 May", None),
    (U.clean_paragraph, "© 2020 Someone", None),
    (U.clean_paragraph, "https://github.com/a/bhttps://github.com/c", "https://github.com/a/b https://github.com/c"),
    (T.repair_spacing, "exam- ple a - b , c .", "example a-b, c."),
    (T.alpha_ratio, "ab12", 0.5),
    (T.singleton_ratio, "a b cd e", 0.75),
    (T.singleton_ratio, "", 0.0),
    (T.tokens, "The the DATA-set of 12 123", ["the", "data", "set", "123"]),
    (lambda c: T.chunks(c, 4, 1), "abcdefgh", ["abcd", "defg", "gh"]),
    (lambda c: T.chunks(c, 4, 1), "abc", ["abc"]),
    (lambda c: T.recursive_chunks(c, 10, 4), "aa bb cc dd ee", ["aa bb cc", "cc dd ee"]),
    (lambda c: T.recursive_chunks(c, 10, 4), " \n\n ", []),
    (lambda c: T.recursive_chunks(c, 4, 1), "abcdefgh", ["abcd", "defg", "gh"]),
    (T.parse_list, '["A.org", " b "]', ["a.org", "b"]),
    (T.parse_list, "A.org, b ,,", ["a.org", "b"]),
    (T.none_to_null, " N/A ", None),
    (T.none_to_null, "yes", "yes"),
    (lambda c: T.merge_headings(F.split(c, r"\|")), "Data availability:|x|Code:|Note:|y", ["Data availability: x", "Code: Note:", "y"]),
    (lambda c: T.merge_broken_urls(F.split(c, r"\|")), "see http:|//zenodo.org/1|next", ["see http://zenodo.org/1", "next"]),
    (U.is_url, "https://zenodo.org/record/1", True),
    (U.is_url, "https://a.b", False),
    (U.is_url, "http://host.org:80/x", False),
    (U.is_url, "http://host.org?q=1", False),
    (U.is_url, "ftp://host.org/x", False),
    (U.domain, "https://www.GitHub.com/a", "github.com"),
    (U.domain, "HTTP://x.org:8080/a", "x.org:8080"),
    (U.domain, "x.org", None),
    (U.found_urls, "(https://a.org/x) and https://b.org/yhttps://c.org/z.", ["https://a.org/x", "https://b.org/y", "https://c.org/z."]),
    (U.clean_link, " www.x.org/a). ", "https://www.x.org/a"),
    (U.clean_link, "ftp://x.org", None),
    (lambda c: U.links(c, "data"), "https://zenodo.org/1, https://zenodo.org/1 https://github.com/a https://doi.org/10.5281/z https://doi.org/10.1/z https://orcid.org/1", ["https://zenodo.org/1", "https://doi.org/10.5281/z"]),
    (lambda c: U.links(c, "code"), "https://www.github.com/a/b https://doi.org/10.5281/z https://gitlab.com/c", ["https://www.github.com/a/b", "https://gitlab.com/c"]),
    (U.layout_urls, "at http : // zen odo.org/rec ord/12 and more", "at http://zenodo.org/record/12 and more"),
    (U.layout_urls, "at https://x.org/a in the end", "at https://x.org/a in the end"),
    (U.layout_urls, "HTTPS://X.org/ a b\tc (d) e", "HTTPS://X.org/abc(d) e"),
    (U.layout_urls, "no scheme here , at all", "no scheme here , at all"),
    (U.layout_urls, "http s://a.b c", "http s://a.b c"),
    (U.layout_urls, "https:// urlde fense .com / v3 / __ https://osf.io/a\u200bb ok", "https://osf.io/abok"),
    (U.clean_paragraph, "a b c d e f https://x.org/a b c d e and so", "abcdef https://x.org/abcde and so"),
    (U.clean_paragraph, "keywordless", "keywordless"),
    (U.clean_paragraph, "Keywords: x", None),
    (U.inspected, "www.x.org/a,", "https://www.x.org/a"),
    (U.inspected, "mailto:x", None),
    (U.link_kind, "https://doi.org/10.1/x", "data"),
    (U.link_kind, "https://github.com/x", "code"),
    (U.link_kind, "https://x.org", "other"),
    (R.normalize_license, "Creative Commons Attribution 4.0 International", "CC-BY-4.0"),
    (R.normalize_license, "cc by-nc", "CC-BY"),
    (R.normalize_license, "The MIT  License", "MIT"),
    (R.normalize_license, "GPLv3", "GPL-3.0"),
    (R.normalize_license, "Apache License,\n Version 2.0", "Apache License, Version 2.0"),
    (R.normalize_license, "CC0", "CC0"),
    (R.normalize_license, "", None),
    (R.license_answer, "MIT", None),
    (R.basename, "a/b/c.pdf", "c.pdf"),
    (R.sanitize_filename, "../a/b.pdf", "_a_b.pdf"),
    (R.sanitize_filename, None, "unnamed.pdf"),
    (R.sanitize_filename, " .. ", "unnamed.pdf"),
    (R.sanitize_filename, "x" * 300 + ".pdf", "x" * 250 + ".pdf"),
    (R.has_extension, "A.PDF", True),
    (R.has_extension, "pdf", False),
    (R.has_extension, None, False),
    (lambda c: R.is_pdf(c.cast("binary")), "%PDF-1.4", True),
    (lambda c: R.is_pdf(c.cast("binary")), "%PDF", False),
    (R.confidence, "0.4", 0.4),
    (R.confidence, "7", 1.0),
    (R.confidence, "high", 0.75),
    (R.confidence, "true", 1.0),
    (lambda c: R.duration_text(c.cast("long")), "125999", "2m 5s"),
    (lambda c: R.position_text(c.cast("int")), "1", "next"),
    (lambda c: R.position_text(c.cast("int")), "4", "4th"),
    (lambda c: R.percent(c.cast("int"), F.lit(8)), "1", 12),
    (lambda c: R.percent(c.cast("int"), F.lit(0)), "1", 0),
    (R.is_title, "A study of seasonal patterns in birds", True),
    (R.is_title, "Research Article:", False),
    (R.is_title, "Molecular Ecology (2000) 9, 1319-1324", False),
    (R.is_title, "Abstract of the work", False),
    (lambda c: R.states_availability(c, "data"), "The data are available at X", True),
    (lambda c: R.states_availability(c, "data"), "The data. All is available", False),
    (lambda c: R.states_availability(c, "code"), "Scripts can be found on GitHub", True),
]


def test_examples(spark):
    columns = [F.col(f"c{i}") for i in range(len(CASES))]
    row = spark.createDataFrame([tuple(x for _, x, _ in CASES)], ", ".join(f"c{i} string" for i in range(len(CASES))))
    for start in range(0, len(CASES), 20):
        part = range(start, min(start + 20, len(CASES)))
        got = row.select(*(CASES[i][0](columns[i]).alias(f"r{i}") for i in part)).first()
        for i in part:
            want = CASES[i][2]
            assert got[f"r{i}"] == (pytest.approx(want) if isinstance(want, float) else want), (i, CASES[i][1], got[f"r{i}"])


STATUS = [
    ("Data will be made available", 1, "data", "future"),
    ("Available upon request, see link", 1, "data", "restricted"),
    ("All data are in the article", 0, "data", "embedded"),
    ("All data are in the article", 1, "data", "open"),
    ("Code is in the article", 0, "code", "none"),
    ("Code is at the link", 2, "code", "open"),
    ("", 3, "data", "none"),
    (None, 0, "data", "none"),
]


def test_status(spark):
    rows = spark.createDataFrame(STATUS, "s string, n int, kind string, want string")
    got = rows.select("want", F.when(F.col("kind") == "data", R.availability_status("s", "n", "data")).otherwise(R.availability_status("s", "n", "code")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_warnings(spark):
    rows = spark.createDataFrame(
        [("see https:", "http://a http://b http://c", 1, 0, "CC-BY", "CC-BY"), ("fine", None, 0, 0, "CC-BY-4.0", "MIT"), (None, None, 0, 0, None, None)], "d string, c string, nd int, nc int, ld string, lc string"
    )
    got = [r.w for r in rows.select(R.quality_warnings("d", "c", "nd", "nc", "ld", "lc").alias("w")).collect()]
    assert got == [["data_statement_truncated_url", "code_fused_links_possible", "identical_data_code_license", "data_license_missing_version"], [], []]


def test_doi_score(spark):
    row = spark.createDataFrame([("doi: 10.1/a https://doi.org/10.2/b 10.3/c",)], "t string")
    got = row.select(*(D.score("t", F.lit(d)).alias(d[-1]) for d in ("10.1/a", "10.2/b", "10.3/c"))).first()
    assert tuple(got) == (1.4, 1.3, 1.0)


def test_reconcile(spark):
    rows = [
        (None, None, None, "10.1/f", 0.5, ("10.1/f", 1.0, True)),
        (None, None, None, "10.1/f", 0.3, (None, None, False)),
        ("10.1/a", 0.6, 0.1, "10.1/f", 0.8, ("10.1/f", 1.0, True)),
        ("10.1/a", 0.95, 0.1, "10.1/f", 0.8, ("10.1/a", 0.665, False)),
        ("10.1/a", 0.6, None, None, None, ("10.1/a", 0.42, False)),
        ("10.1/a", 0.6, 0.5, None, None, ("10.1/a", 1.0, False)),
    ]
    frame = spark.createDataFrame([r[:5] for r in rows], "d string, c double, s double, f string, g double")
    got = frame.select(D.reconcile(*(F.col(x) for x in "dcsfg")).alias("r")).collect()
    for g, r in zip(got, rows, strict=True):
        assert (g.r.doi, g.r.replaced) == (r[5][0], r[5][2])
        assert g.r.confidence == (None if r[5][1] is None else pytest.approx(r[5][1]))
