import datetime
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.operators import answers, jobs, layout, papers, retrieval
from scholarlake.plans.queries import QUERIES
from scholarlake.plans.views import view
from scholarlake.sources import files, services

BLOCKS = "doc_id long, seq int, page int, col int, text string"


def blocks(spark, *pages):
    return spark.createDataFrame([(1, i, 1, 0, t) for i, t in enumerate(pages)], BLOCKS)


def found(spark, *pages):
    return {r.kind: r for r in papers.availability(blocks(spark, *pages)).collect()}


def test_statement_and_links(spark):
    got = found(spark, "Data availability: All data are available at https://zenodo.org/record/1.", "Code availability\n\nCode is available at https://github.com/a/b")
    assert got["data"].links == ["https://zenodo.org/record/1"] and got["data"].status == "open"
    assert got["code"].links == ["https://github.com/a/b"] and got["code"].statement.startswith("Code is available")
    assert 0 < got["data"].confidence <= 0.6


def test_snippets(spark):
    got = found(spark, "Data availability: sensor readings count as open data, available from figshare under https://doi.org/10.6084/m9.figshare.771204[file 2].")
    assert any("doi.org/10.6084/m9.figshare.771204" in u for u in got["data"].links) and got["data"].statement
    got = found(spark, "DATA AVAILABILITY\nAnyone may reuse our counts; the dataset is provided through a community page (https://doi.org/10.5281/zenodo.5550123).")
    assert got["data"].links == ["https://doi.org/10.5281/zenodo.5550123"]
    got = found(spark, "Code availability All scripts are shared by the computing desk of the herbarium:")
    assert got["code"].statement and got["code"].links == []
    got = found(spark, "Data availability:", "Code availability:")
    assert got["data"].statement is None and got["data"].status == "none"
    got = found(spark, "Data availability", "Data are available at https://zenod o.org/record/9.")
    assert got["data"].links == ["https://zenodo.org/record/9"]


def test_links_come_from_the_statement_alone(spark):
    got = found(spark, "Data availability", "Tables are at https://zenodo.org/record/9.")
    assert got["data"].statement is None and got["data"].links == [] and got["data"].status == "none"
    got = found(spark, "Data availability: All data are available upon request.", "Others keep their data at https://osf.io/other and code at https://github.com/o/o")
    assert got["data"].links == [] and got["data"].status == "restricted"
    wrapped = "All data are available at https://urldefense.com/v3/__https://zenodo.org/rec\u00adord/5__;!!N1x!6ab-c$ and in the printed volume of the society."
    assert found(spark, wrapped)["data"].links == ["https://zenodo.org/record/5"]
    for broken, whole in (("https://osf.io/ab c/d1", "https://osf.io/abc/d1"), ("https://figshare.com/x= 7", "https://figshare.com/x=7"), ("https://zenodo.org/ record/8", "https://zenodo.org/record/8")):
        assert found(spark, f"All data are available at {broken} in the archive of the society")["data"].links == [whole]


def test_answers_take_the_place_of_the_fallback(spark):
    page = blocks(spark, "Data availability: All data are available at https://osf.io/ab12c.", "Code availability: Code is available at https://github.com/a/b")
    reply = lambda **part: spark.createDataFrame([(1, json.dumps({"data": {"verdict": "present", "raw_quote": "All data are available at https://osf.io/ab12c.", **part}}))], "doc_id long, reply string")
    out = lambda replies: {r.kind: r for r in papers.availability(page, replies=replies).collect()}
    got = out(reply(clean_statement="Data are available on OSF.", links=["https://osf.io/ab12chttps://zenodo.org/record/3", "https://example.com/x"], confidence=0.9))
    assert got["data"][2:] == ("Data are available on OSF.", 0.9, ["https://osf.io/ab12c", "https://zenodo.org/record/3"], "open")
    assert got["code"].links == ["https://github.com/a/b"]
    got = out(reply(clean_statement="none", confidence="0.9"))["data"]
    assert got.statement == "All data are available at https://osf.io/ab12c." and got.links == ["https://osf.io/ab12c"] and got.confidence == 0.75
    fallback = papers.availability(page).where("kind = 'data'").collect()
    for other in (reply(raw_quote="All data are available elsewhere"), reply(verdict="absent"), spark.createDataFrame([(1, "no"), (2, None)], "doc_id long, reply string")):
        assert [out(other)["data"]] == fallback


def test_best_title_equals_all_pairs(spark):
    r = random.Random(3)
    words = [f"word{i}" for i in range(12)] + [f"seldom{i}" for i in range(60)]
    title = lambda: " ".join(r.choice(words[: r.choice([6, 12, 72])]) for _ in range(r.randrange(0, 9)))
    mine = [(i, title()) for i in range(80)] + [(80, None), (81, "to be")]
    known = [(f"10.1/{i}", title(), r.choice(["crossref", "openalex", None])) for i in range(150)] + [("10.2/x", None, "crossref")]
    ours, theirs = spark.createDataFrame(mine, "doc_id long, title string"), spark.createDataFrame(known, "doi string, title string, source string")
    tokens = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) >= 3}
    for least, rare in ((0.4, 50), (0.4, 3), (0.4, 0), (0.7, 5)):
        got = {x.doc_id: (x.doi, round(x.similarity, 9)) for x in papers.best_registry_match(ours, theirs, least=least, rare=rare).collect()}
        want = {}
        for doc_id, t in mine:
            a = tokens(t)
            sims = [(-len(a & tokens(k)) / len(a | tokens(k)), s != "crossref", doi) for doi, k, s in known if a and tokens(k)]
            sims = [x for x in sims if -x[0] >= least]
            if sims:
                want[doc_id] = (min(sims)[2], round(-min(sims)[0], 9))
        assert got == want and len(want) > 5


def test_nothing_relevant_falls_back_to_all_text(spark):
    rows = papers.rank_contexts(papers.segment(blocks(spark, "First words.", "Second words."))).where("kind = 'data'").collect()
    assert [(r.source, r.text, r.points) for r in rows] == [("global", "First words. Second words.", 10)]


def test_segments(spark):
    got = papers.segment(blocks(spark, "Data availability: see\n\nDATA HERE\n\n ", "https://x.org: not a heading")).orderBy("idx").collect()
    assert [(r.idx, r.label, r.text) for r in got] == [(0, "data", "Data availability:"), (1, None, "see"), (2, "generic", "DATA HERE"), (3, None, "https://x.org: not a heading")]


def test_titles(spark):
    lines = blocks(spark, "Molecular Ecology (2000) 9, 1319-1324", "Seasonal patterns\nin alpine birds", "Department of Birds", "Never reached here")
    assert papers.title_lines(lines).first().lines == ["Seasonal patterns", "in alpine birds"]
    assert tuple(papers.resolved_title(lines).first())[1:] == ("Seasonal patterns", 0.6)
    short = blocks(spark, "Birds", "Alps")
    assert tuple(papers.resolved_title(short).first())[1:] == ("Birds: Alps", 0.56)
    assert tuple(papers.resolved_title(blocks(spark, "1234 5678 90")).first())[1:] == (None, 0.0)
    assert papers.heuristic_title(blocks(spark, "Research Article:", "Abstract of this", "Seasonal patterns in alpine birds")).first().title == "Seasonal patterns in alpine birds"


def test_best_doi_prefers_score_then_order(spark):
    text = blocks(spark, "10.1111/first 10.1111/second", "doi: 10.1111/third", "References", "doi:10.9999/late")
    assert tuple(papers.best_doi(papers.doi_candidates(text)).first()) == (1, "10.1111/third", 1.0)
    assert papers.best_doi(papers.doi_candidates(blocks(spark, "10.1111/a 10.1111/b"))).first().doi == "10.1111/a"


def test_record(spark):
    registry = spark.createDataFrame([("10.1111/x", "Seasonal patterns in alpine birds", 2000, "crossref")], "doi string, title string, issued_year int, source string")
    rows = papers.paper_records(blocks(spark, "Seasonal patterns in alpine birds", "No identifier", "Data availability", "Data are available at https://osf.io/abc"), registry)
    r = rows.first()
    assert (r.doi, r.doi_from_title_search, r.data_status, r.data_links) == ("10.1111/x", True, "open", ["https://osf.io/abc"])
    assert set(r.confidences) == {"title", "doi", "data"} and r.warnings == []
    out = jobs.export_records(rows)
    from scholarlake.config import EXPORT_COLUMNS

    assert tuple(out.columns) == EXPORT_COLUMNS and out.first().doi_from_title_search == "true" and out.first().data_links_count == "1"


def test_dois_beyond_the_front_matter(spark):
    page = blocks(spark, "No identifier", "References", "Nobody 1999, 10.9999/late.1 and doi:10.9999/late.2")
    assert papers.best_doi(papers.doi_candidates(page)).first().doi == "10.9999/late.2"
    none = papers.best_doi(papers.doi_candidates(blocks(spark, "Only 10.5281/zenodo.7 here")))
    reply = lambda x: spark.createDataFrame([(1, x)], "doc_id long, doi_reply string")
    assert none.collect() == [] and papers.complete_dois(none, blocks(spark, "Only 10.5281/zenodo.7 here")).collect() == []
    said = blocks(spark, "the id 10.5281/zenodo.7 10.1234/ab")
    guard = lambda x: [(r.doi, r.confidence) for r in papers.complete_dois(none, said, reply(x)).collect()]
    assert guard("doi:10.1234/ab") == [("10.1234/ab", 0.5)] and guard("10.7777/made.up") == guard(None) == []
    assert [tuple(r) for r in papers.complete_dois(none, blocks(spark, "at 10.1234/cd"), reply("10.7777/no")).collect()] == [(1, "10.1234/cd", 0.45)]


def test_record_with_replies(spark):
    registry = spark.createDataFrame([], "doi string, title string, issued_year int, source string")
    quote = "Data are available at https://osf.io/ab12c."
    answer = json.dumps({"data": {"verdict": "present", "raw_quote": quote, "clean_statement": "Data are on OSF.", "confidence": 1}})
    replies = spark.createDataFrame([(1, answer, None, "Creative Commons Attribution 4.0", "None")], "doc_id long, reply string, doi_reply string, data_license string, code_license string")
    records = papers.paper_records(blocks(spark, "Seasonal patterns in alpine birds", "Data availability", quote), registry, replies=replies)
    r = records.first()
    assert (r.data_statement, r.data_links, r.code_license) == ("Data are on OSF.", ["https://osf.io/ab12c"], None) and r.data_license and r.confidences["data"] == 1.0
    docs = spark.createDataFrame([(5, 1, "x/a.pdf", "done", None), (5, 2, None, "error", "broken"), (5, 3, "c.pdf", "queued", None)], "job_id long, doc_id long, filename string, status string, error string")
    rows = {x.source_file: x for x in jobs.export_documents(docs, records).collect()}
    assert set(rows) == {"x/a.pdf", "unknown.pdf"} and rows["unknown.pdf"].error == "broken" and rows["unknown.pdf"].data_links_count == "0" and rows["unknown.pdf"].title == ""
    a = rows["x/a.pdf"]
    assert (a.filename, a.data_availability_statement, a.data_sharing_license, a.data_links, a.data_links_count) == ("a.pdf", "Data are on OSF.", r.data_license, "https://osf.io/ab12c", "1")


def test_cancel_keeps_earlier_errors(spark):
    docs = spark.createDataFrame([(1, "a", "error", "broken"), (1, "b", "queued", None), (2, "c", "queued", "warned")], "job_id long, doc_id string, status string, error string")
    one = spark.createDataFrame([(1,), (1,)], "job_id long")
    assert {r.doc_id: (r.status, r.error) for r in jobs.cancel(docs, one).collect()} == {"a": ("error", "broken"), "b": ("error", "Cancelled by user"), "c": ("queued", "warned")}
    j = spark.createDataFrame([(1, "running", None), (2, "done", "old")], "job_id long, status string, error string")
    assert {r.job_id: (r.status, r.error) for r in jobs.cancel_jobs(j, one).collect()} == {1: ("error", "Cancelled by user"), 2: ("done", "old")}


def test_downloads_and_reports(spark):
    j = spark.createDataFrame([(1,), (2,)], "job_id long")
    logs = spark.createDataFrame([(i, 1, T0 + datetime.timedelta(seconds=i // 2), "op") for i in range(7)] + [(9, 3, T0, "x")], "log_id long, job_id long, ts timestamp, op string")
    rows = jobs.log_download(j, logs).orderBy("job_id", "ts", "log_id").collect()
    assert [r.log_id for r in rows] == [0, 1, 2, 3, 4, 5, 6, None] and json.loads(rows[-1].value) == {"job_id": "2", "info": "no logs available"} and json.loads(rows[0].value)["op"] == "op"
    assert sorted(r.log_id for r in jobs.log_download(j, logs, descending=True, page=3).where("job_id = 1").collect()) == [4, 5, 6]
    runs = spark.createDataFrame([(True, 10, True), (True, 30, None), (False, 99, True), (None, None, None)], "success boolean, duration_ms long, accurate boolean")
    assert jobs.workflow_report(runs).first() == (4, 2, 2, 50.0, 20.0, 10, 30, 1, 50.0)
    assert jobs.workflow_report(runs.limit(0)).first()[:4] == (0, 0, 0, None)
    checks = spark.createDataFrame([(True, True), (True, None), (False, True)], "a boolean, b boolean").select(jobs.all_checks(F.col("a"), F.col("b")).alias("x"), jobs.all_checks().alias("none"))
    assert [tuple(r) for r in checks.collect()] == [(True, False), (False, False), (False, False)]


def test_text_of_lines(spark):
    words = [(1, f"w{i}", x, x + 8.0, top, top + 10.0, 600.0, t) for i, (x, top, t) in enumerate([(20.0, 10.0, "here:"), (10.0, 10.0, " See "), (30.0, 10.0, " "), (10.0, 50.0, "the text."), (10.0, 90.0, "At https:"), (10.0, 130.0, "//osf.io/x")])]
    lines = layout.with_lines(layout.with_columns(spark.createDataFrame(words, "page_id int, word_id string, x0 double, x1 double, top double, bottom double, page_width double, text string")))
    assert [r.text for r in layout.line_text(lines).orderBy("line").collect()] == ["See here:", "the text.", "At https:", "//osf.io/x"]
    assert [r.text for r in layout.paragraph_text(lines).orderBy("pos").collect()] == ["See here: the text.", "At https://osf.io/x"]
    got = spark.createDataFrame([("a\r\n\r\n\r\n b \n\n\n\n \n\nc\rd",), (None,), ("",)], "t string").select(T.split_simple("t").alias("p")).collect()
    assert [r.p for r in got] == [["a", "b", "c\nd"], None, []]
    from scholarlake.functions import records as R

    names = spark.createDataFrame([("m",), ("m:latest",), ("mm",), (None,)], "n string").select(R.serves_model("n", "m").alias("x")).collect()
    assert [r.x for r in names] == [True, True, False, False]


T0 = datetime.datetime(2024, 1, 1)


def tables(spark):
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    j = spark.createDataFrame(
        [(1, 7, "running", at(0), at(1), None, None), (2, 7, "pending", at(10), None, None, None), (3, 8, "pending", at(10), None, None, None), (4, 8, "pending", at(20), None, None, None), (5, 8, "done", at(5), at(6), at(8), None)],
        "job_id long, user_id long, status string, created_at timestamp, started_at timestamp, finished_at timestamp, error string",
    )
    d = spark.createDataFrame([(1, "a", "done", at(1), "x/a.pdf", 5), (1, "b", "queued", at(2), "b.pdf", 5), (1, "c", "queued", at(1), "c.pdf", 5), (5, "d", "error", at(3), "", 5), (9, "e", "queued", at(4), "e", 5)], "job_id long, doc_id string, status string, created_at timestamp, filename string, size_bytes long")
    return j, d


def test_queue(spark):
    j, d = tables(spark)
    assert {r.job_id: r.queue_position for r in jobs.queue_positions(j).collect()} == {2: 1, 3: 1, 4: 3}
    assert jobs.promote(j, d).collect() == []
    done = d.withColumn("status", F.lit("done"))
    assert [r.job_id for r in jobs.promote(j, done).collect()] == [2]
    assert [r.job_id for r in jobs.to_finalize(j, done).collect()] == [1] and jobs.to_finalize(j, d).collect() == []
    assert [r.doc_id for r in jobs.claim_next(d, j).collect()] == ["c"]
    assert [r.doc_id for r in jobs.jobless(d, j).collect()] == ["e"]
    assert {r.job_id: (r.total, r.current, r.remaining, r.percent) for r in jobs.job_progress(j, d).collect()}[1] == (3, 1, 2, 33)
    assert {r.job_id: r.duration_ms for r in jobs.job_detail(j, d).collect()} == {1: None, 2: None, 3: None, 4: None, 5: 2000}
    assert [r.job_id for r in jobs.newest_jobs(j, 2).collect()] == [4, 3] and [r.job_id for r in jobs.newest_jobs(j, user_id=7, status="pending").collect()] == [2]


def test_ownership(spark):
    j, _ = tables(spark)
    assert jobs.owned(j, 7).count() == 2 and jobs.owned(j, 7, admin=True).count() == 5
    users = spark.createDataFrame([(" A@x.org ",), ("b@x.org",), (None,)], "email string")
    assert [r.a for r in users.select(jobs.is_admin(F.col("email"), ("a@X.org",)).alias("a")).collect()] == [True, False, False]


def test_transitions(spark):
    j, d = tables(spark)
    one = spark.createDataFrame([(1,), (1,)], "job_id long")
    got = {r.doc_id: (r.status, r.error) for r in jobs.cancel(d, one).collect()}
    assert got == {"a": ("done", None), "b": ("error", jobs.CANCELLED), "c": ("error", jobs.CANCELLED), "d": ("error", None), "e": ("queued", None)}
    five = spark.createDataFrame([(5,), (1,)], "job_id long")
    assert [(r.job_id, r.doc_id, r.status) for r in jobs.rerun(d, j, five, 100).collect()] == [(105, "d-r", "queued")]
    assert sorted(r.doc_id for r in jobs.delete_jobs(d, one).collect()) == ["d", "e"]
    events = spark.createDataFrame([(1, 1, "queued"), (1, 2, "cancelled"), (1, 3, "done"), (2, 1, "queued")], "k int, ts int, s string").withColumn("log_id", F.col("ts"))
    assert {r.k: r.s for r in jobs.fold_states(events, "k", "s", final=("cancelled",)).collect()} == {1: "cancelled", 2: "queued"}
    assert {r.k: r.s for r in jobs.fold_states(events, "k", "s").collect()} == {1: "done", 2: "queued"}


def test_log_pages_cover_all(spark):
    rows = [(i, 1, T0 + datetime.timedelta(seconds=i // 4), "op", "info") for i in range(30)]
    logs = spark.createDataFrame(rows, "log_id long, job_id long, ts timestamp, op string, level string")
    seen, after = [], None
    while True:
        page = jobs.log_page(logs, 7, after).collect()
        if not page:
            break
        seen += [r.log_id for r in page]
        after = (page[-1].ts, page[-1].log_id)
    assert seen == list(range(30))
    assert [r.log_id for r in jobs.log_page(logs, 3, (T0 + datetime.timedelta(seconds=1), 5), descending=True).collect()] == [4, 3, 2]
    assert jobs.log_page(logs, 99, (T0 + datetime.timedelta(seconds=7),)).count() == 2


def test_quartiles_take_the_lower_value(spark):
    d = spark.createDataFrame([(1, "done", None, None, 0, 1, c) for c in (0.175, 1.0, 0.6)], "job_id int, status string, title string, doi string, n_data_links int, n_code_links int, confidence double")
    r = jobs.quality_rollup(d).first()
    assert (r.confidence_p25, r.confidence_p75, r.confidence_mean, r.missing_title, r.empty_data_links, r.empty_code_links) == (0.175, 0.6, 0.591667, 3, 3, 0)


def test_layout(spark):
    words = [(1, f"{c}{i}{k}", 10.0 + 30 * k + 300 * c, 35.0 + 30 * k + 300 * c, 20.0 * i, 20.0 * i + 10, 600.0) for c in (0, 1) for i in range(4) for k in range(6)]
    frame = spark.createDataFrame(words, "page_id int, word_id string, x0 double, x1 double, top double, bottom double, page_width double")
    assert 0.35 * 600 <= layout.column_splits(frame).first().split <= 0.65 * 600
    lines = layout.with_lines(layout.with_columns(frame))
    assert lines.select("col", "line").distinct().count() == 8
    assert {r.words for r in layout.tokens(lines).collect()} == {6}
    assert layout.paragraphs(lines).count() == 2


def test_retrieval(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "vec_id long, embedding array<float>")
    got = retrieval.nearest(v, v.where("vec_id = 2"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 5, 8]
    assert retrieval.nearest(v, v.limit(0)).collect() == []


def test_nearest_over_many_steps_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "STEP_SCORES", 30)
    r = random.Random(4)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(3)]) for i in range(90)] + [(90, [float("nan")] * 3)]  # small whole numbers: many ties
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = v.where("vec_id % 9 = 0 AND vec_id < 90")
    got = {}
    for x in retrieval.nearest(v, queries, 7).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.similarity))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for q, e in rows[:90:9]:
        assert got[q] == sorted(((i, dot(e, f)) for i, f in rows[:90]), key=lambda x: (-x[1], x[0]))[:7]
    assert len(got) == 10
    rows = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc")], "doc_id int, ord int, text string")
    assert retrieval.capped_context(rows, 7).first().context == "aaaa\nbb"


@pytest.mark.parametrize(("reply", "want"), [('x {"data": {"verdict": "present", "raw_quote": "Data are  available", "clean_statement": "none", "confidence": 2}} y', ("Data are available", 1.0)), ("no json", None), ("", None), ('{"data": {"verdict": "absent"}}', None), ('{"data": {"verdict": "present", "raw_quote": "Data are shared elsewhere"}}', None)])
def test_answers(spark, reply, want):
    row = spark.createDataFrame([(reply, ["All Data are available here"])], "r string, c array<string>")
    got = row.select(answers.grounded(answers.parse_answer("r"), F.col("c"), "data").alias("a")).first().a
    assert (got and tuple(got)) == want


def test_services(spark):
    prompts = spark.createDataFrame([(1, "ok"), (2, "bad")], "doc_id long, prompt string")

    def chat(p):
        if p == "bad":
            raise ValueError("refused")
        return p.upper()

    assert sorted(map(tuple, services.ask(prompts, chat).collect())) == [(1, "OK", None), (2, None, "refused")]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise services.Retry
        return "fine"

    waited = []
    assert services.with_retries(flaky, (1, 2, 3), waited.append)() == "fine" and waited == [1, 2]
    texts = spark.createDataFrame([(i, "x" * i) for i in range(5)], "vec_id long, text string")
    assert {r.vec_id: r.embedding for r in services.embed(texts, lambda b: [[float(len(t))] for t in b], batch=2).collect()}[4] == [4.0]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1.4 one\n\ntwo\nthree\f \fpage three")
    (tmp_path / "in/b.txt").write_bytes(b"plain")
    read = files.read_files(spark, str(tmp_path / "in"))
    assert {r.filename: r.reject for r in files.gate(read).collect()} == {"a.pdf": None, "b.txt": "extension"}

    def broken(_):
        raise OSError

    got = files.read_blocks(read.where("filename = 'a.pdf'"), [broken, files.text_pages]).orderBy("page", "seq").collect()
    assert [(r.page, r.seq, r.text) for r in got] == [(1, 0, "%PDF-1.4 one"), (1, 1, "two three"), (3, 0, "page three")]
    files.write_csv(read.select("filename"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    files.write_diagnostics(read.select("filename", "size_bytes"), str(tmp_path / "diag"))
    assert spark.read.json(str(tmp_path / "diag")).count() == 2


def test_spaced_letters_of_whole_blocks(spark, tmp_path):
    rows = [(i, "word dataset 12 " * i + "and, more; letters", "en") for i in range(1, 41)] + [(50, "letters " * 60, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.seq): r.text for r in QUERIES["spaced_letter_compaction"](spark, str(tmp_path)).collect()}
    want = {}
    for r in view(spark, str(tmp_path), "papers_view").collect():
        spaced = re.sub("([A-Za-z])(?=[A-Za-z])", r"\1 ", r.text)
        want[r.doc_id, r.seq] = re.sub(r"(?<!\w)[a-zA-Z]\b(?:\s+[a-zA-Z]\b){4,}", lambda m: "".join(m[0].split()), spaced)
    assert got == want and max(map(len, got.values())) > 300
    long = spark.createDataFrame([("d a t a " * 40_000 + "end",)], "text string").select(T.compact_letters("text").alias("text")).first().text
    assert long == "data" * 40_000 + " end"


def test_nearest_within_a_document(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(f"d{i % 7}" if i % 50 else None, i, [float(x) for x in r.integers(-2, 3, 5)] if i % 31 else None, f"t{i % 40}") for i in range(600)]
    rows += [("big", 1000 + i, [float(x) for x in r.integers(-2, 3, 5)], f"t{i}") for i in range(500)]
    chunks = spark.createDataFrame(rows, "doc_id string, vec_id long, embedding array<float>, text string")
    monkeypatch.setattr(retrieval, "KEY_BLOCK", 60)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "STEP_SCORES", 100)
    queries = [(d, q, [float(x) for x in r.integers(-2, 3, 5)]) for d in ("d1", "d2", "big", "none") for q in range(8)] + [(None, 1, [1.0] * 5)]
    found = retrieval.nearest_within(chunks, spark.createDataFrame(queries, "doc_id string, vec_id long, embedding array<double>"))
    want = set()
    for d, q, v in queries:
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for doc, i, w, _ in rows if d is not None and doc == d and w is not None)
        want |= {(d, q, i, -s, n) for n, (s, i) in enumerate(near[:4], 1)}
    assert {tuple(x) for x in found.select("doc_id", "query_id", "vec_id", "similarity", "rank").collect()} == want
    context = {x.doc_id: x.context for x in retrieval.retrieved_context(chunks, spark.createDataFrame(queries[:1], "doc_id string, vec_id long, embedding array<double>"), 3, 1000).collect()}
    text = {i: t for _, i, _, t in rows}
    best = [i for *_, i, _, n in sorted(((q, n, i, s, n) for d, q, i, s, n in want if (d, q) == ("d1", 0)), key=lambda x: x[1]) if n <= 3]
    assert list(context) == ["d1"] and context["d1"].split("\n") == list(dict.fromkeys(text[i] for i in best))


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_counted_quantiles(spark, bins):
    r = random.Random(bins)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 0.1, 0.5, r.random(), r.gauss(0, 9), 1e300, -1e300])) for _ in range(900)]
    rows += [("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None)]
    got = jobs.counted_quantiles(spark.createDataFrame(rows, "job_id string, v double"), "job_id", "v", {"lo": 0.25, "hi": 0.75, "top": 1.0, "mid": 0.5}, bins)
    held = {}
    for k, v in rows:
        if v is not None:
            held.setdefault(k, []).append(v)
    want = {k: tuple(sorted(v)[int(q * (len(v) - 1))] for q in (0.25, 0.75, 1.0, 0.5)) for k, v in held.items()}
    assert {x.job_id: (x.lo, x.hi, x.top, x.mid) for x in got.collect()} == want


@pytest.mark.parametrize(("least", "rare"), [(0.4, 0), (0.4, 3), (0.7, 2), (0.15, 1), (1.0, 0)])
def test_title_join_equals_all_pairs(spark, least, rare):
    r = random.Random(17)
    words = [f"{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    title = lambda: " ".join(r.choice(words[: r.choice([4, 12, 26])]) for _ in range(r.randrange(0, 11)))
    mine, theirs = [(i, title()) for i in range(150)], [(f"10.1/{i}", title(), r.choice(["crossref", "openalex", None])) for i in range(200)]
    got = papers.best_registry_match(spark.createDataFrame(mine, "doc_id long, title string"), spark.createDataFrame(theirs, "doi string, title string, source string"), least=least, rare=rare)
    want = {}
    for i, t in mine:
        a = set(t.split())
        near = [(-len(a & b) / len(a | b), s != "crossref", d) for d, u, s in theirs if (b := set(u.split())) and a and len(a & b) / len(a | b) >= least]
        if near:
            want[i] = min(near)
    assert {x.doc_id: (round(-x.similarity, 9), x.source != "crossref", x.doi) for x in got.collect()} == {i: (round(s, 9), o, d) for i, (s, o, d) in want.items()}


def test_keys_of_similar_sets_grow_with_the_sets(spark):
    """Random titles over a Zipf vocabulary: what the keys join stays near the number of titles, where single frequent tokens would join far more."""
    joined = []
    for n in (1000, 5000):
        r = np.random.default_rng(5)
        chance = 1 / np.arange(1, 20_001)
        sets = lambda: spark.createDataFrame([(i, [f"{99999 - t:05d}" for t in sorted(set(x.tolist()), reverse=True)]) for i, x in enumerate(r.choice(20_000, (n, 9), p=chance / chance.sum()))], "id long, common array<string>").withColumn("size", F.size("common"))  # noqa: E731, B023
        left, right = sets().persist(), sets().persist()
        keys = [papers.set_keys(a, b.select("size").distinct(), 0.4) for a, b in ((left, right), (right, left))]
        one, two = keys[0].alias("x"), keys[1].alias("y")
        joined.append(one.join(two, F.expr("x.own = y.other AND x.other = y.own AND x.a = y.a AND x.b = y.b")).count())
        left.unpersist(), right.unpersist()
    assert joined[1] < 30 * joined[0] and joined[1] < 5 * 5000


def test_title_cascade(spark):
    pages = spark.createDataFrame(
        [(1, 0, 1, 0, "Seasonal patterns in alpine birds"), (2, 0, 1, 0, "Abstract"), (2, 1, 1, 0, "x"), (3, 0, 1, 0, "Abstract"), (4, 0, 2, 0, "Not on the first page at all")], BLOCKS
    )
    replies = spark.createDataFrame([(1, " A model's own title "), (2, "Title by a model"), (3, "none"), (4, "short")], "doc_id long, title_reply string")
    titles = lambda *a: {r.doc_id: (r.title, r.title_source) for r in papers.record_titles(pages, *a).collect()}
    own = ("Seasonal patterns in alpine birds", "heuristic")
    assert titles() | {4: None} == {1: own, 2: (None, None), 3: (None, None), 4: None}
    assert titles(replies) | {4: None} == {1: own, 2: ("Title by a model", "llm"), 3: (None, None), 4: None}
    assert titles(replies, True) | {4: None} == {1: ("A model's own title", "llm"), 2: ("Title by a model", "llm"), 3: (None, None), 4: None}
    looked = papers.record_titles(blocks(spark, "Received 5 May by the editorial office: keywords", "Birds of the high alpine plains."))
    assert looked.first().title_source == "heuristic"


def test_a_bad_file_rejects_its_whole_call(spark):
    rows = [("a", 0, "a.pdf", b"%PDF-1"), ("a", 1, "b.pdf", b"plain"), ("a", 2, "c.txt", b"%PDF-1"), ("b", 0, "d.pdf", b"%PDF-1"), ("b", 1, "e.PDF", b"%PDF-2"), (None, 0, "f", b"")]
    found = spark.createDataFrame([(c, p, n, len(b), bytearray(b)) for c, p, n, b in rows], "call_id string, place int, filename string, size_bytes long, content binary")
    got = {r.filename: (r.reject, r.call_reject and (r.call_reject.filename, r.call_reject.reason), r.queued, r.stored) for r in files.gate_calls(found).collect()}
    bad = ("b.pdf", "content")
    assert got == {
        "a.pdf": (None, bad, False, True), "b.pdf": ("content", bad, False, False), "c.txt": ("extension", bad, False, False),
        "d.pdf": (None, None, True, True), "e.PDF": (None, None, True, True), "f": ("extension", ("f", "extension"), False, False),
    }


def test_pages_from_an_iso_time(spark):
    logs = spark.createDataFrame([(1, i, datetime.datetime(2024, 1, 1, i)) for i in range(5)], "job_id int, log_id long, ts timestamp_ntz")
    ids = lambda *a, **k: [r.log_id for r in jobs.log_page(logs, after=a, **k).collect()]
    assert ids("2024-01-01T04:00:00+02:00") == [2, 3, 4] and ids("2024-01-01T02:00:00Z", 2) == [3, 4] and ids("2024-01-01 02:00") == [2, 3, 4]
    assert ids("2024-01-01T02:00:00", 2, descending=True) == [1, 0]
    with pytest.raises(ValueError):
        jobs.since("yesterday")


def test_chat_with_a_system_text_and_a_named_client(spark):
    contexts = spark.createDataFrame([(1, "data", 1, "Data are here"), (1, "code", 1, "Code is there"), (2, "data", 1, "x")], "doc_id long, kind string, rank int, text string")
    messages = answers.build_messages(contexts)
    whole = {r.doc_id: r.prompt for r in answers.build_prompt(contexts).collect()}
    assert {r.doc_id: f"{r.system}\n{r.prompt}" for r in messages.collect()} == whole
    services.register_client("echo", lambda mark: lambda system, prompt: f"{mark}{len(system)}:{prompt}")
    got = {r.doc_id: r.reply for r in services.ask(messages, services.chat_client("echo", mark="#")).collect()}
    assert got == {i: f"#{len(chr(10).join(answers.RULES))}:{p.split(chr(10), len(answers.RULES))[-1]}" for i, p in whole.items()}
    with pytest.raises(KeyError):
        services.chat_client("unknown")


def test_what_states_availability_passes_the_cheap_test(spark):
    import itertools

    from scholarlake.functions import records as R

    said = {
        "data": ("code and raw data", "DATASETS", "Supplementary  materials", "materials", "open data"),
        "code": ("Code", "softWARE", "scripts", "Analysis", "notebook", "pipeline", "source code"),
    }
    verbs = ("available", "ACCESSIBLE", "deposited", "provided", "shared", "request", "archived", "badge", "repository", "GitHub", "gitlab", "bitbucket")
    for kind, subjects in said.items():
        rows = spark.createDataFrame([(f"The {s} {gap} {v}.",) for s, v, gap in itertools.product(subjects, verbs, ("are", "were (of all)\n", "."))], "t string")
        found = rows.select(R.states_availability("t", kind).alias("states"), R.may_state(F.lower("t"), kind).alias("may")).collect()
        assert any(r.states for r in found) and all(r.may for r in found if r.states)


def test_paragraphs_are_worked_out_once(spark):
    blocks = spark.createDataFrame([(1, 0, 1, 0, "Data availability: all  data\nare available at https://zenodo.org/record/1.\n\nMore \t text")], "doc_id long, seq int, page int, col int, text string")
    links = papers.paper_links(papers.grouped_contexts(papers.segment(blocks)))
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "size(" in x]
    assert [r.url for r in links.collect() if r.kind == "data"] == ["https://zenodo.org/record/1"]
    assert [r.text for r in papers.segment(blocks).orderBy("idx").collect()] == ["Data availability:", "all data are available at https://zenodo.org/record/1.", "More text"]


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_titles_of_records_are_worked_out_once(spark):
    registry = spark.createDataFrame([("10.1/a", "Seasonal patterns in alpine birds", "crossref")], "doi string, title string, source string")
    rows = papers.paper_records(blocks(spark, "Seasonal patterns in alpine birds", "No identifier"), registry)
    assert papers.RESOLVER_STOPWORDS[0] + "|" not in _plan(rows)
    assert [(r.title, r.doi) for r in rows.collect()] == [("Seasonal patterns in alpine birds", "10.1/a")]


def test_points_of_both_kinds_share_their_searches(spark):
    page = ["Data availability", "The dataset is available upon request, see orcid.org and x.com", "Code availability: all scripts are on github", "plain"]
    rows = papers.rank_contexts(papers.segment(blocks(spark, *page)))
    assert _plan(rows).count("orcid.org") == 1
    got = {(r.kind, r.idx): r.points for r in rows.collect()}
    assert got[("data", 0)] == 64 and got[("data", 1)] == 22 + 14 * 2 + 12 + 5 - 15
