import datetime
import hashlib

import pytest

from scholarlake.functions import records as R
from scholarlake.sources import store

NOW = datetime.datetime(2024, 3, 1, 12, 0, 0)


def test_files_keep_bytes_and_metadata(spark, tmp_path):
    out = str(tmp_path / "files")
    store.put_files(spark.createDataFrame([("a.pdf", bytearray(b"%PDF-1")), ("b.pdf", None)], "filename string, content binary"), out)
    store.put_files(spark.createDataFrame([("c.txt", "text/plain", bytearray(b""))], "filename string, content_type string, content binary"), out)
    rows = {r.filename: r for r in spark.read.parquet(out).collect()}
    assert bytes(rows["a.pdf"].content) == b"%PDF-1" and rows["a.pdf"].sha256 == rows["a.pdf"].doc_id == hashlib.sha256(b"%PDF-1").hexdigest()
    assert (rows["a.pdf"].size_bytes, rows["a.pdf"].content_type) == (6, "application/pdf")
    assert (rows["c.txt"].size_bytes, rows["c.txt"].content_type) == (0, "text/plain") and rows["b.pdf"].sha256 is None


def test_rows_have_the_defaults_of_their_table(spark, tmp_path):
    docs, jobs, logs = (str(tmp_path / x) for x in ("docs", "jobs", "logs"))
    store.add_documents(spark.createDataFrame([("d", "j", None), ("e", None, "queued")], "doc_id string, job_id string, status string"), docs, NOW)
    assert [(r.doc_id, r.status, r.error, r.created_at) for r in spark.read.parquet(docs).orderBy("doc_id").collect()] == [("d", "uploaded", None, NOW), ("e", "queued", None, NOW)]
    store.add_jobs(spark.createDataFrame([("j", 3)], "job_id string, total int"), jobs, NOW)
    store.add_jobs(spark.createDataFrame([("k",)], "job_id string"), jobs, NOW)
    got = spark.read.parquet(jobs).orderBy("job_id").collect()
    assert [(r.job_id, r.status, r.progress.current, r.progress.total, r.started_at) for r in got] == [("j", "pending", 0, 3, None), ("k", "pending", 0, 0, None)]
    store.add_logs(spark.createDataFrame([("j", "", None, 0), ("j", "parse", "error", None)], "job_id string, op string, level string, duration_ms long"), logs, NOW)
    assert sorted(((r.op, r.level, r.duration_ms, r.ts) for r in spark.read.parquet(logs).collect()), key=str) == sorted([(None, "info", 0, NOW), ("parse", "error", None, NOW)], key=str)


def test_timing_line_also_on_failure():
    lines = []
    with pytest.raises(ValueError), store.timing("parse", lines.append, doc="d"):
        raise ValueError
    assert len(lines) == 1 and lines[0].startswith("doc=d op=parse duration_ms=")


def test_model_names(spark):
    rows = spark.createDataFrame([("m",), ("m:latest",), ("mm",), ("x:m",), ("",), (None,)], "name string")
    assert [r.ok for r in rows.select(R.serves_model("name", "m").alias("ok")).collect()] == [True, True, False, False, False, False]
