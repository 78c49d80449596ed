import datetime
import time

import pytest
from pyspark.sql import functions as F

from scholarlake.streaming import logs as W
from scholarlake.streaming import worker

T0 = datetime.datetime(2024, 1, 1)


def test_timer_expires_documents(spark, tmp_path):
    schema = "doc_id long, status string, ts timestamp"
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    batches = [[(1, "processing", at(0)), (2, "processing", at(0))], [(2, "done", at(10)), (3, "processing", at(800))], [(4, "processing", at(1001))], [(5, "queued", at(1100))]]
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = worker.expired(worker.read_events(spark, source, schema)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
        q.trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "error", "timeout")]


def test_timers_with_events_out_of_order(spark, tmp_path):
    schema = "doc_id long, status string, ts timestamp"
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    batches = [
        [(1, "done", at(20)), (2, "done", at(20)), (2, "processing", at(30)), (3, "processing", at(40))],  # 2: ended, then claimed again
        [(1, "processing", at(10)), (3, "done", at(40))],  # the claim of 1 comes after its end
        [(4, "processing", at(900)), (5, "error", at(900))],
        [(6, "queued", at(2000))],
        [(6, "queued", at(2001))],
    ]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        late = worker.expired(worker.read_events(spark, source, schema), delay="100 seconds")
        q = late.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
        q.trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(2, "error", "timeout"), (4, "error", "timeout")]


@pytest.mark.parametrize("seconds", [1, 600, 0])
def test_cached_records_are_served(spark, tmp_path, seconds):
    schema, asked = "doi string, n int", tmp_path / "asked"
    source = str(tmp_path / "in")

    def lookup(key):
        with asked.open("a") as f:
            f.write(key + "\n")
        return None if key == "10.1/none" else f"record of {key}"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        found = worker.cached_lookups(worker.read_events(spark, source, schema), lookup, seconds)
        query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
        query.trigger(once=True).start().awaitTermination()

    run([(" 10.1/A ", 1), ("10.1/a", 2), ("10.1/none", 3), (None, 4)])
    time.sleep(1.2)
    run([("10.1/a", 5), ("10.1/none", 6)])
    rows = {r.n: (r.doi, r.record, r.hit) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {n: r[1] for n, r in rows.items()} == {n: None if n in (3, 6) else "record of 10.1/a" for n in (1, 2, 3, 5, 6)}
    assert rows[1][0] == " 10.1/A " and not rows[1][2] and rows[5][2] == rows[6][2] == (seconds != 1)
    assert sorted(asked.read_text().split()) == sorted(["10.1/a", "10.1/none"] * (2 if seconds == 1 else 1))


def test_late_documents_expire(spark):
    rows = spark.createDataFrame([(1, "processing", T0, None), (2, "processing", T0 + datetime.timedelta(seconds=900), None), (3, "done", T0, None)], "doc_id int, status string, claimed_at timestamp, error string")
    got = {r.doc_id: (r.status, r.error) for r in worker.expire(rows, T0 + datetime.timedelta(seconds=901)).collect()}
    assert got == {1: ("error", "timeout"), 2: ("processing", None), 3: ("done", None)}


def test_stream_windows_equal_the_table(spark, tmp_path):
    schema = "log_id long, job_id long, ts timestamp, op string, duration_ms long"
    rows = [(i, i % 3, T0 + datetime.timedelta(minutes=7 * i), "ab"[i % 2], i) for i in range(60)]
    table = spark.createDataFrame(rows, schema)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, fn in (("t", W.tumbling), ("s", W.sliding)):
        fn(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, fn(table).collect()))
    assert W.sessions(table, "20 minutes").count() == 60 and W.sessions(table, "22 minutes").count() == 3


def test_lookups_once(spark, tmp_path):
    rows = spark.createDataFrame([(" 10.1/A ", T0), ("10.1/a", T0), ("10.1/b", T0)], "doi string, ts timestamp")
    assert worker.first_lookups(rows).count() == 2
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    worker.first_lookups(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
