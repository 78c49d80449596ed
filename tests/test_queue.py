import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

from scholarlake.operators import jobs as J
from scholarlake.sources.states import States
from scholarlake.streaming import queue as Q
from scholarlake.streaming import worker

T0 = datetime.datetime(2024, 1, 1)
DOCS = "doc_id long, job_id string, text string, pages array<int>"
JOBS = "kind string, job_id string, created_at timestamp, total long"


class Desk:
    """A queue under a folder; each run() is a new query over what has come, as after a restart."""

    def __init__(self, spark, path):
        self.spark, self.path, self.batches = spark, str(path), []
        for name, schema in (("docs", DOCS), ("jobs", JOBS)):
            spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}")

    def put(self, name, rows):
        rows = [(*r, [1, 2]) for r in rows] if name == "docs" else rows
        self.spark.createDataFrame(rows, DOCS if name == "docs" else JOBS).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def analyze(self, docs):
        return docs.withColumn("n", F.length("text")).withColumn("error", F.when(F.col("text") == "bad", "failed"))

    def start(self):
        read = lambda name, schema: worker.read_events(self.spark, f"{self.path}/{name}", schema)
        return Q.run_queue(read("docs", DOCS), read("jobs", JOBS), self.analyze, f"{self.path}/q", f"{self.path}/ck")

    def run(self):
        Q.drain(self.start, f"{self.path}/q", self.spark)

    def results(self):
        return sorted(((r.doc_id, r.status, r.error) for r in self.spark.read.parquet(f"{self.path}/q/results").collect()), key=str)

    def order(self):
        rows = self.spark.read.parquet(f"{self.path}/q/results").groupBy("job_id").agg(F.min("batch_id").alias("b")).orderBy("b")
        return [r.job_id for r in rows.collect()]

    def states(self):
        return {r.job_id: r.status for r in Q.job_states(f"{self.path}/q").read(self.spark).collect()}


@pytest.fixture
def desk(spark, tmp_path):
    return Desk(spark, tmp_path)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_two_jobs_oldest_first_and_no_document_is_lost(desk):
    desk.put("docs", [(2, "late", "b"), (1, "early", "a")])
    desk.put("jobs", [("pending", "late", at(5), 2), ("pending", "early", at(1), 2)])
    desk.run()
    assert desk.results() == [(1, "done", None)] and desk.states() == {"early": "running", "late": "pending"}
    desk.put("docs", [(3, "late", "bad")])  # while its job is pending
    desk.run()
    assert desk.results() == [(1, "done", None)]
    desk.put("docs", [(4, "early", "d")])
    desk.run()
    assert desk.results() == [(1, "done", None), (2, "done", None), (3, "error", "failed"), (4, "done", None)]
    assert desk.order() == ["early", "late"] and desk.states() == {"early": "done", "late": "done"}
    row = desk.spark.read.parquet(f"{desk.path}/q/results").where("doc_id = 2").first()
    assert (row.text, row.n, row.pages) == ("b", 1, [1, 2])
    assert {r.job_id: r.current for r in worker.progress(desk.spark.read.parquet(f"{desk.path}/q/results")).collect()} == {"early": 2, "late": 2}


def test_documents_before_their_job_and_without_one(desk):
    desk.put("docs", [(1, "a", "x"), (9, None, "free")])
    desk.run()
    assert desk.results() == [(9, "done", None)]  # no job waits or runs
    desk.put("docs", [(8, None, "free")])
    desk.put("jobs", [("pending", "a", at(0), 2)])
    desk.run()
    assert desk.results() == [(1, "done", None), (9, "done", None)]  # the job runs and waits for its second document
    desk.put("docs", [(2, "a", "y")])
    desk.run()
    assert [r[0] for r in desk.results()] == [1, 2, 8, 9]


def test_a_job_without_total_ends_when_none_waits_and_wakes_up_again(desk):
    desk.put("docs", [(1, "a", "x")])
    desk.put("jobs", [("pending", "a", at(0), None), ("pending", "empty", at(1), 0)])
    desk.run()
    assert desk.states() == {"a": "done", "empty": "done"}
    desk.put("docs", [(2, "a", "y")])
    desk.run()
    assert [r[0] for r in desk.results()] == [1, 2] and desk.states()["a"] == "done"


def test_more_documents_than_a_frame(desk):
    desk.put("docs", [(i, "a", "x") for i in range(2 * Q.RELEASED_AT_ONCE + 7)])
    desk.put("jobs", [("pending", "a", at(0), 2 * Q.RELEASED_AT_ONCE + 7)])
    desk.run()
    assert [r[0] for r in sorted(desk.results())] == list(range(2 * Q.RELEASED_AT_ONCE + 7)) and desk.states() == {"a": "done"}


def test_cancelled_documents_are_errors(desk):
    desk.put("docs", [(1, "a", "x"), (2, "b", "y"), (3, "b", "z")])
    desk.put("jobs", [("pending", "a", at(0), 2), ("pending", "b", at(1), 2)])
    desk.run()
    desk.put("jobs", [("cancelled", "b", at(2), None)])
    desk.run()
    assert desk.results() == [(1, "done", None), (2, "error", J.CANCELLED), (3, "error", J.CANCELLED)]
    desk.put("docs", [(4, "b", "late"), (5, "a", "last")])
    desk.run()
    assert desk.results()[3:] == [(4, "error", J.CANCELLED), (5, "done", None)] and desk.states() == {"a": "done", "b": "cancelled"}


def test_a_batch_that_was_not_committed_is_replayed_once(desk):
    desk.put("docs", [(1, "a", "x"), (2, "b", "y")])
    desk.put("jobs", [("pending", "a", at(0), 1), ("pending", "b", at(1), 1)])
    desk.start().awaitTermination()  # promotes a
    desk.start().awaitTermination()  # releases it, promotes b
    last = max(int(p.name) for p in __import__("pathlib").Path(f"{desk.path}/ck/commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        shutil.os.remove(f"{desk.path}/ck/commits/{name}")  # as if the driver was lost before the commit
    desk.run()
    assert desk.results() == [(1, "done", None), (2, "done", None)] and desk.order() == ["a", "b"]


def events_of(seed, n, first=0):
    r = random.Random(seed)
    return [(f"k{r.randrange(40)}", r.choice(["queued", "running", "done", "cancelled"]), T0 + datetime.timedelta(seconds=r.randrange(500)), first + i, r.choice([None, r.randrange(9)])) for i in range(n)]


LOG = "job_id string, op string, ts timestamp, log_id long, v int"


@pytest.mark.parametrize("final", [(), ("cancelled",)])
def test_snapshot_and_deltas_equal_the_fold_of_the_whole_log(spark, tmp_path, final):
    states = States(str(tmp_path / "s"), "job_id", "op", final=final, first=("v",), buckets=4, compact_every=3)
    log = []
    for batch in range(8):
        new = events_of(batch, 30, first=100 * batch)
        log += new
        rows = spark.createDataFrame(new, LOG)
        states.advance(rows, batch)
        if batch % 3 == 1:
            states.advance(rows, batch)  # replayed
        whole = spark.createDataFrame(log, LOG)
        want = J.fold_states(whole, "job_id", "op", final=final)
        got = states.read(spark)
        assert sorted(map(tuple, got.drop("v").collect())) == sorted(map(tuple, want.collect()))
        first = {r.job_id: r.v for r in whole.where("v IS NOT NULL").groupBy("job_id").agg(F.min_by("v", F.struct("ts", "log_id")).alias("v")).collect()}
        assert {r.job_id: r.v for r in got.collect() if r.v is not None} == first
    files = got.inputFiles()
    assert any("/snapshot/" in f for f in files) and not any(f"/delta/batch={n}/" in f for f in files for n in range(6))  # merged deltas are not read again
    before = sorted(map(tuple, got.collect()))
    states.vacuum(spark)
    assert sorted(map(tuple, states.read(spark).collect())) == before


def test_a_compaction_rewrites_only_touched_buckets(spark, tmp_path):
    states = States(str(tmp_path / "s"), "job_id", "op", buckets=16, compact_every=100)
    states.advance(spark.createDataFrame(events_of(1, 200), LOG), 0)
    states.compact(spark)
    states.advance(spark.createDataFrame([("k1", "done", T0, 9999, None)], LOG), 1)
    states.compact(spark)
    assert len(list((tmp_path / "s" / "snapshot" / "upto=1").glob("bucket=*"))) == 1
    assert len(list((tmp_path / "s" / "snapshot" / "upto=0").glob("bucket=*"))) > 5
    assert states.read(spark).count() == len({k for k, *_ in events_of(1, 200)} | {"k1"})


def test_an_unfinished_compaction_does_not_count(spark, tmp_path):
    states = States(str(tmp_path / "s"), "job_id", "op", compact_every=100)
    assert states.read(spark) is None
    states.advance(spark.createDataFrame(events_of(1, 50), LOG), 0)
    before = sorted(map(tuple, states.read(spark).collect()))
    states.compact(spark)
    (tmp_path / "s" / "snapshot" / "upto=0" / "_SUCCESS").unlink()
    assert sorted(map(tuple, states.read(spark).collect())) == before
