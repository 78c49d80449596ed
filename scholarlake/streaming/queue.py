"""The job queue as a stateful stream: documents wait in state until their job runs, jobs run one after another.

Each job is a key of one stateful operator. Its state holds the waiting documents (a list), the job's status, its total
and how many documents were released. Documents of a job that does not run yet stay there; once the job is told to run,
they and all later ones are released, each once. When as many as its total were released, or none waits where no total
is known, the job is done. What a micro-batch releases is analyzed and written in the same batch, in a folder of the
batch's own, so a replayed batch overwrites what it wrote.

Which job runs next is a matter of jobs, not documents: the jobs' states are kept as snapshot and deltas, and after each
batch the oldest pending job is promoted if none runs. The promotion is a row of a folder that the stream reads as well.
Documents without a job count as a job that comes after all others. Documents that come for a job that is done make it
pending again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scholarlake.operators.jobs import CANCELLED
from scholarlake.sources.states import States, file_system
from scholarlake.streaming.worker import ROCKS

#: What goes through the operator: documents with their columns as JSON, and events of jobs.
EVENTS = "kind string, job_id string, created_at timestamp, total long, payload string"
#: The job of documents without one.
NO_JOB = ""
_LAST = pd.Timestamp("2200-01-01")
#: Documents that leave the operator in one frame.
RELEASED_AT_ONCE = 1_000


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["kind", "job_id", "created_at", "total", "payload"])
    return made.astype({"total": "Int64"}).assign(created_at=pd.to_datetime(made.created_at))


class JobGate(StatefulProcessor):
    """Releases the documents of a job once it runs. Input and output rows are EVENTS; kinds out: document (released), cancelled (a document), job kinds as they came, and done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "status string, total long, released long")
        self.waiting = handle.getListState("waiting", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (job_id,) = key
        status, total, released = self.job.get() if self.job.exists() else (None, None, 0)
        out, came = [], 0
        for frame in rows:
            fresh = frame.payload[frame.kind == "document"]
            came += len(fresh)
            if len(fresh):
                self.waiting.appendList([(x,) for x in fresh])
            for event in frame[frame.kind != "document"].itertuples():
                total = int(event.total) if event.total == event.total and event.total is not None else total
                # a job that is being cancelled stays so; one that runs or is done does not wait again on its old event
                if status != "cancelled" and not (event.kind == "pending" and status in ("running", "done")):
                    status = event.kind
                out.append((event.kind, job_id, event.created_at, total, None))
        if status in ("running", "cancelled"):
            kind = "document" if status == "running" else "cancelled"
            held = []
            for (payload,) in self.waiting.get() if self.waiting.exists() else ():
                held.append((kind, job_id, None, None, payload))
                if len(held) == RELEASED_AT_ONCE:
                    released += len(held)
                    yield _frame(held)
                    held = []
            released += len(held)
            out += held
            self.waiting.clear()
            if status == "running" and (total is None or released >= total):
                status = "done"
                out.append(("done", job_id, None, total, None))
        elif came and (status == "done" or status is None and job_id == NO_JOB):
            status = "pending"
            out.append(("pending", job_id, _LAST if job_id == NO_JOB else None, total, None))
        self.job.update((status, total, released))
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def gate(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """EVENTS that come out of the queue, from streams of documents (job_id and more) and of job events (kind, job_id, created_at, total)."""
    none = lambda kind: F.lit(None).cast(kind)
    key = F.coalesce(F.col("job_id").cast("string"), F.lit(NO_JOB)).alias("job_id")
    docs = documents.select(F.lit("document").alias("kind"), key, none("timestamp").alias("created_at"), none("long").alias("total"), F.to_json(F.struct(*documents.columns)).alias("payload"))
    told = jobs.select("kind", key, F.col("created_at").cast("timestamp"), F.col("total").cast("long"), none("string").alias("payload"))
    return docs.unionByName(told).groupBy("job_id").transformWithStateInPandas(JobGate(), EVENTS, "Append", "None")


def job_states(path: str) -> States:
    """Where the queue under `path` keeps the states of its jobs."""
    return States(f"{path}/states", "job_id", "status", order=("batch", "step"), final=("cancelled",), first=("created_at",))


def promoted(states: DataFrame | None) -> DataFrame | None:
    """job_id and created_at of the oldest pending job, if none runs."""
    if states is None:
        return None
    running = states.where("status = 'running'").limit(1).select(F.lit(1).alias("running"))
    oldest = states.where("status = 'pending'").orderBy(F.col("created_at").asc_nulls_last(), "job_id").limit(1)
    return oldest.join(F.broadcast(running), F.lit(True), "left_anti").select("job_id", "created_at")


def run_queue(documents: DataFrame, jobs: DataFrame, analyze: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs the queue over streams of documents and of job events (kind pending, with created_at and total, or cancelled).

    Under `path`: results/ has the documents with job_id, status and error and what analyze adds (it may fill `error`);
    promotions/ and states/ are the queue's own. With once, what is there is worked off; else the query goes on.
    """
    spark = documents.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = "kind string, job_id string, created_at timestamp, total long"
    fs, where = file_system(spark, f"{path}/promotions")
    fs.mkdirs(where(f"{path}/promotions"))
    told = jobs.select("kind", F.col("job_id").cast("string").alias("job_id"), F.col("created_at").cast("timestamp"), F.col("total").cast("long"))
    told = told.unionByName(spark.readStream.schema(kinds).option("recursiveFileLookup", "true").parquet(f"{path}/promotions"))
    schema, states = documents.schema, job_states(path)

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()  # the operator's output is read for documents and for jobs
        try:
            held = rows.where("payload IS NOT NULL").select("kind", F.from_json("payload", schema).alias("d")).select("kind", "d.*")
            done = analyze(held.where("kind = 'document'").drop("kind"))
            done = done if "error" in done.columns else done.withColumn("error", F.lit(None).cast("string"))
            stopped = held.where("kind = 'cancelled'").drop("kind").withColumn("error", F.lit(CANCELLED))
            out = done.unionByName(stopped, allowMissingColumns=True).withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("error"))
            out.write.mode("overwrite").parquet(f"{path}/results/batch_id={number}")
            step = F.when(F.col("kind") == "done", 1).otherwise(0)
            said = rows.where("payload IS NULL")
            said = said.select("job_id", F.col("kind").alias("status"), "created_at", F.lit(number).alias("batch"), step.alias("step"))
            states.advance(said, 2 * number)
            chosen = promoted(states.read(spark))
            told = chosen.select(F.lit("running").alias("kind"), "job_id", "created_at", F.lit(None).cast("long").alias("total")).collect()  # one row at most
            if told:
                next_ = spark.createDataFrame(told, kinds)
                next_.coalesce(1).write.mode("overwrite").parquet(f"{path}/promotions/{number:012d}")
                states.advance(next_.select("job_id", F.col("kind").alias("status"), "created_at", F.lit(number).alias("batch"), F.lit(2).alias("step")), 2 * number + 1)
        finally:
            rows.unpersist()

    query = gate(documents, told).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="500 milliseconds")).start()


def drain(start: Callable[[], StreamingQuery], path: str, spark: SparkSession) -> None:
    """Runs start() (a run_queue() with once) until it promotes no further job."""
    before = -1
    while (now := _promotions(spark, path)) != before:
        before = now
        start().awaitTermination()


def _promotions(spark: SparkSession, path: str) -> int:
    fs, where = file_system(spark, f"{path}/promotions")
    return len(fs.listStatus(where(f"{path}/promotions"))) if fs.exists(where(f"{path}/promotions")) else 0
