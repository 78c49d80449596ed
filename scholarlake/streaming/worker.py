"""Around the queue (scholarlake.streaming.queue): late documents become errors, progress is a running count, lookups are cached."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholarlake.config import DEFAULTS
from scholarlake.operators.jobs import FINISHED, promote

TIMEOUT = "timeout"
#: List state and time to live need this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Documents or logs appended as Parquet files."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(path)


def expire(docs: DataFrame, now, seconds: int = DEFAULTS.document_timeout_seconds) -> DataFrame:
    """Documents in processing for longer than the limit become errors; progress counts them as finished."""
    late = (F.col("status") == "processing") & (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("claimed_at").cast("timestamp")) > seconds * 1_000_000)
    return docs.withColumns({"error": F.when(late, TIMEOUT).otherwise(F.col("error")), "status": F.when(late, "error").otherwise(F.col("status"))})


def expired(events: DataFrame, seconds: int = DEFAULTS.document_timeout_seconds, delay: str = "0 seconds") -> DataFrame:
    """A stream of doc_id, status and error: documents of a stream of events (doc_id, status, ts) that were `processing` for longer
    than the limit without an end. A timer in each document's state fires when event time passes the limit.

    The state has the latest claim and the latest end by event time, so events may come in any order within the delay: an end
    that comes before its claim is remembered until the watermark has passed it by the limit, and a claim after an end (a
    rerun) is watched, also when both come in one batch. An end at the time of the claim ends it."""

    def watch(key, frames, state: GroupState):
        claimed, ended = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            state.remove()
            if claimed is not None and (ended is None or claimed > ended):
                yield pd.DataFrame({"doc_id": [key[0]], "status": ["error"], "error": [TIMEOUT]})
            return
        at = lambda ts: int(pd.Timestamp(ts).tz_localize(None).value // 1_000_000)
        for frame in frames:
            for is_end, wanted in ((False, ("processing",)), (True, FINISHED)):
                times = frame.ts[frame.status.isin(wanted)]
                if len(times):
                    last = max((claimed, ended)[is_end] or 0, at(times.max()))
                    claimed, ended = (claimed, last) if is_end else (last, ended)
        if claimed is None and ended is None:
            return
        state.update((claimed, ended))
        open_ = claimed is not None and (ended is None or claimed > ended)
        state.setTimeoutTimestamp(max((claimed if open_ else ended) + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    kind = dict(events.dtypes)["doc_id"]
    rows = events.select("doc_id", "status", "ts").withWatermark("ts", delay).groupBy("doc_id")
    return rows.applyInPandasWithState(watch, f"doc_id {kind}, status string, error string", "claimed long, ended long", "append", GroupStateTimeout.EventTimeTimeout)


def progress(results: DataFrame) -> DataFrame:
    """Running finished counts of each job, for update mode."""
    return results.where(F.col("status").isin(*FINISHED)).groupBy("job_id").agg(F.count(F.lit(1)).alias("current"))


def next_job(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """The job that becomes running now, if any."""
    return promote(jobs, docs)


def first_lookups(dois: DataFrame, seconds: int = DEFAULTS.cache_seconds) -> DataFrame:
    """DOIs to look up: each key once while it is cached. Needs doi and, for a stream, ts."""
    keyed = dois.withColumn("key", F.lower(F.trim("doi")))
    if dois.isStreaming:
        return keyed.withWatermark("ts", f"{seconds} seconds").dropDuplicatesWithinWatermark(["key"])
    return keyed.dropDuplicates(["key"])


class RecordCache(StatefulProcessor):
    """Keeps the record of a DOI for ttl_ms; rows of a key in one batch share one lookup."""

    def __init__(self, lookup: Callable[[str], str | None], ttl_ms: int | None):
        self.lookup, self.ttl_ms = lookup, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("record", "record string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hit = self.held.exists()
        record = self.held.get()[0] if hit else self.lookup(key[0])
        if not hit:
            self.held.update((record,))
        for frame in rows:
            n = len(frame)
            yield pd.DataFrame({"key": [key[0]] * n, "payload": frame.payload, "record": [record] * n, "hit": [hit] * n})

    def close(self) -> None:
        pass


def cached_lookups(dois: DataFrame, lookup: Callable[[str], str | None], seconds: int = DEFAULTS.cache_seconds) -> DataFrame:
    """A stream's rows with the record that lookup(key) gives for their doi, and whether it was a hit: every row gets a record,
    but a key is looked up once while it is cached, also if it was found to have none (null). 0 seconds or less: forever.
    With a limit, time goes by in batches without data too: run it with a processing-time trigger, not with availableNow."""
    dois.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = dois.select(F.lower(F.trim("doi")).alias("key"), F.to_json(F.struct(*dois.columns)).alias("payload")).where("key IS NOT NULL")
    cache = RecordCache(lookup, seconds * 1000 if seconds > 0 else None)
    found = keyed.groupBy("key").transformWithStateInPandas(cache, "key string, payload string, record string, hit boolean", "Append", "ProcessingTime" if seconds > 0 else "None")
    return found.select(F.from_json("payload", dois.schema).alias("d"), "key", "record", "hit").select("d.*", "key", "record", "hit")
