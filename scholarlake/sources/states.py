"""Latest states as a snapshot and the deltas since: a batch of events is folded once, and the log of all events is not read again.

Layout below a path: delta/batch=N has one row for each key of batch N; snapshot/upto=N/bucket=B has the merged rows of
a bucket of keys up to batch N. A compaction rewrites only the buckets that the deltas touch. Folders count once Spark
has marked them as complete, and a batch that is handed in again overwrites its delta, so a failure at any point leaves
the states as they were or as they should be.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DONE = "_SUCCESS"


@dataclass(frozen=True)
class States:
    """States of `key` in events (key, state, *order, *first): the last in `order`, or the first of those in `final`.

    Of the columns in `first` the earliest value that is not null is kept."""

    path: str
    key: str
    state: str
    order: tuple[str, ...] = ("ts", "log_id")
    final: tuple[str, ...] = ()
    first: tuple[str, ...] = ()
    buckets: int = 64
    compact_every: int = 16

    def advance(self, events: DataFrame, batch: int) -> None:
        """Adds the events of a batch; batches are numbered upwards, and one that comes again replaces itself."""
        if batch <= self._upto(events.sparkSession):
            return  # merged already
        self._folded(events).write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")
        if len(self._deltas(events.sparkSession)) >= self.compact_every:
            self.compact(events.sparkSession)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """key, state, at (the largest of the first order column), events and the `first` columns; None before the first batch."""
        parts = [f"{self.path}/delta/batch={n}" for n in self._deltas(spark)]
        held = self._snapshot(spark)
        rows = [spark.read.parquet(*parts)] if parts else []
        rows += [spark.read.parquet(*held)] if held else []
        if not rows:
            return None
        merged = self._merged(rows[0].unionByName(rows[1]) if len(rows) > 1 else rows[0]) if parts else rows[0]
        return merged.select(self.key, F.coalesce(F.col("ended.state"), F.col("last.state")).alias(self.state), F.col("at"), F.col("events"), *(F.col(f"first_{c}.value").alias(c) for c in self.first))

    def compact(self, spark: SparkSession) -> None:
        """Merges the deltas into the buckets that they touch."""
        batches = self._deltas(spark)
        if not batches:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).alias("bucket")
        deltas = spark.read.parquet(*(f"{self.path}/delta/batch={n}" for n in batches))
        touched = {r.bucket for r in deltas.select(bucket).distinct().collect()}  # at most `buckets` rows
        held = [p for p in self._snapshot(spark) if int(p.rpartition("=")[2]) in touched]
        rows = deltas.unionByName(spark.read.parquet(*held)) if held else deltas
        self._merged(rows).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/snapshot/upto={batches[-1]}")

    def vacuum(self, spark: SparkSession) -> None:
        """Removes deltas and buckets that a later compaction holds; not while others read."""
        upto, used = self._upto(spark), set(self._snapshot(spark))
        fs, where = file_system(spark, self.path)
        for n in _numbers(spark, f"{self.path}/delta", "batch"):
            if n <= upto:
                fs.delete(where(f"{self.path}/delta/batch={n}"), True)
        for n in _numbers(spark, f"{self.path}/snapshot", "upto"):
            for b in _numbers(spark, f"{self.path}/snapshot/upto={n}", "bucket"):
                path = f"{self.path}/snapshot/upto={n}/bucket={b}"
                if path not in used:
                    fs.delete(where(path), True)

    def _folded(self, events: DataFrame) -> DataFrame:
        place = F.struct(*(F.col(c).alias(f"p{i}") for i, c in enumerate(self.order)))
        now = F.struct(place.alias("place"), F.col(self.state).alias("state"))
        ends = F.min(F.when(F.col(self.state).isin(*self.final), now)) if self.final else F.max(F.when(F.lit(False), now))
        firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(place.alias("place"), F.col(c).alias("value")))).alias(f"first_{c}") for c in self.first]
        return events.groupBy(self.key).agg(F.max(now).alias("last"), ends.alias("ended"), F.max(self.order[0]).alias("at"), F.count(F.lit(1)).alias("events"), *firsts)

    def _merged(self, rows: DataFrame) -> DataFrame:
        firsts = [F.min(f"first_{c}").alias(f"first_{c}") for c in self.first]
        return rows.groupBy(self.key).agg(F.max("last").alias("last"), F.min("ended").alias("ended"), F.max("at").alias("at"), F.sum("events").alias("events"), *firsts)

    def _upto(self, spark: SparkSession) -> int:
        return max(_numbers(spark, f"{self.path}/snapshot", "upto", complete=True), default=-1)

    def _deltas(self, spark: SparkSession) -> list[int]:
        upto = self._upto(spark)
        return [n for n in _numbers(spark, f"{self.path}/delta", "batch", complete=True) if n > upto]

    def _snapshot(self, spark: SparkSession) -> list[str]:
        """The latest folder of each bucket."""
        held: dict[int, str] = {}
        for n in _numbers(spark, f"{self.path}/snapshot", "upto", complete=True):
            held |= {b: f"{self.path}/snapshot/upto={n}/bucket={b}" for b in _numbers(spark, f"{self.path}/snapshot/upto={n}", "bucket")}
        return list(held.values())


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the session's shared one (spark.checkpoint.dir); on a local master without one, below /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or '/tmp/checkpoints/scholarlake').rstrip('/')}/{what}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The file system that holds path, and the constructor of its paths."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path
    return where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str, name: str, complete: bool = False) -> list[int]:
    """N of the folders name=N below path, in order."""
    fs, where = file_system(spark, path)
    if not fs.exists(where(path)):
        return []
    found = [str(x.getPath().getName()) for x in fs.listStatus(where(path))]
    return sorted(int(x.partition("=")[2]) for x in found if x.startswith(f"{name}=") and (not complete or fs.exists(where(f"{path}/{x}/{_DONE}"))))
