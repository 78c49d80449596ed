"""What the operators of this subpackage share: reading, durable intermediates, bounded batches and guarded joins."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on; bounds a Python worker's memory whatever the size of Spark's Arrow batches.
STEP_BYTES = 2 << 20
#: Rows of a batch with whole texts or lists on its way to Python.
WIDE_ROWS = 1_500
#: A side of a join is broadcast only when its counted rows times their bytes stay below this.
BROADCAST_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir); on a local master without one, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "/tmp/checkpoints/scholarlake")
    return "/tmp/checkpoints/scholarlake"


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when this process ends."""
    path = f"{work_dir(spark)}/scholarlake-{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, what: str, arrow_rows: int | None = None) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage and outlives lost executors.

    arrow_rows: at most so many rows in a batch that goes to Python, for wide rows."""
    spark = df.sparkSession
    path = new_path(spark, what)
    with batches_of(spark, arrow_rows):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, arrow_rows: int | None) -> Iterator[None]:
    """Actions inside send at most so many rows in a batch to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if arrow_rows:
        spark.conf.set(key, str(arrow_rows))
    try:
        yield
    finally:
        if arrow_rows:
            spark.conf.set(key, before)


def bucketed(df: DataFrame, what: str, keys: list[str]) -> DataFrame:
    """Like materialize(), in as many hash buckets of `keys` as there are shuffle partitions: joins on these keys move only the other side."""
    spark = df.sparkSession
    path, name = new_path(spark, what), f"scholarlake_{what}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys).write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", path)
    dealt.bucketBy(n, *keys).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name: files at a path of their own stay
    return out


def written() -> int:
    """How many intermediates were written so far."""
    return len(_written)


def drop_written(since: int) -> None:
    """Remove the intermediates written after `since` but for the last, which holds the result."""
    for spark, path in _written[since:-1]:
        remove(spark, path)
    del _written[since:-1]


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column holds about `limit` bytes each; a longer value gets a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, done = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start, done = end, int(ends[end - 1])


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", limit: int = STEP_BYTES) -> DataFrame:
    """mapInArrow with fn over bounded slices; fn may return None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, column, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A broadcast hint if the counted size allows it; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def frequent_from(counts: DataFrame, column: str, most: int) -> int:
    """The least count (in `column`) from which on at most `most` rows are left; counts are told apart on the driver, from the highest on."""
    if counts.count() <= most:
        return 0
    above, least = 0, None
    for row in counts.groupBy(F.col(column).cast("long").alias("n")).count().orderBy(F.desc("n")).limit(most + 1).toLocalIterator():
        above += row["count"]
        if above > most:
            break
        least = row["n"]
    return least if least is not None else row["n"] + 1


def fold(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in `dropped` (doc_id); null ids stay. Broadcast only if counted small."""
    key = unused(docs, "dropped_id")
    keys = small(dropped.select(F.col("doc_id").alias(key)).distinct(), 24)
    return docs.join(keys, docs[id_col].cast("long") == keys[key], "left_anti")
