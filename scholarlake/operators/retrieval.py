"""Chunks, nearest vectors and capped contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.config import DEFAULTS
from scholarlake.functions.text import chunks, recursive_chunks

#: Query vectors of one pass; more are searched in further passes.
QUERY_BLOCK = 2_048
#: Vectors of one key that meet in one task.
KEY_BLOCK = 16_384
#: Scores of one numpy step.
STEP_SCORES = 2_000_000


def chunk_documents(docs: DataFrame, size: int = DEFAULTS.chunk_chars, overlap: int = DEFAULTS.chunk_overlap, recursive: bool = False) -> DataFrame:
    """doc_id, chunk, text: overlapping windows of characters, or chunks that end where paragraphs, lines or words do."""
    cut = recursive_chunks if recursive else chunks
    return docs.where("text <> ''").select("doc_id", F.posexplode(cut("text", size, overlap)).alias("chunk", "text"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each column (a query) the k rows with the largest scores, the smaller id among equals."""
    if len(ids) <= k:
        return ids, scores
    key = np.round(scores, 9)
    key[np.isnan(key)] = -np.inf
    row, query = np.nonzero(key >= np.partition(key, len(key) - k, axis=0)[len(key) - k])
    order = np.lexsort((ids[row, query], -key[row, query], query))
    row, query = row[order], query[order]
    rows = row[np.arange(len(row)) - np.searchsorted(query, query) < k].reshape(ids.shape[1], k).T
    at = np.arange(ids.shape[1])
    return ids[rows, at], scores[rows, at]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k vectors with the largest inner product; ties go to the smaller id.

    A block of queries travels with the tasks; each task multiplies its batches with it and keeps k rows a query, so
    what is shuffled is queries * k * tasks rows, never all pairs.
    """
    found = None
    ids = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).orderBy("query_id")
    n = ids.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    for block in range(blocks):
        part = ids.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect() if n else []
        if not part:
            continue
        names, matrix = [r.query_id for r in part], np.array([r.q for r in part], float).T

        def search(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            n, rows = len(names), max(1, STEP_SCORES // len(names))
            ids, scores = np.empty((0, n), np.int64), np.empty((0, n))
            for batch in batches:
                for start in range(0, batch.num_rows, rows):
                    part = batch.slice(start, rows)
                    vec = part.column("vec_id").to_numpy()
                    found = part.column("embedding").flatten().to_numpy().astype(float).reshape(len(vec), -1) @ matrix
                    ids = np.concatenate([ids, np.broadcast_to(vec[:, None], found.shape)])
                    ids, scores = _best(ids, np.concatenate([scores, found]), k)
            if len(ids):
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.tile(np.array(names, np.int64), len(ids))), "vec_id": pa.array(ids.ravel()), "similarity": pa.array(scores.ravel())})

        rows = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding").mapInArrow(search, "query_id long, vec_id long, similarity double")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best_within(k: int):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("key", queries.schema.field("key").type), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())])
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        rows = lambda t: t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        ids, names, matrix = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy(), rows(queries)
        held = rows(vectors)
        out_ids, scores = np.empty((0, len(names)), np.int64), np.empty((0, len(names)))
        step = max(1, STEP_SCORES // len(names))
        for start in range(0, len(ids), step):
            found = held[start : start + step] @ matrix.T
            part = np.broadcast_to(ids[start : start + step, None], found.shape)
            out_ids, scores = _best(np.concatenate([out_ids, part]), np.concatenate([scores, found]), k)
        key = pa.array([queries["key"][0].as_py()] * scores.size, schema.field("key").type)
        return pa.table([key, pa.array(np.tile(names, len(out_ids))), pa.array(out_ids.ravel()), pa.array(scores.ravel())], schema=schema)

    return search


def nearest_within(vectors: DataFrame, queries: DataFrame, k: int = 4, key: str = "doc_id") -> DataFrame:
    """key, query_id, vec_id, similarity, rank: for each query (its own key, vec_id, embedding) the k vectors of the same key with
    the largest inner product; ties go to the smaller id. Null keys and null embeddings take no part.

    The vectors and queries of a key meet in blocks of bounded size, so a key with very many of them is shared among tasks;
    each block keeps k rows a query. Vectors of a key are of one length.
    """
    wide = lambda rows: rows.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(F.col(key).alias("key"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = wide(queries).withColumnRenamed("vec_id", "query_id")
    held = wide(vectors).join(asked.select("key").distinct(), "key", "left_semi")  # keys without a query are done
    blocks = lambda rows, size, name: rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    plan = blocks(held, KEY_BLOCK, "v").join(blocks(asked, QUERY_BLOCK, "q"), "key")

    def dealt(rows: DataFrame, own: str, other: str, name: str) -> DataFrame:
        placed = rows.join(plan, "key").withColumn(f"at_{own}", F.pmod(F.xxhash64(name), F.col(own)).cast("int"))
        return placed.withColumn(f"at_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("v", "q")

    keys = ("key", "at_v", "at_q")
    both = dealt(held, "v", "q", "vec_id").groupBy(*keys).cogroup(dealt(asked, "q", "v", "query_id").groupBy(*keys))
    found = both.applyInArrow(_best_within(k), f"key {dict(held.dtypes)['key']}, query_id long, vec_id long, similarity double")
    order = Window.partitionBy("key", "query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("key", key)


def retrieved_context(chunks: DataFrame, queries: DataFrame, k: int, max_chars: int) -> DataFrame:
    """doc_id, context: of each document's chunks (doc_id, vec_id, text, embedding) those that any of its queries finds, nearest
    first, as one text of at most max_chars."""
    found = nearest_within(chunks, queries, k).groupBy("doc_id", "vec_id").agg(F.min(F.struct("rank", (-F.col("similarity")).alias("minus"), "query_id")).alias("ord"))
    return capped_context(found.join(chunks.select("doc_id", "vec_id", "text"), ["doc_id", "vec_id"]).select("doc_id", "ord", "text"), max_chars)


def capped_context(rows: DataFrame, max_chars: int) -> DataFrame:
    """doc_id, context: distinct texts (doc_id, ord, text) in order, joined by line feeds, stopping once max_chars is reached and cut there."""
    first = rows.groupBy("doc_id", "text").agg(F.min("ord").alias("ord"))
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = first.withColumn("before", before).where(F.col("before") < max_chars)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return taken.groupBy("doc_id").agg(F.substring(joined, 1, max_chars).alias("context"))
