"""Approximate nearest neighbours by a permutation index, nearness being the largest inner product.

A bounded sample of PIVOTS vectors orders the space: each vector is represented by the order of its nearest ORDERED
pivots, and posted in the inverted files of its POSTED nearest ones. Vectors get one more component that makes all norms
the largest one (queries a zero), so the nearest pivot is also the one with the largest inner product. A query visits the
files of its PROBED nearest pivots; in each file, entries are ranked by footrule distance between the two orders, the
best SHARE of them (LEAST at least) are reranked by their inner product, and the results of all files meet by query.
Files are cut into blocks of bounded size, and so are the queries that visit one; equal vectors are one entry, which
stands for its k + 1 smallest ids (a query needs no more of them). A query that found fewer than k visits all files.

All parameters are shares or lengths that hold at every size. What is sampled are the pivots alone; every row is posted.

Defined cases: a row takes no part if its id is null, or its vector is null, empty, zero, or holds null or non-finite
components; vectors meet only those of their own length; rows that repeat id and vector count once; a row is not its own
neighbour, nor are other rows with its id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.llm.common import materialize, small, table

#: The sample that the index is fitted on.
PIVOTS = 128
#: Inverted files that hold a vector, and those that a query visits.
POSTED, PROBED = 4, 40
#: Pivots in a vector's order.
ORDERED = 32
#: Of a file's entries, the share with the least footrule distance that is reranked, and how many at least.
SHARE, LEAST = 0.35, 80
#: Entries and queries of one block of a file.
FILE_BLOCK, QUERY_BLOCK = 4_096, 2_048
#: Pairs of one numpy step.
STEP_PAIRS = 1_000_000
#: Reranked entries kept beyond k, so that sums that differ in their last digits lose no neighbour.
SPARE = 5
RESULT = "query_id long, rank int, vec_id long, score double"


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, key, vec: rows that take part, each once; key is the digest of the vector."""
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double") + 0.0)  # negative zero becomes zero
    held = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    whole = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("vec", lambda x: F.coalesce(x != 0, F.lit(False)))
    held = held.where(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False)))
    keyed = held.withColumn("key", F.unhex(F.sha2(F.col("vec").cast("string").cast("binary"), 256)))
    return keyed.groupBy("id", "key").agg(F.any_value("vec").alias("vec"))


def _orders(vectors: DataFrame, pivots: np.ndarray, longest: float, is_query: bool) -> DataFrame:
    """vectors with perm: their nearest pivots, nearest first."""
    lift = np.sqrt(np.maximum(longest - (pivots**2).sum(1), 0.0))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 8_192):
                part = batch.slice(start, 8_192)
                vec = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                near = vec @ pivots.T
                if not is_query:
                    near += np.sqrt(np.maximum(longest - (vec**2).sum(1), 0.0))[:, None] * lift
                perm = np.argsort(-near, axis=1, kind="stable").astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(perm) + 1) * perm.shape[1], pa.int32()), pa.array(perm.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "perm"])

    ddl = ", ".join(f"{c} {kind}" for c, kind in vectors.dtypes)
    return vectors.mapInArrow(run, f"{ddl}, perm array<smallint>")


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _weights(perm: np.ndarray, pivots: int) -> np.ndarray:
    """For each pivot (row) how far before the end of the order it stands in each vector's, 0 if it is not in it."""
    n, length = perm.shape
    out = np.zeros((n, pivots), np.uint16)
    np.put_along_axis(out, perm.astype(np.int64), np.arange(length, 0, -1, dtype=np.uint16)[None, :].repeat(n, 0), 1)
    return np.ascontiguousarray(out.T)


def _best_of_file(k: int, pivots: int, share: float, least: int):
    """Of a block of a file and a block of its queries: qno, no, vid, near of the k + SPARE nearest reranked entries of each query."""

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return pa.table({"qno": pa.array([], pa.int64()), "no": pa.array([], pa.int64()), "vid": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
        entries = entries.sort_by([("vid", "ascending"), ("no", "ascending")])
        no, vid, vec = entries["no"].to_numpy(), entries["vid"].to_numpy(), _lists(entries["vec"])
        qno, qvec = queries["qno"].to_numpy(), _lists(queries["vec"])
        n, taken = len(no), min(len(no), max(least, int(np.ceil(share * len(no)))))
        held = _weights(_lists(entries["perm"]), pivots)
        asked = _weights(_lists(queries["perm"]), pivots)
        out = []
        step = max(1, STEP_PAIRS // n)
        for start in range(0, len(qno), step):
            block = asked[:, start : start + step]
            if taken < n:
                # orders of equal length: footrule distance = constant - 2 * sum over pivots of the lesser weight
                agree, lesser = np.zeros((block.shape[1], n), np.uint16), np.empty((block.shape[1], n), np.uint16)
                for p in np.flatnonzero(block.any(1)):
                    np.minimum(block[p][:, None], held[p][None, :], out=lesser)
                    agree += lesser
                ranked = agree.astype(np.int64) * n + np.arange(n - 1, -1, -1)  # ties to the smaller id
                chosen = np.argpartition(ranked, n - taken, axis=1)[:, n - taken :]
            else:
                chosen = np.broadcast_to(np.arange(n), (block.shape[1], n))
            for i, at in enumerate(chosen):
                near = vec[at] @ qvec[start + i]
                if len(at) > k + SPARE:
                    edge = np.partition(near, len(near) - k - SPARE)[len(near) - k - SPARE]
                    above = np.flatnonzero(near >= edge)
                    above = above[np.lexsort((at[above], -near[above]))[: k + SPARE]]
                else:
                    above = np.arange(len(at))
                out.append((np.full(len(above), qno[start + i]), no[at[above]], vid[at[above]], near[above]))
        return pa.table(dict(zip(("qno", "no", "vid", "near"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """pivot and the number of blocks its rows are cut into; a row a pivot."""
    return rows.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))


def _search(entries: DataFrame, queries: DataFrame, k: int, pivots: int, probed: int) -> DataFrame:
    """qno, no, vid, near: what the visited files give; a pair may come from several of them."""
    ordered = F.slice("perm", 1, min(ORDERED, pivots))
    posted = entries.select("no", "vid", "vec", ordered.alias("perm"), F.explode(F.slice("perm", 1, min(POSTED, pivots))).alias("pivot"))
    asked = queries.select("qno", "vec", ordered.alias("perm"), F.explode(F.slice("perm", 1, min(probed, pivots))).alias("pivot"))
    files, visits = _blocks(posted, FILE_BLOCK), _blocks(asked, QUERY_BLOCK)
    plan = F.broadcast(files.withColumnRenamed("n", "files").join(F.broadcast(visits.withColumnRenamed("n", "visits")), "pivot"))  # a row a pivot
    dealt = lambda rows, no, own, other: (
        rows.join(plan, "pivot")
        .withColumn(own[1], F.pmod(F.xxhash64(no), F.col(own[0])).cast("int"))
        .withColumn(other[1], F.explode(F.sequence(F.lit(0), F.col(other[0]) - 1)))
        .drop("files", "visits")
    )
    left = dealt(posted, "no", ("files", "file"), ("visits", "visit"))
    right = dealt(asked, "qno", ("visits", "visit"), ("files", "file"))
    keys = ("pivot", "file", "visit")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return found.applyInArrow(_best_of_file(k, pivots, SHARE, LEAST), "qno long, no long, vid long, near double")


def _nearest_of_length(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """nearest_neighbours() among vectors of one length."""
    ranked = Window.partitionBy("key").orderBy("id")  # the limit on ranks is applied before the shuffle, so hot vectors send k + 1 rows a task
    ids = rows.select("key", "id").withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = rows.groupBy("key").agg(F.any_value("vec").alias("vec"))
    entries = materialize(distinct.join(ids, "key").select("key", "vec", "ids", F.element_at("ids", 1).alias("vid")).withColumn("no", F.monotonically_increasing_id()), "entries")
    queries = materialize(asked.groupBy("key").agg(F.any_value("vec").alias("vec")).withColumn("qno", F.monotonically_increasing_id()), "ann_queries")
    sample = entries.select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(PIVOTS).collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], RESULT)
    pivots = np.array([r.vec for r in sample])
    square = F.aggregate("vec", F.lit(0.0), lambda n, x: n + x * x)
    longest, n = entries.agg(F.max(square), F.sum(F.size("ids"))).first()
    ordered = materialize(_orders(entries.drop("key", "ids"), pivots, longest, False), "ann_orders")
    probes = materialize(_orders(queries.drop("key"), pivots, longest, True), "ann_probes")
    found = materialize(_search(ordered, probes, k, len(pivots), PROBED), "ann_found")
    counts = found.groupBy("qno").agg(F.count_distinct("no").alias("n"))
    few = probes.join(counts, "qno", "left").where(F.coalesce("n", F.lit(0)) < min(k, n - 1)).drop("n")
    if PROBED < len(pivots) and not few.isEmpty():
        found = found.unionByName(_search(ordered, few, k, len(pivots), len(pivots)))
    # which entries are nearest: by the products of the files first, then exactly, on the original vectors
    near = Window.partitionBy("qno").orderBy(F.desc("near"), "vid", "no")
    best = found.groupBy("qno", "no", "vid").agg(F.max("near").alias("near")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + SPARE)
    best = best.join(entries.select("no", "vec", "ids"), "no").join(small(queries.select("qno", "key", F.col("vec").alias("q")), 16 * pivots.shape[1]), "qno")
    score = F.aggregate(F.zip_with("vec", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = best.select("key", score.alias("score"), F.explode("ids").alias("vec_id"))
    nearest = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1).drop("r")
    own = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    pairs = asked.select(F.col("id").alias("query_id"), "key").join(best, "key").where("query_id <> vec_id")
    return pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row for which is_query(id column) holds, the k nearest found among all other rows.

    Nearest first, ties to the smaller id; score is the inner product of the original vectors in double precision."""
    vectors = materialize(valid_vectors(rows, id_col, vector_col), "vectors")
    lengths = sorted(r.n for r in vectors.select(F.size("vec").alias("n")).distinct().collect())
    out = rows.sparkSession.createDataFrame([], RESULT)
    for length in lengths:
        same = vectors.where(F.size("vec") == length) if len(lengths) > 1 else vectors
        found = _nearest_of_length(same, same.where(is_query(F.col("id"))), k)
        out = found if length == lengths[0] else out.unionByName(found)
    return out


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
