"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of each partition are added up; digests whose summed counter reaches N/k are candidates (the
counters of a summary sum to N at most, so there are at most k). Their exact counts and winners are verified by one
aggregation with map-side combine and broadcast, so rows of frequent texts are settled without a shuffle. All other
digests go through an ordinary shuffle.

Defined cases: null text is the empty text; empty texts form one group; of rows that repeat both id and text one
stays; a null id is smaller than any other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.common import materialize, small, table, unused

#: Counters of a summary; a text with at least 2/COUNTERS of all rows is sure to be found.
COUNTERS = 1024


def _misra_gries(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for key, n in Counter(batch.column(0).to_pylist()).items():
                held[key] = held.get(key, 0) + n
            if len(held) > k:  # merged summaries: taking off the (k+1)-th largest keeps the bound
                cut = sorted(held.values(), reverse=True)[k]
                held = {key: n - cut for key, n in held.items() if n > cut}
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.binary()), "hits": pa.array(list(held.values()), pa.int64())})

    return run


def frequent(rows: DataFrame, counters: int = COUNTERS) -> tuple[DataFrame, int]:
    """Candidates for frequent digests, at most `counters` rows, and the least count they stand for."""
    least = max(2, -(-rows.count() // counters))
    summed = rows.select("digest").mapInArrow(_misra_gries(counters), "digest binary, hits long").groupBy("digest").agg(F.sum("hits").alias("hits"))
    return summed.where(F.col("hits") >= least).select("digest"), least


def _groups(docs: DataFrame, id_col: str, text_col: str, normalize: Callable[[Column], Column] | None, counters: int) -> DataFrame:
    """exact_groups() with hot: whether the row's text is one of the verified frequent ones."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalize(text) if normalize else text
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")).withColumn("row_no", F.monotonically_increasing_id())
    rows = materialize(rows, "digests")
    best = (F.max(F.struct("doc_id", "row_no")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    found, _ = frequent(rows, counters)
    winners = materialize(rows.join(F.broadcast(found), "digest", "left_semi").groupBy("digest").agg(*best), "winners")
    hot = rows.join(F.broadcast(winners), "digest")
    cold = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = cold.join(cold.groupBy("digest").agg(*best), "digest")
    return hot.withColumn("hot", F.lit(True)).unionByName(cold.withColumn("hot", F.lit(False))).select(
        "hot",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size"),
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize: Callable[[Column], Column] | None = None, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs, id_col, text_col, normalize, counters).drop("hot")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """docs without the rows that another row with the same text and a larger id makes redundant; columns as they are.

    Rows of frequent texts are dropped by their broadcast winners where they are read; only the others meet their keys."""
    groups = materialize(_groups(docs, id_col, text_col, None, counters), "groups")
    key, winner = unused(docs, "dedup_key"), unused(docs, "dedup_winner")
    same = F.struct("doc_id", "text_sha256")
    of = groups.groupBy(same.alias(key)).agg(F.max("kept").alias("kept"), F.max("hot").alias("hot"), F.count(F.lit(1)).alias("rows"))
    winners = groups.where("hot AND kept").select(same.alias(winner))  # one row a frequent text, at most `counters`
    dropped, repeated = of.where("NOT kept AND NOT hot").select(key), of.where("kept AND rows > 1").select(key)
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    keyed = docs.withColumn(key, F.struct(F.col(id_col).cast("long").alias("doc_id"), sha.alias("text_sha256")))
    won = keyed.join(F.broadcast(winners), F.col(f"{key}.text_sha256") == F.col(f"{winner}.text_sha256"), "left")
    won = won.where(F.col(winner).isNull() | F.col(f"{key}.doc_id").eqNullSafe(F.col(f"{winner}.doc_id"))).drop(winner)
    on = F.expr(f"d.{key} <=> x.{key}")  # ids may be null
    kept = won.alias("d").join(small(dropped, 96).alias("x"), on, "left_anti")
    if not repeated.isEmpty():
        again = small(repeated, 96)
        once = kept.alias("d").join(again.alias("x"), on, "left_semi").dropDuplicates([key])
        kept = kept.alias("d").join(again.alias("x"), on, "left_anti").unionByName(once)
    return kept.drop(key)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
"""
