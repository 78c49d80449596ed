"""From raw documents to token ids: quality, exact and near duplicates, benchmark leaks, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of
documents; the last one returns token ids. run() writes each stage as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.bpe import encode_bpe, multi_path
from scholarlake.llm.common import drop_written, materialize, table, written
from scholarlake.llm.decontaminate import decontaminate
from scholarlake.llm.exact_dedup import exact_dedup
from scholarlake.llm.jaccard_join import near_dedup
from scholarlake.llm.quality import learned_from, quality_filter, train


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier rejects."""
    return quality_filter(docs, train(docs, learned_from(table(spark, sf_dir, "labels"))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of at least 0.8 of five-word shingles the least doc_id stays."""
    return near_dedup(docs, 5, "0.8")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the decoded ids are the text."""
    path, pattern = multi_path()
    coded = encode_bpe(docs.select("doc_id", "text", "lang", "source"), path, pattern, exact=True)  # one Python worker a task holds the vocabulary
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("byte_bpe", tokenize),
]

#: The classifier, the latent search and the merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = written()
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_written(before)
    return docs
