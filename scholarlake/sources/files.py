"""Files in, tables and exports out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.config import DEFAULTS, Settings
from scholarlake.functions import records as R
from scholarlake.functions.text import paragraphs

BLOCKS = "doc_id string, page int, col int, seq int, text string"
#: bytes -> list of page texts; raises or returns nothing if it can't read the file.
Extractor = Callable[[bytes], list[str]]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (sha256), filename, size_bytes, sha256, content of all files under path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sha = F.sha2("content", 256)
    return rows.select(sha.alias("doc_id"), R.basename("path").alias("filename"), F.col("length").alias("size_bytes"), sha.alias("sha256"), "content")


def gate(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """files with reject: the first reason against a file, or null."""
    return files.withColumn(
        "reject",
        F.when(F.coalesce("filename", F.lit("")) == "", "filename")
        .when(~R.has_extension("filename", settings.extensions), "extension")
        .when(F.col("size_bytes") > settings.max_file_mb * 1024 * 1024, "size")
        .when(~R.is_pdf("content"), "content"),
    )


def gate_calls(files: DataFrame, call: str = "call_id", place: str = "place", settings: Settings = DEFAULTS) -> DataFrame:
    """gate() for uploads of several files (place: a file's position in its call): call_reject, the reason of the first bad file,
    rejects the whole call, whose row `queued` is then false; `stored` files are those before it. A call is one file or more."""
    rows = gate(files, settings)
    first = F.min(F.when(F.col("reject").isNotNull(), F.struct(F.col(place).alias("place"), F.col("filename"), F.col("reject").alias("reason"))))
    bad = rows.groupBy(F.col(call).alias("of_call")).agg(first.alias("call_reject"))
    rows = rows.join(bad, F.col(call).eqNullSafe(F.col("of_call"))).drop("of_call")
    return rows.withColumns({"queued": F.col("call_reject").isNull(), "stored": F.col("call_reject").isNull() | (F.col(place) < F.col("call_reject.place"))})


def text_pages(content: bytes) -> list[str]:
    """The extractor of plain text files: form feeds part the pages."""
    return content.decode("utf-8", "replace").split("\f")


def read_blocks(files: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """Blocks of each file by the first extractor that finds any; blank pages are skipped, seq starts anew on each page.

    Python runs on the bytes only; the cut into paragraphs is native. Files that no extractor reads have one row with
    null text.
    """

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, content in zip(frame.doc_id, frame.content, strict=True):
                found: list[str] = []
                for extract in extractors:
                    try:
                        found = [p or "" for p in extract(bytes(content))]
                    except Exception:  # noqa: BLE001  the next extractor may read it
                        found = []
                    if any(p.strip() for p in found):
                        break
                rows += [(doc_id, i + 1, p) for i, p in enumerate(found) if p.strip()] or [(doc_id, 1, None)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    rows = files.select("doc_id", "content").mapInPandas(pages, "doc_id string, page int, text string")
    return rows.select("doc_id", "page", F.lit(0).alias("col"), F.posexplode_outer(paragraphs("text")).alias("seq", "text"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_ndjson(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_diagnostics(rows: DataFrame, path: str, name: str = "filename") -> None:
    """JSON rows under a folder for each file, its name reduced to letters, digits, dot, dash and underscore."""
    rows.withColumn("document", F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_")).write.mode("overwrite").partitionBy("document").json(path)
