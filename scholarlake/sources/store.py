"""Rows into the stored tables: files, documents, jobs and logs are appended with their defaults."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholarlake.schemas import JOB_DOCUMENTS, JOB_LOGS, JOBS

FILES = "doc_id string, filename string, content_type string, size_bytes bigint, sha256 string, content binary"


def completed(rows: DataFrame, schema: str, defaults: dict[str, Column]) -> DataFrame:
    """rows in the columns of a table: values that are missing or null are the table's defaults, else null."""
    held = set(rows.columns)
    out = []
    for field in StructType.fromDDL(schema).fields:
        given = [F.col(field.name)] if field.name in held else []
        given += [defaults[field.name]] if field.name in defaults else []
        out.append((F.coalesce(*given) if given else F.lit(None)).cast(field.dataType).alias(field.name))
    return rows.select(*out)


def _append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def put_files(files: DataFrame, path: str, content_type: str = "application/pdf") -> None:
    """read_files() with their bytes; a file's id, size and hash follow from its content."""
    sha = F.sha2("content", 256)
    _append(completed(files, FILES, {"doc_id": sha, "sha256": sha, "size_bytes": F.octet_length("content"), "content_type": F.lit(content_type)}), path)


def add_documents(rows: DataFrame, path: str, now) -> None:
    """New documents are `uploaded`, without error, created and updated now."""
    at = F.lit(now).cast("timestamp")
    _append(completed(rows, JOB_DOCUMENTS, {"status": F.lit("uploaded"), "created_at": at, "updated_at": at}), path)


def add_jobs(rows: DataFrame, path: str, now) -> None:
    """New jobs (total: their documents) are `pending` with nothing done, created and updated now."""
    at = F.lit(now).cast("timestamp")
    total = F.col("total") if "total" in rows.columns else F.lit(0)
    progress = F.struct(F.lit(0).alias("current"), F.coalesce(total, F.lit(0)).cast("int").alias("total"))
    _append(completed(rows, JOBS, {"status": F.lit("pending"), "progress": progress, "created_at": at, "updated_at": at}), path)


def add_logs(rows: DataFrame, path: str, now) -> None:
    """Log rows of level `info` at the present time unless they say otherwise; empty texts are null."""
    texts = [c for c in ("op", "message", "doc_id", "filename", "phase", "worker") if c in rows.columns]
    rows = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts})
    _append(completed(rows, JOB_LOGS, {"level": F.lit("info"), "ts": F.lit(now).cast("timestamp")}), path)


def as_line(entry: dict[str, Any]) -> str:
    return " ".join(f"{k}={v}" for k, v in entry.items())


@contextmanager
def timing(op: str, emit: Callable[[str], None], **context: Any) -> Iterator[None]:
    """Emits one line of the context, op and duration_ms once the block ends, also if it fails."""
    start = time.perf_counter()
    try:
        yield
    finally:
        emit(as_line({**context, "op": op, "duration_ms": int((time.perf_counter() - start) * 1000)}))
