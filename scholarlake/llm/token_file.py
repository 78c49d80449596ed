"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, so that files and stripes hold disjoint id ranges and a reader prunes
by row index and Bloom filter; a read is split by stripes. Each file also keeps its number and, per document, the
tokens before it in that file; a document's global start is that plus the totals of the files before.

Defined cases: null text is the empty text (its one token is the end id); a null id comes first; rows that repeat an id
follow each other in text order; an empty table writes and reads nothing; other columns are not written.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.common import new_path, small, steps, table
from scholarlake.llm.parts import PartCoder

END_ID = 0
#: Text bytes of one step, and distinct parts that a Python worker holds the ids of.
STEP = 12 << 20
HELD = 600_000
OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}
SCHEMA = "doc_id long, shard int, local_start long, n_tokens int, ids array<int>"


class FileTokenizer(PartCoder):
    """By the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(HELD)
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # the mark of a space

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def after_space(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts hold no space, so joined with spaces each starts at the next id whose token has the mark of a space."""
        flat, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for start in range(0, len(parts), 256):
            some = parts[start : start + 256]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) == len(some):
                flat.append(ids), counts.append(np.diff(cuts, append=len(ids)))
            else:
                one, n = self.alone([" " + x for x in some])
                flat.append(one), counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)


@functools.lru_cache(maxsize=1)
def load_tokenizer(path: str) -> FileTokenizer:
    return FileTokenizer(path)


def write_token_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write docs (doc_id, text) to `out` in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        coder = load_tokenizer(tokenizer)
        for batch in batches:
            for part in steps(batch, limit=STEP):
                flat, sizes = coder.encode(part.column("text"), end_id)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.full(len(sizes), shard, np.int32)), pa.array(before + ends - sizes), pa.array(sizes.astype(np.int32)), ids],
                    ["doc_id", "shard", "local_start", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, SCHEMA).write.options(**OPTIONS).orc(out)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids. A filter on doc_id reaches the row indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # one row a file
    starts = list(accumulate((t.n for t in totals), initial=0))[:-1]
    offsets = spark.createDataFrame([(t.shard, s) for t, s in zip(totals, starts, strict=True)], "shard int, offset long")
    return rows.join(small(offsets, 16), "shard").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = new_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_ids(spark, out).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
