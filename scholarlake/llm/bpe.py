"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are split by the vocabulary's pattern; each distinct piece of a step that is not held from before is encoded once.
Pieces are bucketed by byte length into matrices padded with -1. In each round every row looks up all its adjacent pairs in a
hashed pair table, merges its leftmost pair of least rank and is compacted by one column; rows without a known pair
leave the matrix. Pieces longer than WIDEST bytes are matrices of one row, in which a round merges all places of the least
pair from the left at once, up to one that brings up a pair of lower rank, and looks up only the pairs beside them.

Defined cases: null text is the empty text (no ids); repeated rows are encoded alike; an empty table gives an empty
result; other columns are passed by. Decoding is exact: bytes of ids concatenated.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.common import mapped, table, texts
from scholarlake.llm.parts import PartCoder, spread

WIDEST = 256
#: Cells of one matrix.
CELLS = 1 << 18
#: Text bytes of one step.
STEP = 2 << 20

_NONE = np.int64(1 << 40)


class PairTable:
    """Open addressing with linear probing: (left id, right id) -> id of the joined bytes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int64)
        key = (left.astype(np.int64) << 32) | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]  # of several that want a slot one stays
            won = free[self.keys[slot[free]] == key[free]]
            self.values[slot[won]] = joined[won]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined pairs; _NONE where there is none."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], _NONE)
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, joined = [], [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(i)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(joined, np.int64))
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, as unsigned 32-bit integers."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[at] = np.array([whole], "<u4")
            elif len(piece) > WIDEST:
                out[at] = self._long(piece)
            else:
                buckets.setdefault(max(2, (len(piece) - 1).bit_length()), []).append(at)
        for bits, members in buckets.items():
            rows = max(1, CELLS >> bits)
            for start in range(0, len(members), rows):
                part = members[start : start + rows]
                for at, ids in zip(part, self._matrix([pieces[i] for i in part]), strict=True):
                    out[at] = ids
        return out

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(x) for x in pieces])
        width = int(sizes.max())
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rows, out = np.arange(len(pieces)), [np.empty(0, "<u4")] * len(pieces)

        def leave(which: np.ndarray) -> None:
            left = ids[which]
            ends = np.cumsum((left >= 0).sum(1)).tolist()
            flat, start = left[left >= 0].astype("<u4"), 0
            for r, end in zip(rows[which].tolist(), ends, strict=True):
                out[r], start = flat[start:end], end

        while len(rows) and ids.shape[1] > 1:
            ranks = np.full((len(rows), ids.shape[1] - 1), _NONE)
            real = ids[:, 1:] >= 0
            ranks[real] = self.pairs.find(ids[:, :-1][real], ids[:, 1:][real])
            at = ranks.argmin(1)  # the leftmost of the least
            least = ranks[np.arange(len(rows)), at]
            done = least == _NONE
            if done.any():
                leave(done)
                rows, ids, at, least = rows[~done], ids[~done], at[~done], least[~done]
                if not len(rows):
                    break
            ids[np.arange(len(rows)), at] = least
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)  # compaction: each row lost one
        leave(slice(None))
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])  # of each id with the next
        while len(ranks) and (least := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == least)
            run = np.concatenate([[True], np.diff(at) > 1])  # neighbouring places overlap: every other one of a run is merged
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            # from left to right, a merge may bring up a pair of lower rank with what is beside it then: it is the last of this round
            merged_before = np.concatenate([[False], np.diff(at) == 2])
            left = np.where(merged_before, least, ids[np.maximum(at - 1, 0)])
            lower = (self.pairs.find(left, np.full(len(at), least)) < least) & (at > 0)
            inner = at + 2 < len(ids)
            lower[inner] |= self.pairs.find(np.full(inner.sum(), least), ids[at[inner] + 2]) < least
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            ranks = ranks[keep[1:]] if len(ids) > 1 else ranks[:0]  # the pair before a removed id goes with it
            now = at - np.arange(len(at))
            beside = np.unique(np.concatenate([now[now > 0] - 1, now[now < len(ids) - 1]]))
            ranks[beside] = self.pairs.find(ids[beside], ids[beside + 1])
        return ids.astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for start in range(0, len(ids), 1 << 18):
            part = ids[start : start + (1 << 18)].astype(np.int64)
            sizes = self.length[part]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self.offset[part] - (ends - sizes), sizes)
            out.append(self.flat[at].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> Bpe:
    """A rank file of base64 tokens and ids; read once in each Python worker."""
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class BpeCoder(PartCoder):
    """By a rank file and a splitting pattern."""

    def __init__(self, bpe: Bpe, pattern: str) -> None:
        super().__init__()
        self.bpe, self.find = bpe, regex.compile(pattern).findall

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.find(x) for x in texts]
        places = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        ids = self.bpe.encode_pieces([p.encode() for p in places])
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        order = np.fromiter(map(places.__getitem__, chain.from_iterable(split)), np.int64)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        total = np.concatenate([[0], np.cumsum(counts[order])])
        ends = np.cumsum(sizes)
        return spread(np.concatenate([np.empty(0, "<u4"), *ids]), counts, order), total[ends] - total[ends - sizes]


@functools.lru_cache(maxsize=2)
def bpe_coder(path: str, pattern: str) -> BpeCoder:
    return BpeCoder(load_ranks(path), pattern)


def encode_bpe(docs: DataFrame, path: str, pattern: str, text_col: str = "text", exact: bool = False) -> DataFrame:
    """docs with ids (array<int>) added; an existing column of that name is replaced. exact: and with a column of that name, whether the ids
    decode to the text, in the same pass."""
    rows = docs.drop("ids", *["exact"] * exact)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, sizes = bpe_coder(path, pattern).encode(batch.column(text_col))
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.view(np.int32)))
        columns, names = [*batch.columns, ids], [*batch.schema.names, "ids"]
        if exact:
            decoded = _decoded(load_ranks(path), flat.astype(np.int64), sizes)
            same = [x == y for x, y in zip(decoded, texts(batch, text_col), strict=True)]
            columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "exact"]
        return pa.RecordBatch.from_arrays(columns, names)

    added = {"ids": F.lit(None).cast("array<int>")} | ({"exact": F.lit(None).cast("boolean")} if exact else {})
    return mapped(rows, run, rows.withColumns(added).schema, text_col, STEP)


def _decoded(bpe: Bpe, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The bytes of each run of ids."""
    raw = bpe.decode(flat)
    length = np.concatenate([[0], np.cumsum(bpe.length[flat])])
    ends = np.cumsum(sizes)
    return [raw[a:b] for a, b in zip(length[ends - sizes].tolist(), length[ends].tolist(), strict=True)]


def decode_bpe(coded: DataFrame, path: str) -> DataFrame:
    """coded with decoded (binary) added, from its ids."""
    rows = coded.drop("decoded")

    def run(batches):
        bpe = load_ranks(path)
        for batch in batches:
            ids = batch.column("ids")
            out = _decoded(bpe, ids.flatten().to_numpy().astype(np.int64), pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit(None).cast("binary")).schema)


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, in one pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, sizes = bpe_coder(path, pattern).encode(batch.column("text"))
        raw, ends = flat.astype("<u4").tobytes(), np.cumsum(sizes) * 4
        ids = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip((ends - sizes * 4).tolist(), ends.tolist(), strict=True)]
        decoded = [hashlib.sha256(x).hexdigest() for x in _decoded(load_ranks(path), flat.astype(np.int64), sizes)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "text", STEP)


def multi_path() -> tuple[str, str]:
    """Default vocabulary and pattern, from the installed collection of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), *multi_path())
