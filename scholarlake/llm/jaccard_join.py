"""N-gram Jaccard join: exact links between documents by a blocked sparse product of document by n-gram incidence.

1. Each whole text becomes its set of shingle hashes; equal sets form one class, joined once.
2. Candidate blocks, by keys that linked sets share. Prefix keys: in any common order of all shingles, linked sets share
   one of their first elements: of n elements the first n - ceil(t n) + 1, and of the smaller set even the first
   n - ceil(2 t n / (1 + t)) + 1. Shingles that are frequent in a hash sample come last in the order. Part keys, for thresholds from
   PARTS_FROM: sets of sizes a and b differ in at most (a + b)(1 - t)/(1 + t) elements; in a size range whose largest such
   difference is d, elements that are not frequent are dealt by hash into 1.5 (d + 1) parts, so linked sets agree on more
   parts than d + 1 leaves empty, and on a part with elements if one of the two has over d such parts; a set with fewer also
   emits keys over all its shingles, in d + 1 + d/16 parts, empty ones included where there are over d/16 of them. A set is put into
   its own range and all below in which a partner may be. Leaving frequent shingles to the end keeps common passages from
   tying their documents; the result is the same whatever counts as frequent.
3. Sorted by key and size, a key's sets are tied to one pivot (rows linear in keys); where there are at most PAIRED of them, each
   pair is taken instead, and kept only if parity sketches of the two sets (about a bit and a half a shingle, never more bits apart than the
   sets are elements) allow a link. Texts that meet by chance in a shingle are let go there: how many do grows with the square of the
   input. Connected candidates form a family. Families too large for one block are keyed again, shingles now ordered by their counts in these families, as
   long as that makes them smaller.
4. Each family is cut into blocks bounded in documents and shingles, and the sparse products of blocks accumulate overlap counts:
   columns of most rows by a dense product, the others by sorted runs; pairs below the size-derived bound are dropped. Every
   block meets itself and the family's first block; sets outside the largest component found so far then meet all
   blocks. Only a spanning forest of the links leaves a block.

No pair between different components is left out, and the work on a family of n close sets stays linear in n.

Defined cases: null texts and texts without words have no shingles and are linked with nothing; ties do not arise
(component ids are least document ids, null ids ignored); repeated rows are documents of the same class; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.common import WIDE_ROWS, frequent_from, mapped, materialize, release, small, table, texts, without_ids
from scholarlake.llm.graph import components
from scholarlake.llm.shingles import mix, shingle_set

#: Bounds of one block.
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 400_000
#: Threshold from which on part keys are taken: there are few of them, and they tie fewer sets than single shingles do.
PARTS_FROM = Fraction(9, 10)
#: Shingles of one step on the way to keys.
STEP_SHINGLES = 300_000
#: Columns of one dense product.
COLUMNS = 1024
#: Ratio of a size range.
RANGE = 1.4
#: Most shingles that come last in the order as frequent: 8 bytes each, and 4 for a count, travel with the tasks.
FREQUENT = 1_000_000
#: Most sets of a key that are taken pair by pair.
PAIRED = 32
#: Keys looked after for balance, the most frequent of a hash sample, and the tasks that each is spread over.
HOT_KEYS = 4_096
SALTS = 16


def size_ranges(limit: int = 1 << 40) -> list[int]:
    """Starts of the size ranges."""
    starts = [1]
    while starts[-1] < limit:
        starts.append(max(starts[-1] + 1, int(starts[-1] * RANGE)))
    return starts


_STARTS = np.array(size_ranges(), np.int64)


def _parts(hashes: np.ndarray, parts: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the non-empty ones among `parts` hash parts of a set, and the key of each empty part."""
    part = (mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(parts)).astype(np.int64)
    sums, count = np.zeros(parts, np.uint64), np.bincount(part, minlength=parts)
    np.add.at(sums, part, mix(hashes))
    keys = mix(sums ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64(tag << 40)) ^ (count.astype(np.uint64) << np.uint64(7)))
    return keys[count > 0], keys[count == 0]


def part_keys(hashes: np.ndarray, t: Fraction, frequent: np.ndarray) -> np.ndarray:
    """Keys of one set: sets with Jaccard similarity of at least t share one, whatever `frequent` (sorted hashes) is."""
    n = len(hashes)
    own = int(np.searchsorted(_STARTS, n, side="right")) - 1
    lowest = int(np.searchsorted(_STARTS, -(-n * t.numerator // t.denominator), side="right")) - 1  # of the least partner
    ranges = range(lowest, own + 1)
    rare = hashes[frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] != hashes] if len(frequent) else hashes
    keys = []
    for r in ranges:
        # both sizes at most: a set of range r, and a partner as large as the bound allows
        most = int(_STARTS[r + 1]) - 1
        d = int((most + most * t.denominator // t.numerator) * (1 - t) / (1 + t))
        full, _ = _parts(rare, d + 1 + (d + 1) // 2, 2 * r)
        keys.append(full)
        if len(full) <= d:  # agreement may be on empty parts only, unless the partner has enough
            more, empty = _parts(hashes, d + 1 + d // 16, 2 * r + 1)
            keys += [more] if len(empty) <= d // 16 else [more, empty]
    return np.concatenate(keys).astype(np.int64)


def prefixes(n: int, t: Fraction) -> tuple[int, int]:
    """How many of the first elements of a set of n are keys, and how many of these are so towards sets of at least n."""
    both = 2 * t / (1 + t)
    return n - -(-n * t.numerator // t.denominator) + 1, n - -(-n * both.numerator // both.denominator) + 1


def prefix_keys(hashes: np.ndarray, t: Fraction, frequent: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The first elements of one set (sorted hashes): sets with Jaccard similarity of at least t share one.

    The order of all shingles is: those that are not in `frequent` (sorted hashes) by hash, then the others by count, if given, and hash."""
    longest, _ = prefixes(len(hashes), t)
    if not len(frequent):
        return hashes[:longest].view(np.int64)
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    known = frequent[at] == hashes
    out = hashes[~known][:longest]
    if len(out) < longest:
        common = hashes[known]
        if counts is not None:
            common = common[np.argsort(counts[at[known]], kind="stable")]
        out = np.concatenate([out, common[: longest - len(out)]])
    return out.view(np.int64)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def fingerprint(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set, whatever its order."""
    if not len(s):
        return np.uint64(0), np.uint64(0)
    return np.add.reduce(mix(s + np.uint64(1))), np.add.reduce(mix(s ^ np.uint64(0x5DEECE66D1234567)))


def _longs(x: list) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Parities of how many elements fall on each of as many bits as the power of two from the set's size on, 64 at least."""
    bits = max(64, 1 << int(len(s) - 1).bit_length()) if len(s) else 64
    fallen = np.bincount((mix(s ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((fallen & 1).astype(np.uint8), bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded to the other's length: at most as many as elements are in one set alone."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    m, n = 8 * len(a), 8 * len(b)
    while m > n:
        m //= 2
        x = (x >> m) ^ (x & ((1 << m) - 1))
    while n > m:
        n //= 2
        y = (y >> n) ^ (y & ((1 << n) - 1))
    return (x ^ y).bit_count()


def may_link(a: bytes, b: bytes, both: int, t: Fraction) -> bool:
    """False only if sets with these sketches, of `both` elements together, have a Jaccard similarity under t."""
    return bits_apart(a, b) * (t.denominator + t.numerator) <= both * (t.denominator - t.numerator)


def shingle_rows(rows: DataFrame, n: int) -> DataFrame:
    """doc_id, n, c1, c2 (the fingerprint), sketch of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, n) for x in texts(batch)]
        c1, c2 = zip(*map(fingerprint, sets), strict=True)
        sizes, sketches = pa.array([len(s) for s in sets], pa.int64()), pa.array(map(sketch, sets), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, _longs(c1), _longs(c2), sketches], ["doc_id", "n", "c1", "c2", "sketch"])

    return mapped(rows, run, "doc_id long, n long, c1 long, c2 long, sketch binary")


def frequent_shingles(rows: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of shingles in at least two documents of a hash sample, or in so many more that at most FREQUENT are left."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, n) for x in texts(batch)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["g"])

    sample = rows.where("pmod(xxhash64(doc_id, 3), 16) = 0")
    return _most_frequent(mapped(sample.select("text"), run, "g long"), 2)[0]


def _most_frequent(shingles: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles (g) that occur `least` times, or so many more that at most FREQUENT are left."""
    counts = materialize(shingles.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least), "frequent", WIDE_ROWS)
    least = frequent_from(counts, "m", FREQUENT)
    found = counts.where(F.col("m") >= least).select("g", F.least("m", F.lit(1 << 30)).cast("int").alias("m")).toArrow()
    g, m = found["g"].to_numpy().view(np.uint64), found["m"].to_numpy()
    order = np.argsort(g)
    return g[order], m[order]


KEY = "key long, size int, c1 long"


def _keys(sets: list[np.ndarray], owners: np.ndarray, t: Fraction, frequent: tuple[np.ndarray, np.ndarray | None], parts: bool = False) -> pa.RecordBatch:
    """size: twice the set's, and one more for a key that is none towards larger sets."""
    if parts:
        keys = [part_keys(x, t, frequent[0]) for x in sets]
        sizes = [np.full(len(k), 2 * len(x)) for x, k in zip(sets, keys, strict=True)]
    else:
        keys = [prefix_keys(x, t, *frequent) for x in sets]
        sizes = [2 * len(x) + (np.arange(len(k)) >= prefixes(len(x), t)[1]) for x, k in zip(sets, keys, strict=True)]
    owner = np.repeat(owners, [len(k) for k in keys])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(owner)], ["key", "size", "c1"])


def key_rows(rows: DataFrame, n: int, t: Fraction, frequent: np.ndarray, parts: bool) -> DataFrame:
    """key, size, c1: a row for each key of each row's set."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = [s for s in (shingle_set(x, n) for x in texts(batch)) if len(s)]
        if not sets:
            return None
        return _keys(sets, np.array([fingerprint(s)[0] for s in sets], np.uint64).view(np.int64), t, (shared.value, None), parts)

    return mapped(rows, run, KEY)


def family_keys(sets: DataFrame, t: Fraction, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, size, c1 of sets (family, c1, hashes); keys of different families differ."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column("hashes").values.to_numpy().view(np.uint64), batch.column("hashes").offsets.to_numpy()
            families, owners = batch.column("family").to_numpy(), batch.column("c1").to_numpy()
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + STEP_SHINGLES, side="right")) - 1)
                part = _keys([flat[ends[i] : ends[i + 1]] for i in range(start, stop)], owners[start:stop], t, shared.value)
                counts = [prefixes(int(ends[i + 1] - ends[i]), t)[0] for i in range(start, stop)]
                salt = np.repeat(mix(families[start:stop].view(np.uint64)), counts)
                keys = mix(part.column("key").to_numpy().view(np.uint64) ^ salt).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column("size"), part.column("c1")], ["key", "size", "c1"])
                start = stop

    return sets.select("family", "c1", "hashes").mapInArrow(run, KEY)


def _tie(t: Fraction):
    """Over rows sorted by key, salt, size and c1: c1 and the pivot it may be linked with (kind 0); of salted keys also the first c1 and the
    key (kind 1); of keys with at most PAIRED sets each pair instead (kind 2).

    A key's sets in order of size are one group as long as no size is under t of the next. Sets before the first one whose key
    holds towards larger sets are left out. Salted keys (salt >= 0) are tied whatever the sizes, since their rows are not all here."""
    columns = ("key", "salt", "size", "c1")

    def out(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b)), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

    def distinct(a: list[np.ndarray], b: list[np.ndarray], kind: int) -> Iterator[pa.RecordBatch]:
        if a and len(ends := np.stack([np.concatenate(a), np.concatenate(b)], 1)):
            ends = np.unique(ends, axis=0)
            yield out(ends[:, 0], ends[:, 1], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, salt, size and pivot (None: none yet) of the last row that is done with; its group is tied to a pivot
        held = [np.empty(0, np.int64)] * 4  # rows of a last group that may still be taken pair by pair
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            rows_ = held if batch is None else [np.concatenate([h, batch.column(x).to_numpy()]) for h, x in zip(held, columns, strict=True)]
            key, salt, size, c = rows_
            if not len(key):
                return
            n, rows = size.astype(np.int64) >> 1, np.arange(len(key))
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            gap = np.zeros(len(key), bool)
            gap[1:] = n[:-1] * t.denominator < t.numerator * n[1:]
            if last is not None:
                fresh[0] = (key[0], salt[0]) != last[:2]
                gap[0] = last[2] * t.denominator < t.numerator * n[0]
            first = fresh & (salt >= 0)
            fresh |= gap & (salt < 0)
            begin = np.maximum.accumulate(np.where(fresh, rows, -1))  # -1: the last batch's
            if batch is not None and begin[-1] >= 0 and salt[-1] < 0 and len(key) - begin[-1] <= PAIRED:
                done = int(begin[-1])
                held = [x[done:] for x in rows_]
                if not done:
                    continue
                key, salt, size, c, n, rows, fresh, first, begin = (x[:done] for x in (key, salt, size, c, n, rows, fresh, first, begin))
            else:
                held = [x[:0] for x in rows_]
            if first.any():
                yield out(c[first], key[first], 1)
            can = (salt >= 0) | (size & 1 == 0)
            members = np.bincount(begin + 1, minlength=len(key) + 1)[begin + 1]
            few = (begin >= 0) & (salt < 0) & (members <= PAIRED)
            some = np.flatnonzero(few & (members > 1))
            pairs: list[list[np.ndarray]] = [[], []]
            for shift in range(1, min(PAIRED, len(some))):
                one, other = some[:-shift], some[shift:]
                if not (same := begin[one] == begin[other]).any():
                    break
                same &= can[one] & (c[one] != c[other])
                a, b = c[one[same]], c[other[same]]
                pairs[0].append(np.minimum(a, b))
                pairs[1].append(np.maximum(a, b))
            yield from distinct(*pairs, 2)
            following = np.minimum.accumulate(np.where(can, rows, len(key))[::-1])[::-1]  # the next that can be a pivot
            at = following[np.maximum(begin, 0)]
            has = at <= rows
            pivots = c[np.minimum(at, len(key) - 1)]
            if last is not None and last[3] is not None:
                carried = begin < 0
                pivots, has = np.where(carried, last[3], pivots), has | carried
            tied = has & ~few & (c != pivots)
            yield from distinct([c[tied]], [pivots[tied]], 0)
            last = (key[-1], salt[-1], int(n[-1]), pivots[-1] if has[-1] else None)

    return run


def _allowed(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Those pairs (a, b: c1) whose sketches in sets (n, c1, c2, sketch) allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("a_sketch", "b_sketch", "both"))
            keep = [may_link(a, b, both, t) for a, b, both in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("c1")).unionByName(pairs.select(F.col("b").alias("c1"))).distinct()
    wanted = sets.join(ends, "c1", "left_semi").groupBy("c1", "c2").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    of = lambda x: wanted.select(F.col("c1").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("a_n") + F.col("b_n")).alias("both"), "a_sketch", "b_sketch")
    return both.mapInArrow(run, "a long, b long")


def _tied(keyed: DataFrame, hot: list[int], t: Fraction, sets: DataFrame) -> DataFrame:
    """a, b: c1 of sets that share a key, in pairs or each with a pivot of it; each pair once. Keys in `hot` are spread over SALTS
    tasks, whose pivots are tied by a row for each salt. sets: n, c1, c2, sketch of all."""
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    salted = keyed.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("c1"), F.lit(SALTS))).otherwise(-1).cast("int"))
    dealt = salted.repartition("key", "salt").sortWithinPartitions("key", "salt", "size", "c1").select("key", "salt", "size", "c1")
    found = materialize(dealt.mapInArrow(_tie(t), "a long, b long, kind int").distinct(), "tied", WIDE_ROWS)
    firsts = found.where("kind = 1").select(F.col("a").alias("c1"), F.col("b").alias("key"))
    across = firsts.join(firsts.groupBy("key").agg(F.min("c1").alias("b")), "key").where("c1 <> b").select(F.col("c1").alias("a"), "b")
    pairs = _allowed(found.where("kind = 2").select("a", "b"), sets, t)
    return found.where("kind = 0").select("a", "b").unionByName(across).unionByName(pairs).distinct()


def _hot_keys(sample: DataFrame) -> list[int]:
    counts = materialize(sample.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m >= 16"), "keys", WIDE_ROWS)
    return [r.key for r in counts.orderBy(F.desc("m")).limit(HOT_KEYS).collect()]


def ties_of(rows: DataFrame, n: int, t: Fraction, parts: bool, sets: DataFrame) -> DataFrame:
    """a, b: fingerprints of sets that share a key, in pairs or each with a pivot of it; each pair once. sets: n, c1, c2, sketch of all.

    The HOT_KEYS most frequent keys of a hash sample of documents are spread over several tasks."""
    frequent = frequent_shingles(rows, n)
    hot = _hot_keys(key_rows(rows.where("pmod(xxhash64(doc_id, 7), 16) = 0"), n, t, frequent, parts))
    return materialize(_tied(key_rows(rows, n, t, frequent, parts), hot, t, sets), "ties", WIDE_ROWS)


def ties_within(sets: DataFrame, t: Fraction, rows: DataFrame) -> DataFrame:
    """The same for sets (family, c1, hashes) within their families, shingles ordered by their counts in these sets."""
    frequent = _most_frequent(sets.select(F.explode("hashes").alias("g")), 2)
    hot = _hot_keys(family_keys(sets.where("pmod(xxhash64(c1, 7), 16) = 0"), t, frequent))
    return materialize(_tied(family_keys(sets, t, frequent), hot, t, rows), "ties", WIDE_ROWS)


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """The product of left's incidence matrix with right's transpose (left's own without right): |a & b|, as int32."""
    m, k = len(left), len(right or left)
    both = left + (right or [])
    doc = np.repeat(np.arange(len(both), dtype=np.int32), [len(s) for s in both])
    values = np.concatenate(both)
    order = np.argsort(values, kind="stable")  # left comes before right
    doc, values = doc[order], values[order]
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    df = np.diff(np.concatenate([begins, [len(values)]]))
    del order, values
    useful = df > 1 if right is None else (doc[begins] < m) & (doc[begins + df - 1] >= m)
    dense = useful & (df > max(16, len(both) // 16))
    narrow = useful & ~dense
    out = np.zeros((m, k), np.int32)
    place = np.full(len(begins), -1, np.int32)
    place[dense] = np.arange(dense.sum())
    of = np.repeat(place, df)
    for start in range(0, int(dense.sum()), COLUMNS):
        here = np.flatnonzero((of >= start) & (of < start + COLUMNS))
        block = np.zeros((len(both), COLUMNS), np.float32)
        block[doc[here], of[here] - start] = 1
        out += (block[:m] @ block[len(both) - k :].T).astype(np.int32)
    place[:] = -1
    place[narrow] = np.arange(narrow.sum())
    of = np.repeat(place, df)
    doc, of = doc[of >= 0], of[of >= 0]
    flat = out.reshape(-1)
    for shift in range(1, int(df[narrow].max(initial=1))):
        same = of[shift:] == of[:-shift]
        if right is not None:
            same &= (doc[:-shift] < m) & (doc[shift:] >= m)
        one, other = doc[:-shift][same].astype(np.int64), doc[shift:][same]
        np.add.at(flat, one * k + (other if right is None else other - m), 1)
        if right is None:
            np.add.at(flat, other.astype(np.int64) * k + one, 1)
    return out


def block_links(nodes: np.ndarray, sets: list[np.ndarray], t: Fraction, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links within one block, or with `split` between its first `split` sets and the others."""
    first, second = (sets, sets) if split is None else (sets[:split], sets[split:])
    both = overlaps(first, None if split is None else second)
    sizes, others = (np.array([len(s) for s in x], np.int64) for x in (first, second))
    linked = np.empty(both.shape, bool)
    for row in range(len(first)):  # |a & b| >= t |a | b|, in whole numbers
        linked[row] = both[row].astype(np.int64) * (t.numerator + t.denominator) >= t.numerator * (sizes[row] + others)
    del both
    m = len(sets)
    label = np.arange(m, dtype=np.int32)
    ends = (label, label) if split is None else (label[:split], label[split:])  # views: both sides of a block are one array
    while True:
        before = label.copy()
        np.minimum(ends[0], _least(linked, ends[1], m), out=ends[0])
        np.minimum(ends[1], _least(linked.T, ends[0], m), out=ends[1])
        label[:] = label[label]
        if (before == label).all():
            break
    return [(int(nodes[i]), int(nodes[label[i]])) for i in range(m) if label[i] != i and nodes[label[i]] != nodes[i]]


def _least(linked: np.ndarray, label: np.ndarray, none: int) -> np.ndarray:
    """The least label that each row is linked with."""
    out = np.empty(len(linked), np.int32)
    for at in range(0, len(linked), 128):
        out[at : at + 128] = np.where(linked[at : at + 128], label, none).min(1)
    return out


def _products(t: Fraction):
    """Streams rows sorted by pair of blocks and side; holds one block (or pair of blocks) at a time."""

    def flush(nodes: list[int], sets: list[np.ndarray], lefts: int) -> pa.RecordBatch | None:
        if len(nodes) < 2 or not lefts:
            return None
        links = block_links(np.array(nodes, np.int64), sets, t, lefts if lefts < len(nodes) else None)
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())}) if links else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        lefts, now, last = 0, None, None
        for batch in batches:
            hashes = batch.column("hashes")
            flat, ends = hashes.values.to_numpy(), hashes.offsets.to_numpy()
            keys = zip(*(batch.column(x).to_pylist() for x in ("family", "left", "right")), strict=True)
            for i, (key, side, node) in enumerate(zip(keys, batch.column("side").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                if key != now:
                    if (out := flush(nodes, sets, lefts)) is not None:
                        yield out
                    nodes, sets, lefts, now, last = [], [], 0, key, None
                if (side, node) == last:  # repeated rows
                    continue
                last = (side, node)
                nodes.append(node)
                sets.append(flat[ends[i] : ends[i + 1]].copy())
                lefts += side == 0
        if (out := flush(nodes, sets, lefts)) is not None:
            yield out

    return run


def _multiply(placed: DataFrame, t: Fraction) -> DataFrame:
    """placed: family, left, right, side, node, hashes -> links a, b of left with right blocks, or within a block without rows of side 1."""
    order = ["family", "left", "right", "side", "node"]
    rows = placed.repartition("family", "left", "right").sortWithinPartitions(*order)
    return rows.select(*order, "hashes").mapInArrow(_products(t), "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text", parts: bool | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs; threshold is a decimal number as text, kept exact. parts:
    whether candidates come from part keys or from prefix keys; by the threshold if not given, the result is the same."""
    t = Fraction(threshold)
    source = _identified(docs, id_col, text_col)
    rows = materialize(shingle_rows(source, n), "shingles", WIDE_ROWS)
    classes = materialize(
        rows.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")).withColumn("node", F.monotonically_increasing_id()), "classes"
    )
    sketches = rows.where("n > 0").select("n", "c1", "c2", "sketch")
    ties = ties_of(source, n, t, t >= PARTS_FROM if parts is None else parts, sketches)
    release(docs.sparkSession)
    families = components(ties).select(F.col("node").alias("c1"), F.col("component").alias("family"))
    members = materialize(classes.join(families, "c1").select("node", "rep", "n", "family", "c1", "c2"), "members")
    before = None
    while not (large := _blocks(members).where("blocks > 1")).isEmpty():
        again = materialize(members.join(large.select("family"), "family", "left_semi"), "large")
        size = again.count()
        if before is not None and size > 0.8 * before:  # these are close sets, not chains of common passages
            break
        sets = materialize(_sets(source, again.select("node", "rep", "family", "c1", "c2", F.lit(0).alias("blocks"), F.lit(0).alias("block")), n).select("family", "c1", "hashes"), "sets", WIDE_ROWS)
        closer = components(ties_within(sets, t, sketches)).select(F.col("node").alias("c1"), F.col("component").alias("closer"))
        whole = members.join(large.select("family"), "family", "left_anti")
        members = materialize(whole.unionByName(again.join(closer, "c1").select("node", "rep", "n", F.col("closer").alias("family"), "c1", "c2")), "members")
        release(docs.sparkSession)
        before = size
    wanted = members.join(_blocks(members), "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = materialize(_sets(source, wanted, n).select("family", "blocks", "block", "node", "hashes"), "blocks", WIDE_ROWS)
    release(docs.sparkSession)
    own = placed.select("family", F.col("block").alias("left"), F.col("block").alias("right"), F.lit(0).alias("side"), "node", "hashes")
    many = placed.where("blocks > 1")
    first = many.where("block > 0").select("family", F.lit(0).alias("left"), F.col("block").alias("right"), F.lit(1).alias("side"), "node", "hashes").unionByName(
        many.where("block = 0").select("family", F.lit(0).alias("left"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("right"), F.lit(0).alias("side"), "node", "hashes")
    )
    links = materialize(_multiply(own.unionByName(first), t), "links", WIDE_ROWS)
    if not many.isEmpty():
        links = links.unionByName(_outside(many.select("family", "blocks", "block", "node", "hashes"), links, t))
    found = components(links)
    labelled = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = labelled.join(least, "component").select("c1", "c2", "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").select("doc_id", "n", "c1", "c2").join(of_class, ["c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def _blocks(members: DataFrame) -> DataFrame:
    """family, blocks."""
    return members.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)).cast("int").alias("blocks"))


def _sets(source: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """family, blocks, block, node, c1, hashes: wanted (rep, c1, c2, family, blocks, block, node) with the sets of its texts.

    A text meets its class by id; where rows repeat an id the fingerprint decides."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, n) for x in texts(batch)]
        c1, c2 = (_longs(x) for x in zip(*map(fingerprint, sets), strict=True))
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
        own = pc.and_(pc.equal(c1, batch.column("c1")), pc.equal(c2, batch.column("c2")))
        names = ["family", "blocks", "block", "node", "c1"]
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), hashes], [*names, "hashes"]).filter(own)

    keys = wanted.select(F.col("rep").alias("wanted_id"), "c1", "c2", "family", "blocks", "block", "node")
    rows = source.join(small(keys, 96), F.expr("doc_id <=> wanted_id"))
    return mapped(rows.select("text", "c1", "c2", "family", "blocks", "block", "node"), run, "family long, blocks int, block int, node long, c1 long, hashes array<long>")


def _outside(many: DataFrame, links: DataFrame, t: Fraction) -> DataFrame:
    """Links of sets outside their family's largest component with all blocks of the family."""
    nodes = many.select("family", "blocks", "node")
    label = nodes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = label.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    outside = materialize(label.join(largest, "family").where("component <> largest").select("family", "node"), "outside")
    if outside.isEmpty():
        return links.limit(0)
    groups = outside.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("groups"))
    out = many.join(outside, ["family", "node"]).join(groups, "family")
    left = out.select("family", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("left"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("right"), F.lit(0).alias("side"), "node", "hashes")
    right = many.join(groups, "family").select("family", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("left"), F.col("block").alias("right"), F.lit(1).alias("side"), "node", "hashes")
    return materialize(_multiply(left.unionByName(right), t), "links", WIDE_ROWS)


def near_dedup(docs: DataFrame, n: int = 5, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the rows whose id is their component's least; columns as they are. Rows with a null id stay."""
    found = jaccard_components(docs, n, threshold, id_col, text_col)
    return without_ids(docs, materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped"), id_col)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, "0.9")


OP6_SQL = r"""
WITH RECURSIVE w AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
 SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
