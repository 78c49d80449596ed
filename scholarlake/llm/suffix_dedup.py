"""Removal of repeated byte strings by distributed prefix doubling.

The rank of the 2h bytes at a position stands for the pair (rank of h bytes at it, rank of h bytes at it + h). Ranks are
64-bit mixes of such pairs, so a task doubles from 1 to 64 bytes on its own and any two tasks name equal strings
alike; beyond that Spark sorts the pairs, and positions leave as soon as they are alone or past the threshold.

A position for every byte would not fit in a few times the input, so positions are first taken in runs. Each window of
WINDOW bytes is filed under its anchor, the leftmost of its GRAM-byte strings with the least rank; equal windows have the
same anchor at the same place. Neighbouring windows with one anchor form a run, about one for 35 bytes.

1. Runs are sorted by (rank of the anchor's bytes, rank of the whole run's bytes, position). Of runs with the same pair all but
   the first are repeated as a whole; a run whose anchor bytes occur under no other pair is alone and leaves.
2. First runs that share an anchor with different runs are doubled outward: a window holds at least SIDE bytes left or right
   of its anchor, so pairs (anchor, SIDE bytes to a side) are sorted and runs alone on both sides leave.
3. Windows of what is left are sorted by (rank of 64 bytes, rank of 64 bytes at + 36); all but the first are repeated.

Repeated runs and windows become byte ranges, are united for each document and cut out. Anchors so frequent that one
would swell a task (estimated on a hash sample of documents, for balance only) are spread by salt in step 1 and their
first runs meet again afterwards. Ranks are 128 bits in every comparison that decides. Texts are shuffled once, into buckets by
document; steps 2, 3 and the cut visit them there, and only lists of places move.

Defined cases: null text is empty; texts shorter than the window lose nothing; position order is (doc_id, a hash of the
text where ids repeat, start), a null id as the least long; rows that repeat id and text are one document and report the same; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.llm.common import bucketed, mapped, materialize, release, steps, table, texts
from scholarlake.llm.shingles import _BASE, _BYTE, mix

WINDOW = 100
GRAM = 32
ANCHORS = WINDOW - GRAM + 1  # anchor places in a window
SIDE = (WINDOW - GRAM) // 2
LEAST = -(1 << 63)
#: Runs of one anchor beyond this share of all are spread over SALTS tasks.
HOT_SHARE = 1 / 2000
SALTS = 32
#: Text bytes of one numpy step: its arrays stay in a core's cache.
STEP = 64 << 10
_K = np.uint64(0xD1342543DE82EF95)


def double(ranks: np.ndarray, h: int) -> np.ndarray:
    """Ranks of 2h bytes from ranks of h bytes, along the last axis; shorter by h."""
    x = ranks[..., :-h] * _K
    x += ranks[..., h:]
    x ^= x >> np.uint64(32)
    x *= _BASE
    return x


def ranks_of(raw: np.ndarray, length: int) -> np.ndarray:
    ranks, h = _BYTE[raw], 1
    while h < length:
        ranks, h = double(ranks, h), 2 * h
    return ranks


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    h = 1
    while 2 * h <= width:
        x, h = np.minimum(x[:-h], x[h:]), 2 * h
    return np.minimum(x[: len(x) - (width - h)], x[width - h :]) if h < width else x


def runs_of(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the windows of texts laid end to end: first window, windows - 1, anchor place after the first window, rank of the anchor, rank of the run."""
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    if len(raw) < WINDOW:
        return none
    gram = ranks_of(raw, GRAM)
    wide = double(gram, GRAM)  # 64 bytes
    least = _sliding_min(gram, ANCHORS)
    valid = np.zeros(len(least) + 1, bool)
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a >= WINDOW:
            valid[a : b - WINDOW + 1] = True
    fresh = np.zeros(len(least) + 1, bool)
    fresh[1:-1] = least[1:] != least[:-1]
    fresh[begins[begins < len(fresh)]] = True
    fresh[-1] = True
    edge = fresh.copy()
    edge[1:] |= valid[1:] != valid[:-1]
    edge[0] = True
    cut = np.flatnonzero(edge)
    s, e = cut[:-1], cut[1:] - 1
    keep = valid[s]
    s, e = s[keep], e[keep]
    if not len(s):
        return none
    anchor = np.empty(len(s), np.int64)
    for at in range(0, len(s), 20_000):
        part = s[at : at + 20_000]
        anchor[at : at + 20_000] = part + (gram[part[:, None] + np.arange(ANCHORS)] == least[part][:, None]).argmax(1)
    tied = np.flatnonzero(e > anchor)
    if len(tied):  # the anchor's bytes occur again before the segment ends: cut behind each occurrence
        more_s, more_e, more_a = [], [], []
        for i in tied.tolist():
            a, b = int(s[i]), int(e[i])
            places = a + np.flatnonzero(gram[a : b + ANCHORS] == least[a])
            starts = np.concatenate([[a], places[:-1] + 1])
            fits = starts <= b
            more_s.append(starts[fits]), more_e.append(np.minimum(places[fits], b)), more_a.append(places[fits])
        rest = np.ones(len(s), bool)
        rest[tied] = False
        s, e, anchor = (np.concatenate([x[rest], *more]) for x, more in ((s, more_s), (e, more_e), (anchor, more_a)))
    size = e - s + WINDOW  # at most ANCHORS - 1 + WINDOW bytes, which three ranks of 64 bytes cover
    whole = mix(wide[s] * _K + wide[s + np.minimum(64, size - 64)])
    whole = mix(whole * _K + wide[s + size - 64] + (size * 256 + (anchor - s)).astype(np.uint64))
    return s, e - s, anchor - s, gram[anchor], whole


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Long texts in overlapping pieces, so that each window is in one of them."""
    size = 1 << 20
    for start in range(0, max(1, len(text) - WINDOW + 1), size):
        yield start, text[start : start + size + WINDOW - 1]


def _runs(part: pa.RecordBatch) -> pa.RecordBatch | None:
    out = []
    did, fp = part.column("did").to_numpy(), part.column("fp").to_numpy()
    all_texts = texts(part)
    small_ones = [i for i, t in enumerate(all_texts) if len(t) <= 1 << 20]
    jobs = [([(i, 0) for i in small_ones], [all_texts[i] for i in small_ones])] if small_ones else []
    jobs += [([(i, start)], [piece]) for i, t in enumerate(all_texts) if len(t) > 1 << 20 for start, piece in _pieces(t)]
    for owners, pieces in jobs:
        sizes = np.array([len(x) for x in pieces])
        ends = np.cumsum(sizes)
        s, span, place, gram, whole = runs_of(np.frombuffer(b"".join(pieces), np.uint8), ends - sizes, ends)
        owner = np.searchsorted(ends, s, side="right")
        row = np.array([i for i, _ in owners], np.int64)[owner]
        start = s - (ends - sizes)[owner] + np.array([x for _, x in owners], np.int64)[owner]
        out.append((gram.view(np.int64), whole.view(np.int64), did[row], fp[row], (start << 16) | (span << 8) | place))
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["g", "x", "did", "fp", "at"])


RUN = "g long, x long, did long, fp long, at long"


def _firsts(columns: int, salted: np.ndarray | None):
    """Over rows sorted by their first two columns (a pair of ranks), then position. kind 0: repeated; 1: the first of a
    pair whose first column has another pair, too; 2: the first of a pair under a salted first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: np.ndarray | None = None  # the last row
        pending: np.ndarray | None = None  # the last first, and whether the one before has the same first column

        def out(rows: np.ndarray, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in rows.T), pa.array(np.full(len(rows), kind, np.int32))], [*"abcdefgh"[:columns], "kind"])

        def split(rows: np.ndarray, shares: np.ndarray) -> Iterator[pa.RecordBatch]:
            hot = np.isin(rows[:, 0], salted) if salted is not None else np.zeros(len(rows), bool)
            for kind, chosen in ((1, rows[shares & ~hot]), (2, rows[hot])):
                if len(chosen):
                    yield out(chosen, kind)

        was_equal = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            before = np.concatenate([rows[:1] if last is None else last[None, :], rows[:-1]])
            equal = rows == before
            same = equal[:, :2].all(1)
            again = equal.all(1)  # the same document listed twice
            if last is None:
                same[0] = again[0] = False
            last = rows[-1]
            repeats = rows[same & ~again]
            if len(repeats):
                yield out(repeats, 0)
            firsts = rows[~same]
            if not len(firsts):
                continue
            if pending is not None:
                firsts = np.concatenate([pending, firsts])
            next_equal = firsts[1:, 0] == firsts[:-1, 0]
            prev_equal = np.concatenate([[was_equal], next_equal])
            pending, was_equal = firsts[-1:], bool(prev_equal[-1])
            yield from split(firsts[:-1], prev_equal[:-1] | next_equal)
        if pending is not None:
            yield from split(pending, np.array([was_equal]))

    return run


def _sorted_firsts(rows: DataFrame, keys: list[str], salted: list[int] | None = None) -> DataFrame:
    """rows' columns and kind; keys decide the task, columns the order."""
    names = [c for c in rows.columns if c != "salt"]
    hot = np.array(sorted(salted), np.int64) if salted else None
    ordered = rows.repartition(*keys).sortWithinPartitions(*names)
    back = ordered.select(*names).mapInArrow(_firsts(len(names), hot), ", ".join(f"{c} long" for c in "abcdefgh"[: len(names)]) + ", kind int")
    return back.toDF(*names, "kind")


def _hot_anchors(keyed: DataFrame) -> list[int]:
    """Anchors over HOT_SHARE of the runs of every 16th document by hash: at most 1/HOT_SHARE of them; for balance only."""
    sample = mapped(keyed.where("pmod(xxhash64(did, 5), 16) = 0"), _runs, RUN, limit=STEP)
    counts = sample.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.where("n >= 8"), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r.g for r in counts.where(F.col("n") > max(64, total * HOT_SHARE * 4)).orderBy(F.desc("n")).limit(int(1 / HOT_SHARE)).collect()]


def _around(part: pa.RecordBatch, want: str) -> pa.RecordBatch | None:
    """For each listed run of each text, with want 'sides': ranks of SIDE bytes left and right of its anchor (0 where the
    text ends before); with want 'windows': the two ranks of each of its windows."""
    out = []
    for text, did, fp, runs in zip(texts(part), part.column("did").to_pylist(), part.column("fp").to_pylist(), part.column("runs").to_pylist(), strict=True):
        raw = np.frombuffer(text, np.uint8)
        for cut in range(0, len(runs), 4096):
            at = np.array([r["at"] for r in runs[cut : cut + 4096]], np.int64)
            start, span, place = at >> 16, (at >> 8) & 255, at & 255
            if want == "sides":
                anchor = start + place
                both = []
                for first in (anchor - SIDE, anchor + GRAM):
                    inside = (first >= 0) & (first + SIDE <= len(raw))
                    ranks = ranks_of(raw[np.where(inside, first, 0)[:, None] + np.arange(SIDE)], 32)
                    both.append(np.where(inside, mix(ranks[:, 0] * _K + ranks[:, SIDE - 32]), np.uint64(0)))
                grams = np.array([r["g"] for r in runs[cut : cut + 4096]], np.int64)
                out.append((grams, both[0].view(np.int64), both[1].view(np.int64), np.full(len(at), did), np.full(len(at), fp), at))
            else:
                width = ANCHORS - 1 + WINDOW
                ranks = ranks_of(raw[np.minimum(start[:, None] + np.arange(width), len(raw) - 1)], 64)
                here = np.arange(ANCHORS) <= span[:, None]
                sides = np.array([r["sides"] for r in runs[cut : cut + 4096]], np.int64)
                left = place[:, None] - np.arange(ANCHORS)  # bytes before the anchor
                here &= ((left >= SIDE) & (sides[:, None] & 1 > 0)) | ((ANCHORS - 1 - left >= SIDE) & (sides[:, None] & 2 > 0))
                first, second = ranks[:, :ANCHORS], ranks[:, WINDOW - 64 : WINDOW - 64 + ANCHORS]
                pos = (start[:, None] + np.arange(ANCHORS))[here]
                out.append((first[here].view(np.int64), second[here].view(np.int64), np.full(len(pos), did), np.full(len(pos), fp), pos))
    if not out:
        return None
    names = ["g", "left", "right", "did", "fp", "at"] if want == "sides" else ["r", "r2", "did", "fp", "p"]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names)


def _with_lists(keyed: DataFrame, rows: DataFrame, entry: list[str], name: str) -> DataFrame:
    """Texts joined with their documents' lists of entries, which move to the texts' buckets."""
    return keyed.join(rows.groupBy("did", "fp").agg(F.collect_list(F.struct(*entry)).alias(name)), ["did", "fp"])


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> texts in buckets of (did, fp), and repeated byte ranges (did, fp, start, size), which may overlap."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("did")
    many = not docs.groupBy(did).count().where("count > 1").isEmpty()
    fp = F.xxhash64("text") if many else F.lit(0).cast("long")
    source = docs.select(did, fp.alias("fp"), "text")
    hot = _hot_anchors(source)
    runs = mapped(source, _runs, RUN, limit=STEP)
    hot_g = F.col("g").isin(hot) if hot else F.lit(False)
    salted = runs.withColumn("salt", F.when(hot_g, F.pmod(F.xxhash64("did", "at"), F.lit(SALTS))).otherwise(0))
    sorted_runs = materialize(_sorted_firsts(salted, ["g", "salt"], hot), "runs")
    if hot:  # firsts of hot anchors within their salts meet by pair; that their anchor has other pairs is taken for granted
        again = _sorted_firsts(sorted_runs.where("kind = 2").drop("kind"), ["g", "x"], hot).withColumn("kind", F.least("kind", F.lit(1)))
        sorted_runs = materialize(sorted_runs.where("kind < 2").unionByName(again), "runs")
    release(docs.sparkSession)
    keyed = bucketed(docs.select("doc_id", did, fp.alias("fp"), "text"), "texts", ["did", "fp"])  # the only shuffle of texts
    release(docs.sparkSession)
    whole = sorted_runs.where("kind = 0").select("did", "fp", F.shiftright("at", 16).alias("start"), (F.shiftright("at", 8).bitwiseAND(255) + WINDOW).alias("size"))
    firsts = sorted_runs.where("kind = 1").select("g", "did", "fp", "at")
    sides = materialize(mapped(_with_lists(keyed, firsts, ["g", "at"], "runs"), lambda b: _around(b, "sides"), "g long, left long, right long, did long, fp long, at long"), "sides")
    # a run stays on a side where another one has the same pair (anchor, bytes of that side)
    shared = None
    for bit, side in ((1, "left"), (2, "right")):
        pair = sides.where(F.col(side) != 0).groupBy("g", side).count().where("count > 1").select("g", side)
        found = sides.join(pair, ["g", side]).select("did", "fp", "at", F.lit(bit).alias("sides"))
        shared = found if shared is None else shared.unionByName(found)
    shared = materialize(shared.groupBy("did", "fp", "at").agg(F.sum("sides").alias("sides")), "shared")
    release(docs.sparkSession)
    windows = mapped(_with_lists(keyed, shared, ["at", "sides"], "runs"), lambda b: _around(b, "windows"), "r long, r2 long, did long, fp long, p long")
    single = _sorted_firsts(windows, ["r", "r2"]).where("kind = 0").select("did", "fp", F.col("p").alias("start"), F.lit(WINDOW).alias("size"))
    return keyed, whole.unionByName(single)


def united(ranges: DataFrame) -> DataFrame:
    """did, fp, spans: sorted disjoint maximal (start, size) of each document."""
    by = Window.partitionBy("did", "fp").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    reached = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("opens", F.when(F.col("start") <= reached, 0).otherwise(1))
    spans = opened.withColumn("span", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("did", "fp", "span").agg(
        F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("size")
    )
    return spans.groupBy("did", "fp").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start and size in bytes, in order) and kept (bytes left) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed, ranges = repeated_ranges(rows)
    spans = materialize(united(ranges), "spans")
    release(docs.sparkSession)
    keyed = keyed.join(spans, ["did", "fp"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                kept, sizes = [], []
                spans = part.column("spans").to_pylist()
                for text, cuts in zip(texts(part), spans, strict=True):
                    at, left = 0, []
                    for cut in cuts or ():
                        left.append(text[at : cut["start"]])
                        at = cut["start"] + cut["size"]
                    left.append(text[at:])
                    kept.append(b"".join(left)), sizes.append(len(text))
                total, n = pa.array(sizes, pa.int64()), pa.array([len(x) for x in kept], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), total, pa.array(np.array(total) - np.array(n)), pa.array([len(c or ()) for c in spans], pa.int64()), part.column("spans"), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    return keyed.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,size:long>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
