"""LM scoring by a hidden Markov language model.

Words of the training rows are counted over all of them. The TOP most frequent words and the end of a text are emission
classes of their own; all other words, seen or not, fall into BUCKETS classes by a hash of their last three bytes, in
which a word has the share (c + 1) / (C + V + 1) of its class (c its count, C and V the class's tokens and distinct
words), so the model is a proper distribution over known words and one unknown word for each class.

Baum-Welch runs over all training rows: each task adds up the expected counts of its rows, the sums over tasks make the
next model (emissions of a state are smoothed by the corpus's). Expected counts are those of whole texts: long texts are
worked on in segments of SEGMENT tokens side by side, for which the products of their steps first carry forward and
backward messages over the cuts, so a worker's memory is bounded and the counts are as without cuts. Scoring runs the
scaled forward recursion over whole texts and is exact.

Word counts of the most frequent words, DICTIONARY at most (words of a count are carried all or none; about 10 MB), travel
with the tasks; each other occurrence meets its count in a shuffled join, so base scores and class shares are exact for
every word.

Defined cases: null text is the empty text (one token, its end); rows with a null id are learned from; repeated rows
count as often as they occur; ties in frequency go by the word's bytes; without training rows counts are 0 and the
model is uniform; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.common import WIDE_ROWS, batches_of, fold, frequent_from, materialize, steps, table, texts

TOP = 16_384
BUCKETS = 2_048
DICTIONARY = 1 << 18
STATES = 8
ROUNDS = 5
SEGMENT = 1_024
#: Tokens of one vectorized step.
BATCH_TOKENS = 400_000
#: Weight of the corpus's distribution in each state's emissions.
PRIOR = 200.0


def words_of(text: bytes) -> list[bytes]:
    """A-Z lowered; runs of bytes other than space and 9 to 13."""
    return text.lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for part in steps(batch):
            for text in texts(part):
                held.update(words_of(text))
            if len(held) > 250_000:
                yield flush()
                held.clear()
    yield flush()


@dataclass(frozen=True)
class Counts:
    """What tasks know of the training counts; all sizes are bounded by the constants above."""

    blob: bytes  # dictionary words by falling count, joined by line feeds
    counts: np.ndarray
    bucket_total: np.ndarray  # C + V + 1 of each bucket, of words outside the top
    ends: int
    tokens: int
    distinct: int
    top: int

    @property
    def classes(self) -> int:
        return self.top + BUCKETS + 1


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


@functools.lru_cache(maxsize=1)
def _index(blob: bytes) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(blob.split(b"\n"))} if blob else {}


def count_words(train: DataFrame, dictionary: int = DICTIONARY, top: int = TOP) -> tuple[DataFrame, Counts]:
    """The whole table of word counts (word, n), and what of it tasks carry."""
    vocabulary = materialize(train.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words", WIDE_ROWS)
    ends = train.count()
    whole = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    frequent = vocabulary.where(F.col("n") >= frequent_from(vocabulary, "n", dictionary)).toArrow()  # at most `dictionary` rows
    listed = sorted(zip((-x for x in frequent["n"].to_pylist()), frequent["word"].to_pylist(), strict=True))
    words, n = [w for _, w in listed], np.array([-x for x, _ in listed], np.int64)
    bucket = (F.crc32(F.expr("substring(word, -3, 3)")) % BUCKETS).cast("int").alias("bucket")
    per = vocabulary.groupBy(bucket).agg((F.sum("n") + F.count(F.lit(1))).alias("total")).collect()  # at most BUCKETS rows
    total = np.zeros(BUCKETS)
    for row in per:
        total[row.bucket] = row.total
    top = min(top, len(words))
    np.subtract.at(total, np.array([bucket_of(w) for w in words[:top]], np.int64), n[:top] + 1)
    return vocabulary, Counts(b"\n".join(words), n, total + 1, ends, (whole.n or 0) + ends, whole.v + (ends > 0), top)


def encode(docs: DataFrame, counts: Counts) -> DataFrame:
    """doc_id, held_out, ids (emission classes), n_tokens, n_known, base and within (log10 sums without rare words), rare."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        get = _index(c.blob).get
        log_count = np.log10(c.counts + 1.0)
        buckets = np.array([bucket_of(w) for w in _index(c.blob)], np.int64)
        class_of = np.where(np.arange(len(c.counts)) < c.top, np.arange(len(c.counts)), c.top + buckets).astype(np.int32) if len(c.counts) else np.empty(0, np.int32)
        log_total = np.log10(c.bucket_total)
        end_known, end_log = int(c.ends > 0), np.log10(c.ends + 1.0)
        for batch in batches:
            for part in steps(batch):
                ids, known, base, within, rare = [], [], [], [], []
                for text in texts(part):
                    words = words_of(text)
                    at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    missing = np.flatnonzero(at < 0)
                    unknown = [words[i] for i in missing]
                    k = np.empty(len(words) + 1, np.int32)
                    k[-1] = c.top + BUCKETS
                    there = at >= 0
                    k[:-1][there] = class_of[at[there]]
                    k[missing] = [c.top + bucket_of(w) for w in unknown]
                    logs = log_count[at[there]]
                    pooled = k[:-1] >= c.top
                    ids.append(k), rare.append(unknown)
                    known.append(int(there.sum()) + end_known)
                    base.append(float(logs.sum() + end_log))
                    within.append(float(logs[at[there] >= c.top].sum() - log_total[k[:-1][pooled] - c.top].sum()))
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.array(known, pa.int64()),
                        pa.array(base),
                        pa.array(within),
                        pa.array(rare, pa.list_(pa.binary())),
                    ],
                    ["doc_id", "held_out", "ids", "n_tokens", "n_known", "base", "within", "rare"],
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, ids array<int>, n_tokens long, n_known long, base double, within double, rare array<binary>"
    )


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states


class _Ragged:
    """Sequences in time-major order, the longest first; at step t the first `active[t]` are still running."""

    def __init__(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[self.order], sizes[self.order]
        longest = int(sizes[0])
        self.active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        step = np.repeat(np.arange(longest), self.active)
        rank = np.arange(self.offset[-1]) - self.offset[step]
        self.ids = flat[begins[rank] + step]


def log10_likelihood(model: Hmm, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Exact log10 P of each sequence (sizes at least 1), by the scaled forward recursion."""
    r = _Ragged(flat, begins, sizes)
    scale = np.empty(len(r.ids))
    a = np.repeat(model.start[None, :], len(sizes), 0)
    for t, n in enumerate(r.active):
        at = r.offset[t]
        a = (a[:n] @ model.move if t else a) * model.emit[r.ids[at : at + n]]
        c = a.sum(1)
        scale[at : at + n] = c
        a /= c[:, None]
    rank = np.arange(len(r.ids)) - np.repeat(r.offset[:-1], r.active)
    out = np.empty(len(sizes))
    out[r.order] = np.bincount(rank, np.log10(scale), minlength=len(sizes))
    return out


def expected_counts(model: Hmm, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, emitted: np.ndarray, opening: np.ndarray | None = None, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and moves expected for the sequences; emissions are added to `emitted`. opening: which sequences open a text (all,
    if not given); the others have no part in the starts. enter, leave: messages() of each sequence; without them those that
    do not open a text start from the stationary distribution, and all end as texts do."""
    r = _Ragged(flat, begins, sizes)
    states = model.move.shape[0]
    move = model.move.astype(np.float32)
    seen = model.emit.astype(np.float32)[r.ids]
    alpha = np.empty((len(r.ids), states), np.float32)
    scale = np.empty((len(r.ids), 1), np.float32)
    opens = np.ones(len(sizes), bool) if opening is None else opening[r.order]
    if enter is None:
        enter = np.where(opens[:, None], model.start, np.linalg.matrix_power(model.move, 256)[0])
    else:
        enter = enter[r.order]
    after = np.ones((len(sizes), states), np.float32) if leave is None else leave[r.order].astype(np.float32)
    a = enter.astype(np.float32)
    for t, n in enumerate(r.active):
        here = slice(r.offset[t], r.offset[t] + n)
        a = (a[:n] @ move if t else a) * seen[here]
        c = a.sum(1, keepdims=True)
        a = a / c
        alpha[here], scale[here] = a, c
    seen /= scale
    moves = np.zeros((states, states))
    beta = np.empty((0, states), np.float32)
    for t in range(len(r.active) - 1, -1, -1):
        n, at = int(r.active[t]), int(r.offset[t])
        held = len(beta)
        if held:
            ahead = seen[r.offset[t + 1] : r.offset[t + 1] + held] * beta
            moves += alpha[at : at + held].T @ ahead
            beta = ahead @ move.T
        if n > held:  # these sequences end here; their posteriors sum to 1
            last = after[held:n]
            beta = np.concatenate([beta, last / (alpha[at + held : at + n] * last).sum(1, keepdims=True)])
        alpha[at : at + n] *= beta  # posteriors in place
    for s in range(states):
        emitted[:, s] += np.bincount(r.ids, alpha[:, s], minlength=len(emitted))
    return alpha[: int(r.active[0])][opens].sum(0, dtype=np.float64), moves * model.move


def _products(model: Hmm, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each sequence the matrix that takes the state weights before its first emission to those after its last, scaled."""
    r = _Ragged(flat, begins, sizes)
    states = model.move.shape[0]
    move = model.move.astype(np.float32)
    emit = (model.emit / model.emit.max(1, keepdims=True)).astype(np.float32)
    out = np.empty((len(sizes), states, states))
    p = np.repeat(np.eye(states, dtype=np.float32)[None], len(sizes), 0)
    for t, n in enumerate(r.active):
        out[r.order[n : len(p)]] = p[n:]
        if t:
            p = (p[:n].reshape(-1, states) @ move).reshape(n, states, states)
        p = p * emit[r.ids[r.offset[t] : r.offset[t] + n], None, :]
        if t % 4 == 3:
            p /= p.sum((1, 2), keepdims=True)
    out[r.order[: len(p)]] = p
    return out / out.sum((1, 2), keepdims=True)


def messages(model: Hmm, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment the state weights before its first emission and the backward weights after its last, as the rest of its
    text has them; and the moves expected across the cuts. Segments of a text follow each other, the first one opens it."""
    states = len(model.start)
    enter, leave, across = np.repeat(model.start[None, :], len(sizes), 0), np.ones((len(sizes), states)), np.zeros((states, states))
    goes_on = np.append(~opening[1:], False)
    cut = np.flatnonzero(~opening | goes_on)
    through = {}
    for part in _cut(sizes[cut], BATCH_TOKENS):
        through.update(zip(cut[part].tolist(), _products(model, flat, begins[cut[part]], sizes[cut[part]]), strict=True))
    for j in cut.tolist():
        if not opening[j]:
            a = enter[j - 1] @ through[j - 1] @ model.move
            enter[j] = a / a.sum()
    for j in cut[::-1].tolist():
        if goes_on[j]:
            ahead = through[j + 1] @ leave[j + 1]
            back = model.move @ ahead
            leave[j] = back / back.sum()
            both = (enter[j] @ through[j])[:, None] * model.move * ahead
            across += both / both.sum()
    return enter, leave, across


def _segments(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids, and of each segment where it begins, its size, and whether it opens a text."""
    ids = batch.column("ids")
    flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    begins = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    stop = np.repeat(ends[1:], -(-np.diff(ends) // SEGMENT))
    return flat, begins, np.minimum(stop - begins, SEGMENT), np.isin(begins, ends[:-1])


def _cut(sizes: np.ndarray, limit: int) -> list[slice]:
    """Runs of sequences with about `limit` tokens."""
    total, out, start = np.cumsum(sizes), [], 0
    while start < len(sizes):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
        out.append(slice(start, end))
        start = end
    return out


def baum_welch(coded: DataFrame, classes: int, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """coded: ids of the training rows. Each round reads all of them and gathers classes x states sums."""
    spark = coded.sparkSession
    rng = np.random.default_rng(11)
    tilt = np.exp(0.5 * rng.standard_normal((classes, states)))
    columns = [f"s{i}" for i in range(states)]
    model, corpus = None, None
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            emitted, moves, starts = np.zeros((classes, states)), np.zeros((states, states)), np.zeros(states)
            for batch in batches:
                flat, begins, sizes, opening = _segments(batch)
                if m is None:  # the first round counts the classes themselves
                    emitted[:, 0] += np.bincount(flat, minlength=classes)
                    continue
                enter, leave, across = messages(m, flat, begins, sizes, opening)
                moves += across
                for part in _cut(sizes, BATCH_TOKENS):
                    s, v = expected_counts(m, flat, begins[part], sizes[part], emitted, opening[part], enter[part], leave[part])
                    starts, moves = starts + s, moves + v
            rows = np.concatenate([emitted, moves, starts[None, :]])
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(rows[some, i]) for i in range(states))], ["row", *columns])

        added = coded.select("ids").mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in columns)).groupBy("row").agg(*(F.sum(c).alias(c) for c in columns))
        with batches_of(spark, WIDE_ROWS):
            sums = added.toArrow()  # a row for each class
        rows = np.zeros((classes + states + 1, states))
        rows[np.array(sums["row"].to_pylist(), np.int64)] = np.stack([np.array(sums[c].to_pylist(), float) for c in columns], 1) if sums.num_rows else 0
        shared.unpersist()
        if model is None:
            n = rows[:classes, 0] + 0.5
            corpus = n / n.sum()
            emit = corpus[:, None] * tilt
            model = Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1)), emit / emit.sum(0))
            continue
        emit = rows[:classes] + PRIOR * corpus[:, None]
        move, start = rows[classes : classes + states] + 1.0, rows[-1] + 1.0
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def _forward(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        sizes = np.diff(ends)
        scores = [log10_likelihood(model, flat, ends[:-1][part], sizes[part]) for part in _cut(sizes, 5 * BATCH_TOKENS)]
        out = np.concatenate(scores) if scores else np.empty(0)
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "ids"), pa.array(out)], [*(n for n in batch.schema.names if n != "ids"), "classes_score"])


def score_texts(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    vocabulary, counts = count_words(rows.where("NOT held_out"))
    coded = materialize(encode(rows, counts).withColumn("row_no", F.monotonically_increasing_id()), "coded", WIDE_ROWS)
    model = baum_welch(coded.where("NOT held_out"), counts.classes, states, rounds)
    # occurrences of words outside the dictionary meet their counts
    rare = coded.select("row_no", F.explode("rare").alias("word")).join(vocabulary, "word", "left")
    rare = rare.groupBy("row_no").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_log"), F.count("n").alias("rare_known"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "row_no long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double"
    scored = coded.select(*(x.split()[0] for x in fields.split(", ")), "ids").mapInArrow(lambda b: _forward(b, shared), fields + ", classes_score double")
    scored = materialize(scored, "scored", WIDE_ROWS)
    more = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare, "row_no", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * float(np.log10(counts.tokens + counts.distinct + 1))).alias("base_score"),
        (F.col("classes_score") + F.col("within") + more).alias("score"),
    )


def op5_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 7) == 2)
