"""Quality classifier by Bradley-Terry pairwise ranking.

A document's worth is w.x over features of its whole text. w is learned from preference pairs (a row labelled good is
preferred to one labelled bad) by logistic loss on feature differences, solved by Newton steps with an L2 term. The
decision is a quantile of the training rows' worths, by default at the share of them that is labelled bad; a logistic
map around it gives the 0..1 score, placed so that the quantile falls on the decision value.

Features are standardised on the training rows and clipped to REACH deviations, so that a text far outside their range (a
very long one, say) is not judged by a single feature.

Training reads a bounded sample of the labelled rows (MAX_LABELLED, those with the smallest hash of their id) and forms
MAX_PAIRS pairs; scoring covers every row and whole texts. Inputs of a score are the text's bytes and nothing else.

Defined cases: null or empty text has the features of the empty text and is scored like any other; rows without a
label or with a null id are scored, not learned from; an id that occurs with several texts is learned from once, by the
least of them; without both kinds of labels all scores are 0.5; repeated rows are scored alike; very long texts are
scored whole; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.common import fold, mapped, small, table, texts

MAX_LABELLED = 20_000
MAX_PAIRS = 200_000
#: Hashed byte pairs beside the named features.
PAIR_CELLS = 64
DECISION = 0.3
#: Standardised features are clipped to this many deviations.
REACH = 3.0

_PUNCT = [bytes([c]) for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
_SHOUT = re.compile(rb"[A-Z]{2,}")
_CLASSES = np.zeros((256, 8 + len(_PUNCT)))
for _c in range(256):
    _kind = 0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c == 32 else 4 if _c == 10 else 5 if _c >= 128 else 6 if _c < 32 else 7
    _CLASSES[_c, _kind] = 1
for _i, _p in enumerate(_PUNCT):
    _CLASSES[_p[0], 8 + _i] = 1


def features(text: bytes) -> np.ndarray:
    """Shares of byte classes, word and line shape, repetition, and a small hash of byte pairs, of the whole text."""
    raw = np.frombuffer(text, np.uint8)
    n = max(1, len(raw))
    share = np.sqrt((np.bincount(raw, minlength=256) @ _CLASSES) / n)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    shape = [
        np.log1p(len(raw)) / 10,
        np.log1p(len(words)) / 10,
        len(raw) / w / 20,
        len(set(words)) / w,
        len(set(lines)) / k,
        np.log1p(len(raw) / k) / 10,
        np.sqrt(len(_SHOUT.findall(text)) / w),
        float(not words),
    ]
    pairs = np.bincount((raw[:-1].astype(np.uint32) * 31 + raw[1:] * 7) % PAIR_CELLS, minlength=PAIR_CELLS) / n if len(raw) > 1 else np.zeros(PAIR_CELLS)
    return np.concatenate([share, shape, np.sqrt(pairs)])


N_FEATURES = len(features(b""))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -REACH, REACH)


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    decision: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = standard(x, self.mean, self.scale) @ self.weights
        at = np.log(self.decision / (1 - self.decision))
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.cut) + at, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, decision: float = DECISION, max_pairs: int = MAX_PAIRS, l2: float = 1e-3, rounds: int = 12, quantile: float | None = None) -> Ranker | None:
    """None without both kinds of labels. quantile: of the training rows' worths; the share labelled bad if not given."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = standard(x, mean, scale)
    rng = np.random.default_rng(7)
    a, b = rng.choice(good, max_pairs), rng.choice(bad, max_pairs)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        gradient, hessian = l2 * w, l2 * np.eye(len(w))
        for at in range(0, max_pairs, 20_000):
            d = z[a[at : at + 20_000]] - z[b[at : at + 20_000]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
            gradient = gradient - d.T @ (1 - p) / max_pairs
            hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d / max_pairs
        step = np.linalg.solve(hessian + 1e-6 * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    s = z @ w
    ranked = np.sort(s)
    below = min(max(round((len(bad) / (len(good) + len(bad)) if quantile is None else quantile) * len(s)), 0), len(s) - 1)
    cut = float((ranked[max(below - 1, 0)] + ranked[below]) / 2)
    spread = float(np.median(s[good]) - np.median(s[bad]))
    return Ranker(mean, scale, w, cut, 6 / max(spread, 1e-6), decision)


def _features_of(rows: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.concatenate([features(t) for t in texts(batch)])
        return pa.RecordBatch.from_arrays([batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(out), N_FEATURES).cast(pa.list_(pa.float64()))], ["y", "x"])

    return mapped(rows.select("text", "y"), run, "y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, decision: float = DECISION) -> Ranker | None:
    """docs: doc_id, text; labels: doc_id, quality, already restricted to the rows that may be learned from."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # the documented bound
    known = docs.select("doc_id", "text").join(small(chosen, 24), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    rows = _features_of(known).toArrow()  # at most max_labelled rows
    if not rows.num_rows:
        return None
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(rows.num_rows, N_FEATURES)
    y = np.array(rows["y"])
    order = np.lexsort([*x.T[:12], y])  # the order in which tasks end does not matter
    return fit(x[order], y[order], decision)


def score_quality(docs: DataFrame, ranker: Ranker | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([features(t) for t in texts(batch)])
        s = ranker.score(x) if ranker else np.full(len(x), 0.5)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, "doc_id long, score double")


def quality_filter(docs: DataFrame, ranker: Ranker | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least the ranker's decision value, with their columns as they are."""
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = ranker.score(np.stack([features(t) for t in texts(batch, text_col)])) if ranker else np.ones(batch.num_rows)
        return batch.filter(pa.array(s >= (ranker.decision if ranker else 0)))

    return mapped(docs, run, schema, text_col)


def learned_from(labels: DataFrame) -> DataFrame:
    return labels.where(fold("doc_id", 5) != 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = train(docs, learned_from(table(spark, sf_dir, "labels")))
    return score_quality(docs, ranker).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted")
    )
