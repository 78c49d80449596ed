"""Benchmark decontamination by latent semantic retrieval.

Words are lower-cased runs between white space and ASCII punctuation. Documents become word ids of the benchmark's
vocabulary once (other words keep their place as -1). Passages are windows of two neighbouring STRIDE-word chunks.

Randomised SVD of the TF-IDF matrix A of all documents' passages, laid end to end (columns: benchmark words in at most
STOP_SHARE of all chunks, weighted by their inverse chunk frequency). Omega is a sparse sign matrix, so A'A Omega is a sum
over pairs of words of a passage: every task adds up its part (words x SKETCH numbers) in one pass, and a Nystroem step
turns the sum into A's leading RANK right singular vectors and singular values. Items have no part in it. Passages and items are projected,
both normed there, and pairs with a cosine of at least COSINE are candidates, as are pairs where the passage's part along
the item has COVERED of the item's length (a copy among rarer words). Items whose words are nearly all that frequent (they stand in
many copies themselves) keep the weights of all their words.

The space is the search: what it does not bring together is not compared. It keeps little of an item whose words few
passages share, so items that keep less than KEPT of their norm in it are searched for by an exact bound instead: a
region that matches PARAPHRASE of an item's words holds enough of its rarest words, however its other words are chosen
(`Overlap`). With exact=True that bound adds its candidates for all items.

A candidate is a leak if the longest common subsequence of the item and the passage with a chunk on either side, or as
many chunks as the item has if it is longer than a passage (`reach`), reaches SURE of the item's words, or PARAPHRASE of them and half of the item's answer: the ANSWER_WORDS rarest words of its
last sentence.

The benchmark is read in blocks of about ITEMS distinct rows and BLOCK_WORDS words, each with its own passes and space, so its size is no bound.
With space="joint" candidates are searched in the span of all items of a block and the passages' leading directions
instead, where projecting loses nothing of an item (plain TF-IDF cosines between items and passages, normed in the span).

Defined cases: null texts are empty and hold nothing; items of fewer than LEAST_WORDS words are not searched for; rows
that repeat an item or a document's id are merged into one result row with the best match; a null doc_id is reported as
null; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.common import mapped, materialize, table, texts, without_ids

STRIDE = 24
STOP_SHARE = 0.02
#: Columns of the random sign matrix, signs in each of its rows, and singular vectors kept.
SKETCH, SIGNS, RANK = 512, 1, 320
#: Columns of the dense random matrix of the joint space.
JOINT_SKETCH = 64
COSINE = 0.4
#: A passage whose part along an item is at least so much of the item's length is a candidate too, whatever else it holds.
COVERED = 0.8
#: Items that keep a smaller share of their norm in the space are searched for by the exact bound.
KEPT = 0.2
SURE, PARAPHRASE = 0.8, 0.6
ANSWER_WORDS = 4
LEAST_WORDS = 5
#: Items with a smaller share of weighted words get the weights of all their words, of LEAST_WEIGHT at least.
WEIGHTED, LEAST_WEIGHT = 0.25, 0.1
#: Items of a block and their words.
ITEMS, BLOCK_WORDS = 512, 40_000

_SPLIT = bytes(32 if chr(b) in string.punctuation else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


@dataclass(frozen=True)
class Items:
    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]  # words of the last sentence
    vocabulary: dict[bytes, int]

    def vectors(self, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.ids), len(self.vocabulary)), np.float32)
        for row, words in zip(out, self.words, strict=True):
            np.add.at(row, words, weight[words])
        return out


def read_items(rows: list) -> Items:
    vocabulary: dict[bytes, int] = {}
    ids, words, answers = [], [], []
    for row in rows:
        found = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(row.text or "")]
        if len(found) < LEAST_WORDS:
            continue
        sentences = [s for s in row.text.replace("\n", " ").split(". ") if words_of(s)]
        ids.append(row.item_id), words.append(found)
        answers.append([vocabulary[w] for w in words_of(sentences[-1])])
    return Items(ids, words, answers, vocabulary)


def reach(n: int) -> int:
    """Chunks on either side of a passage that an item of n words is compared with."""
    return 1 if n <= 2 * STRIDE else -(-n // STRIDE)


def _code(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = shared.value.get
        ids = []
        for text in batch.column("text").to_pylist():
            words = words_of(text or "")
            ids.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    return materialize(mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>"), "words")


@dataclass
class Chunks:
    """Words of some documents by chunk: `word` and `chunk` of each benchmark word, the first chunk of each document, and document of each chunk."""

    word: np.ndarray
    chunk: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    flat: np.ndarray
    ends: np.ndarray

    def windows(self, per_chunk: np.ndarray) -> np.ndarray:
        """Sums over each chunk and its successor in the same document; the row of a document's last chunk is that chunk alone."""
        out = per_chunk.copy()
        follows = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        out[follows] += per_chunk[follows + 1]
        return out


def _chunks(batches: Iterator[pa.RecordBatch], limit: int = 300_000) -> Iterator[tuple[pa.RecordBatch, Chunks]]:
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy().astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
            e = ends[start : stop + 1] - ends[start]
            f = flat[ends[start] : ends[stop]]
            sizes = np.diff(e)
            counts = np.maximum(1, -(-sizes // STRIDE))
            first = np.concatenate([[0], np.cumsum(counts)])
            at = np.flatnonzero(f >= 0)
            of = np.searchsorted(e, at, side="right") - 1
            yield batch.slice(start, stop - start), Chunks(f[at], (first[of] + (at - e[of]) // STRIDE).astype(np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), counts), first, f, e)
            start = stop


def _bag(c: Chunks, rows: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Sum of rows[word] for each chunk, over kept words."""
    out = np.zeros((len(c.doc), rows.shape[1]), np.float32)
    word, chunk = c.word[keep], c.chunk[keep]
    for start in range(0, len(word), 2_000):  # the rows of a step stay in a core's cache
        w, k = word[start : start + 2_000], chunk[start : start + 2_000]
        begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out[k[begins]] += np.add.reduceat(rows[w], begins, axis=0)
    return out


def passage_counts(coded: DataFrame, n_words: int) -> tuple[int, np.ndarray]:
    """All chunks, and those that hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_words + 1, np.int64)
        for _, c in _chunks(batches):
            n = len(c.doc)
            place = c.word.astype(np.int32 if n_words * n < 1 << 31 else np.int64) * n + c.chunk
            held[:-1] += np.bincount(np.unique(place) // n, minlength=n_words)
            held[-1] += n
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["word", "n"])

    rows = coded.select("ids").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # a row for each benchmark word
    out = np.zeros(n_words + 1, np.int64)
    out[np.array(rows["word"].to_pylist(), np.int64)] = np.array(rows["n"].to_pylist(), np.int64)
    return int(out[-1]), out[:-1]


def _passage_pairs(c: Chunks, keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words of each passage of two neighbouring chunks, passages laid end to end, in steps of about a million pairs."""
    word, chunk = c.word[keep].astype(np.int64), c.chunk[keep]
    if not len(word):
        return
    passage = chunk - ((chunk - c.first[c.doc[chunk]]) & 1)
    begins = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    size = np.diff(np.concatenate([begins, [len(word)]]))
    done = np.cumsum(size * size)
    start = 0
    while start < len(begins):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + 1_000_000, side="right")))
        each = np.repeat(size[start:stop], size[start:stop])  # of each word, the words of its passage
        one = np.repeat(np.arange(begins[start], begins[start] + len(each)), each)
        base = np.repeat(np.repeat(begins[start:stop], size[start:stop]), each)
        ends = np.cumsum(each)
        yield word[one], word[base + np.arange(len(one)) - np.repeat(ends - each, each)]
        start = stop


def singular_space(coded: DataFrame, weight: np.ndarray, rank: int = RANK, sketch: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (words x at most rank) and singular values of the matrix of all passages."""
    n_words = len(weight)
    rng = np.random.default_rng(3)
    column = rng.integers(0, sketch, (n_words, SIGNS))
    sign = (rng.integers(0, 2, (n_words, SIGNS)) * 2 - 1) / np.sqrt(SIGNS)
    shared = coded.sparkSession.sparkContext.broadcast((weight, column, sign.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, column, sign = shared.value
        total = np.zeros(n_words * sketch, np.float32)
        for _, c in _chunks(batches):
            for one, other in _passage_pairs(c, w[c.word] > 0):
                both = w[one] * w[other]
                for i in range(SIGNS):
                    np.add.at(total, one * sketch + column[other, i], both * sign[other, i])
        total = total.reshape(n_words, sketch)
        at = np.flatnonzero(total.any(1))
        for start in range(0, len(at), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(at[start : start + 4096]), pa.array([total[i].tobytes() for i in at[start : start + 4096]], pa.binary())], ["word", "sums"])

    rows = coded.select("ids").mapInArrow(run, "word long, sums binary").repartition("word").mapInArrow(_add_up, "word long, sums binary").toArrow()  # at most words x sketch numbers
    sums = np.zeros((n_words, sketch))
    for word, row in zip(rows["word"].to_pylist(), rows["sums"].to_pylist(), strict=True):
        sums[word] = np.frombuffer(row, np.float64)
    # Nystroem: A'A is about Y (Omega' Y)^-1 Y' for Y = A'A Omega
    core = np.zeros((sketch, sketch))
    for i in range(SIGNS):
        np.add.at(core, column[:, i], sums * sign[:, i, None])
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    some = values > max(values[-1], 0) * 1e-7
    left, size, _ = np.linalg.svd(sums @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)
    kept = size[:rank] > 1e-9
    return left[:, :rank][:, kept].astype(np.float32), size[:rank][kept]


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word and the sum of its float32 rows, as float64."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for word, sums in zip(batch.column("word").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            held[word] = held.get(word, 0) + np.frombuffer(sums, np.float32).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["word", "sums"])


def latent_basis(coded: DataFrame, items: Items, weight: np.ndarray, sketch: int = JOINT_SKETCH) -> np.ndarray:
    """The joint space: orthonormal columns (words x directions) that span the items and the passages' leading directions."""
    n_words = len(items.vocabulary)
    shared = coded.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        omega = np.random.default_rng(3).standard_normal((n_words, sketch)).astype(np.float32) * w[:, None]
        total = np.zeros((n_words, sketch), np.float32)
        for _, c in _chunks(batches):
            keep = w[c.word] > 0
            scores = c.windows(_bag(c, omega, keep))  # A Omega
            share = scores.copy()  # a word lies in its chunk's window and the one before
            follows = np.flatnonzero(c.doc[1:] == c.doc[:-1])
            share[follows + 1] += scores[follows]
            word, chunk = c.word[keep], c.chunk[keep]
            order = np.argsort(word, kind="stable")
            word, chunk = word[order], chunk[order]
            for start in range(0, len(word), 50_000):
                p, q = word[start : start + 50_000], chunk[start : start + 50_000]
                begins = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                total[p[begins]] += np.add.reduceat(share[q], begins, axis=0)
        total *= w[:, None]
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[i].tobytes() for i in at], pa.binary())], ["word", "sums"])

    rows = coded.select("ids").mapInArrow(run, "word long, sums binary").repartition("word").mapInArrow(_add_up, "word long, sums binary").toArrow()  # at most words x sketch numbers
    spread = np.zeros((n_words, sketch))
    for word, sums in zip(rows["word"].to_pylist(), rows["sums"].to_pylist(), strict=True):
        spread[word] = np.frombuffer(sums, np.float64)
    own = items.vectors(weight).astype(np.float64)
    scale = lambda x: x / np.maximum(np.linalg.norm(x, axis=0), 1e-12)
    left, size, _ = np.linalg.svd(np.concatenate([scale(own.T), 1e-3 * scale(spread)], 1), full_matrices=False)
    return left[:, size > 1e-9].astype(np.float32)


@dataclass(frozen=True)
class Overlap:
    """An exact bound: a region where item i can reach PARAPHRASE holds words of `item == i` whose `times` sum up to least[i].

    Of an item of n words a match has PARAPHRASE * n; the most frequent words that together make up at most two thirds
    of those are left out, so the other third comes from the rest."""

    begins: np.ndarray  # of each word's part of item and times
    item: np.ndarray
    times: np.ndarray
    least: np.ndarray
    reach: np.ndarray
    of_items: np.ndarray  # the items it is for, as the columns of `least`

    @classmethod
    def of(cls, items: Items, df: np.ndarray, some: np.ndarray) -> Overlap:
        held, least = [], []
        for i, words in enumerate(items.words[j] for j in some):
            need = next(m for m in range(int(PARAPHRASE * len(words)), len(words) + 1) if m / len(words) >= PARAPHRASE)
            spare = need * 2 // 3
            for w, n in sorted(Counter(words).items(), key=lambda x: (-df[x[0]], x[0])):
                if n <= spare:
                    spare -= n
                    need -= n
                else:
                    held.append((w, i, n))
                    spare = 0
            least.append(need)
        word, item, times = np.array(sorted(held), np.int64).reshape(-1, 3).T
        return cls(np.searchsorted(word, np.arange(len(items.vocabulary) + 1)), item, times.astype(np.int32), np.array(least), np.array([reach(len(items.words[j])) for j in some]), some)

    def candidates(self, c: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items where the window with the item's reach on either side holds `least`."""
        if not len(self.least):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = np.diff(self.begins)[c.word]
        ends = np.cumsum(size)
        at = np.repeat(self.begins[c.word] - ends + size, size) + np.arange(size.sum())
        n, k = len(c.doc), len(self.least)
        total = np.zeros((n + 1, k), np.int32)
        np.add.at(total[1:].reshape(-1), np.repeat(c.chunk.astype(np.int64) * k, size) + self.item[at], self.times[at])
        np.cumsum(total, axis=0, out=total)
        chunk = np.arange(n)
        found = []
        for r in np.unique(self.reach):
            of = np.flatnonzero(self.reach == r)
            part = total[:, of]
            low, high = np.maximum(c.first[c.doc], chunk - r), np.minimum(c.first[c.doc + 1], chunk + 2 + r)
            window, i = np.nonzero(part[high] - part[low] >= self.least[of])
            found.append((window, self.of_items[of[i]]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Longest common subsequence of words with an item of n words, whose places by word are `masks` (bit-parallel)."""
    full = (1 << n) - 1
    v = full
    for m in filter(None, map(masks.get, words)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def find_leaks(docs: DataFrame, benchmark: DataFrame, space: str = "latent", exact: bool = False, kept: float = KEPT) -> DataFrame:
    """doc_id, item_id, matched (words of the longest common subsequence), item_words, ratio, cosine: the best match of each pair that leaks.

    exact, kept: see the module; kept=0 leaves the search to the space alone."""
    spark = docs.sparkSession
    out = None
    items_all = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items_all.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split("text", "\\s+"))).alias("words")).first()
    blocks = max(1, -(-size.n // ITEMS), -(-(size.words or 0) // BLOCK_WORDS))
    for block in range(blocks):
        items = read_items(items_all.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect())
        found = _leaks_of(docs, items, space, exact, kept) if items.ids else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, matched long, item_words long, ratio double, cosine double")
    best = F.max(F.struct("ratio", "matched", "item_words", "cosine")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.matched", "m.item_words", "m.ratio", "m.cosine")


def _leaks_of(docs: DataFrame, items: Items, space: str, exact: bool, kept: float) -> DataFrame:
    coded = _code(docs, items)
    passages, df = passage_counts(coded, len(items.vocabulary))
    idf = np.log((passages + 1) / (df + 1.0)).astype(np.float32)
    weight = np.where(df <= max(STOP_SHARE * passages, 50), idf, 0).astype(np.float32)
    for words in items.words:
        if np.count_nonzero(weight[words]) < WEIGHTED * len(words):
            weight[words] = np.maximum(idf[words], LEAST_WEIGHT)
    basis = latent_basis(coded, items, weight) if space == "joint" else singular_space(coded, weight)[0]
    of, latent, share = _pieces(items, weight, basis)
    norms = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
    lost = np.arange(len(items.ids)) if exact else np.unique(of[share < kept])
    covered = np.where(norms > 1e-6, COVERED * norms, np.inf)
    shared = docs.sparkSession.sparkContext.broadcast((items, weight, weight[:, None] * basis, of, (latent / norms[:, None]).T, covered, idf, Overlap.of(items, df, lost)))
    return coded.mapInArrow(functools.partial(_search, shared=shared), "doc_id long, item_id long, matched long, item_words long, ratio double, cosine double")


def _pieces(items: Items, weight: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items as passages would hold them: item, latent vector and the share of the norm that it keeps, of each piece of at most a
    passage's words (of 1.5 passages, where the rest is less than half of one)."""
    of, latent, share = [], [], []
    for i, words in enumerate(items.words):
        n = max(1, round(len(words) / (2 * STRIDE)))
        for part in np.array_split(np.array(words), n):
            word, times = np.unique(part, return_counts=True)
            held = times * weight[word]
            of.append(i)
            latent.append(held @ basis[word])
            norm = np.linalg.norm(held)
            share.append(np.linalg.norm(latent[-1]) / norm if norm > 1e-9 else 0.0)
    return np.array(of), np.array(latent, np.float32), np.array(share)


def _search(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    items, weight, rows, of, latent, covered, idf, overlap = shared.value
    begins = np.searchsorted(of, np.arange(len(items.ids) + 1))
    masks = []
    for words in items.words:
        mask: dict[int, int] = {}
        for i, w in enumerate(words):
            mask[w] = mask.get(w, 0) | 1 << i
        masks.append(mask)
    keys = [set(sorted(set(a), key=lambda w: (-idf[w], w))[:ANSWER_WORDS]) for a in items.answers]
    for batch, c in _chunks(batches):
        keep = weight[c.word] > 0
        z = c.windows(_bag(c, rows, keep))
        norm = np.sqrt(np.einsum("ij,ij->i", z, z))
        some = np.flatnonzero(norm > 1e-6)
        window, item = overlap.candidates(c)
        found = [window * len(items.ids) + item]
        for start in range(0, len(some), 4096):
            part = some[start : start + 4096]
            along = z[part] @ latent
            w, i = np.nonzero((along >= COSINE * norm[part][:, None]) | (along >= covered))
            found.append(part[w] * len(items.ids) + of[i])
        window, item = np.divmod(np.unique(np.concatenate(found)), len(items.ids))
        close = _close(c, window, item, items)
        window, item = window[close], item[close]
        cosines = np.einsum("ij,ij->i", z[window], latent.T[begins[item]]) / np.maximum(norm[window], 1e-9)
        for at in np.flatnonzero(begins[item + 1] - begins[item] > 1):  # the best of a long item's pieces
            cosines[at] = (z[window[at]] @ latent[:, begins[item[at]] : begins[item[at] + 1]]).max() / max(norm[window[at]], 1e-9)
        hits = zip(window.tolist(), item.tolist(), cosines.tolist(), strict=True)
        best: dict[tuple[int, int], tuple[float, int, float]] = {}
        for window, item, cosine in hits:
            doc = int(c.doc[window])
            at = c.ends[doc] + (window - c.first[doc]) * STRIDE
            n = len(items.words[item])
            side = reach(n) * STRIDE
            region = c.flat[max(c.ends[doc], at - side) : min(c.ends[doc + 1], at + 2 * STRIDE + side)]
            region = region[region >= 0].tolist()  # benchmark words
            matched = lcs(masks[item], n, region)
            ratio = matched / n
            if ratio >= SURE or ratio >= PARAPHRASE and 2 * len(keys[item].intersection(region)) >= len(keys[item]):
                best[doc, item] = max(best.get((doc, item), (0.0, 0, 0.0)), (ratio, matched, cosine))
        if best:
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[d] for d, _ in best], pa.int64()),
                    "item_id": pa.array([items.ids[i] for _, i in best], pa.int64()),
                    "matched": pa.array([m for _, m, _ in best.values()], pa.int64()),
                    "item_words": pa.array([len(items.words[i]) for _, i in best], pa.int64()),
                    "ratio": pa.array([r for r, _, _ in best.values()], pa.float64()),
                    "cosine": pa.array([float(x) for _, _, x in best.values()], pa.float64()),
                }
            )


def _close(c: Chunks, window: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """Which candidates can match PARAPHRASE of the item's words: as many places of the region, and as many of the item, hold a word of the
    other. Items that reach beyond the neighbouring chunks are all kept."""
    out = np.ones(len(window), bool)
    sizes = np.array([len(words) for words in items.words])
    short = np.flatnonzero(sizes <= 2 * STRIDE)
    kind = np.int16 if len(items.vocabulary) < 1 << 15 else np.int32  # compared by the million
    padded = np.full((len(sizes), 2 * STRIDE), -2, kind)
    for i in short:
        padded[i, : sizes[i]] = items.words[i]
    at_all = np.flatnonzero(sizes[item] <= 2 * STRIDE)
    for start in range(0, len(at_all), 2_000):
        part = at_all[start : start + 2_000]
        w, i = window[part], item[part]
        doc = c.doc[w]
        at = c.ends[doc] + (w - c.first[doc]) * STRIDE
        place = np.maximum(c.ends[doc], at - STRIDE)[:, None] + np.arange(4 * STRIDE)
        inside = place < np.minimum(c.ends[doc + 1], at + 3 * STRIDE)[:, None]
        region = np.where(inside, c.flat[np.minimum(place, len(c.flat) - 1)], -1).astype(kind)
        equal = region[:, None, :] == padded[i][:, :, None]
        out[part] = np.minimum(equal.any(1).sum(1), equal.any(2).sum(1)) >= PARAPHRASE * sizes[i] - 1e-9
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id leaks an item; columns as they are. Rows with a null id are kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return without_ids(docs, materialize(find_leaks(rows, benchmark).select("doc_id").distinct(), "leaks"), id_col)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
