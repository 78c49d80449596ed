"""Phrase collocation mining with count tries.

Each task folds its texts into count tries of bounded depth: level arrays of (parent, word, count), the language at the
root and up to four words below. Tries are serialised in order of their paths and cut into prefix ranges; the ranges of
all tasks are merged, one range at a time. A range also gets the nodes above its first path, with their counts, so walking
up a merged trie gives the counts of a phrase's left parts. Its right parts come by suffix links, each level joined to
the one above.

Two passes read the texts. The first counts words and word pairs; the second goes to full depth, but only along pairs
that are frequent: a phrase is at most as frequent as each pair in it. Which pairs are is told by a table of bits that
grows with their number up to a fixed size; a bit that is set by chance, or a table that is full, costs work and changes
no result. Range borders come from a hash sample of the texts, for balance alone: results don't depend on them.

Defined cases: null text is empty, null lang is `und`; a null id is a document like others; rows that repeat are counted
again; long texts are taken whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.llm.common import materialize, steps, table

#: Words of the longest phrase.
LONGEST = 4
#: Occurrences of a phrase that counts.
LEAST = 30
#: A longer phrase with this share (in hundredths) of a phrase's occurrences takes its place.
CONTAINED = 80
#: Phrases given for a language.
TOP = 2_000
#: Nodes that a task holds before it hands its trie on, and text bytes of one step.
HELD_NODES = 1_500_000
STEP = 4 << 20
#: Bits of the largest table of frequent pairs, and bits for each pair below that.
MOST_BITS, BITS_EACH = 1 << 27, 16
#: Groups in which the words of the languages are summed first.
ROOTS = 64
#: Documents of the sample that places range borders: one in so many, by hash.
SAMPLED = 16
BORDERS_FROM = 20_000
#: Bytes of a border's words; a border need not be a path that is there.
BORDER_BYTES = 64

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


class Trie:
    """Counts by path. names: sorted words (languages at level 0 in a list of their own); level d has parent, code and
    count arrays in order of the paths; parents of level 0 are zeros."""

    def __init__(self, langs: pa.Array, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.langs, self.words, self.levels = langs, words, levels

    @property
    def nodes(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def name(self, level: int, i: int) -> bytes:
        return (self.words if level else self.langs)[int(self.levels[level][1][i])].as_py()

    def path(self, level: int, i: int) -> tuple[bytes, ...]:
        out = []
        for d in range(level, -1, -1):
            out.append(self.name(d, i))
            i = int(self.levels[d][0][i])
        return tuple(reversed(out))


def _sorted_codes(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in byte order, and each word's place among them."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def _count(parent: np.ndarray, code: np.ndarray, codes: int, weight: np.ndarray | None = None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A level from occurrences (parent, code): its arrays in order, and each occurrence's node."""
    keys, node, count = np.unique(parent * codes + code, return_inverse=True, return_counts=True)
    if weight is not None:
        count = np.add.reduceat(weight[np.argsort(node, kind="stable")], np.searchsorted(np.sort(node), np.arange(len(keys)))) if len(keys) else weight
    return ((keys // codes).astype(np.int64), keys % codes, count.astype(np.int64)), node


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in names.to_pylist()), np.uint64, len(names))


class Bits:
    """A table of bits for hashes: says yes for all that were put in, and for others by chance."""

    def __init__(self, words: np.ndarray, size: int):
        self.words, self.size = words, size

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.size - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def grow(texts: list[bytes], langs: list[bytes], depth: int, frequent: Bits | None = None) -> Trie | None:
    """The trie of some texts. With `frequent`, words and pairs are nodes only where the table has them, and deeper phrases where it has all their pairs."""
    joined = b"\n".join(texts).translate(_FOLD)
    buf = np.frombuffer(joined, np.uint8)
    breaks = buf == 10
    inside = ~(breaks | (buf == 32))
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(first):
        return None
    kept = np.cumsum(inside)
    ends = np.concatenate([kept[first][1:] - 1, kept[-1:]])
    data = buf[inside]
    words = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])
    names, code = _sorted_codes(words)
    piece = np.cumsum(breaks, dtype=np.int32)[first]
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    lang_names, lang_code = _sorted_codes(pa.array(langs, pa.binary()))
    lang = lang_code[np.searchsorted(np.cumsum(sizes), first, side="right")]
    del joined, buf, breaks, inside, kept
    v, n = len(names), len(code)
    root, node = _count(np.zeros(n, np.int64), lang, len(lang_names))
    levels = [root]
    # runs: how many words from here on are in one piece; near: whether the pair that starts here is frequent
    at = np.arange(n)
    linked = np.concatenate([piece[1:] == piece[:-1], [False]])
    if frequent is not None and n > 1:
        lang_hash, word_hash = _hashes(lang_names)[lang], _hashes(names)[code]
        starts = frequent.has(_mix(lang_hash, word_hash))
        linked[:-1] &= frequent.has(_mix(_mix(lang_hash[:-1], word_hash[:-1]), word_hash[1:]))
        at = np.flatnonzero(starts)
    node = node[at]
    for d in range(depth):
        if d:
            on = linked[at + d - 1]
            at, node = at[on], node[on]
        level, node = _count(node, code[at + d], v)
        levels.append(level)
        if not len(at):
            levels += [(np.empty(0, np.int64),) * 3] * (depth - d - 1)
            break
    return Trie(lang_names, names, levels)


def merge(tries: list[Trie]) -> Trie:
    """One trie with the sums of the counts: their levels are merged from the root down."""
    langs, lang_code = _sorted_codes(pa.concat_arrays([t.langs for t in tries]))
    words, word_code = _sorted_codes(pa.concat_arrays([t.words for t in tries]))
    at_lang, at_word = np.cumsum([0, *(len(t.langs) for t in tries)]), np.cumsum([0, *(len(t.words) for t in tries)])
    levels, places = [], [np.zeros(1, np.int64)] * len(tries)
    for d in range(max(len(t.levels) for t in tries)):
        parent, code, count = [], [], []
        for i, t in enumerate(tries):
            p, c, n = t.levels[d]
            parent.append(places[i][p])
            code.append(word_code[at_word[i] + c] if d else lang_code[at_lang[i] + c])
            count.append(n)
        level, node = _count(np.concatenate(parent), np.concatenate(code), max(1, len(words) if d else len(langs)), np.concatenate(count))
        levels.append(level)
        places = np.split(node, np.cumsum([len(x) for x in count])[:-1])
    return Trie(langs, words, levels)


def cut(trie: Trie, borders: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Trie]]:
    """(range, part) of a trie: nodes of two words and more are in one range; those above are in each range that holds, or could hold, a path through them."""
    bounds = []
    for d in range(3):
        path = lambda i, d=d: trie.path(d, i)
        n = len(trie.levels[d][0])
        low = [0, *(bisect_left(range(n), b[: d + 1], key=path) for b in borders)]
        high = [*(bisect_left(range(n), b, key=path) for b in borders), n]
        bounds.append((low, high))
    for r in range(len(borders) + 1):
        spans = [(low[r], high[r]) for low, high in bounds]
        for d in range(3, len(trie.levels)):
            spans.append(tuple(int(x) for x in np.searchsorted(trie.levels[d][0], spans[-1])))
        if spans[0][0] == spans[0][1] or all(a == b for a, b in spans[1:]):
            continue
        levels, before = [], 0
        for (parent, code, count), (a, b) in zip(trie.levels, spans, strict=True):
            levels.append((parent[a:b] - before, code[a:b], count[a:b]))
            before = a
        used = np.unique(np.concatenate([code for _, code, _ in levels[1:]]))
        lang_used = np.unique(levels[0][1])
        levels = [(p, np.searchsorted(used if d else lang_used, c), n) for d, (p, c, n) in enumerate(levels)]
        yield r, Trie(trie.langs.take(pa.array(lang_used)), trie.words.take(pa.array(used)), levels)


def pack(trie: Trie) -> bytes:
    """A trie as bytes: its names and levels, in order of the paths."""
    ends = pa.array([0, len(trie.langs), len(trie.langs) + len(trie.words)], pa.int32())
    names = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.concat_arrays([trie.langs, trie.words]))], names=["names"])
    nodes = [pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(c, pa.int32()), pa.array(n, pa.int64())], names=["parent", "code", "count"]) for p, c, n in trie.levels]
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batches in ([names], nodes):
        with pa.ipc.new_stream(sink, batches[0].schema, options=options) as out:
            for batch in batches:
                out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> Trie:
    source = pa.BufferReader(data)
    names = pa.ipc.open_stream(source).read_all()["names"].combine_chunks()
    levels = [tuple(b.column(c).to_numpy().astype(np.int64) for c in ("parent", "code", "count")) for b in pa.ipc.open_stream(source)]
    return Trie(names[0].values, names[1].values, levels)


def _columns(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes]]:
    return tuple([x or b"" for x in batch.column(c).cast(pa.binary()).to_pylist()] for c in ("text", "lang"))


def _shards(depth: int, borders: list[tuple[bytes, ...]], frequent: Bits | None):
    """Serialised ranges of a task's tries: part, trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Trie] = []

        def out() -> pa.RecordBatch:
            whole = merge(held) if len(held) > 1 else held[0]
            held.clear()
            parts = [(-1 - TaskContext.get().partitionId() % ROOTS, Trie(whole.langs, whole.words[:0], whole.levels[:1])), *cut(whole, borders)]
            return pa.RecordBatch.from_pydict({"part": pa.array([r for r, _ in parts], pa.int32()), "trie": pa.array([pack(t) for _, t in parts], pa.binary())})

        for batch in batches:
            for step in steps(batch, limit=STEP):
                trie = grow(*_columns(step), depth, frequent)
                if trie is None:
                    continue
                held.append(trie)
                if sum(t.nodes for t in held) > HELD_NODES:
                    whole = merge(held) if len(held) > 1 else held[0]
                    held[:] = [whole]
                    if whole.nodes > HELD_NODES // 2:
                        yield out()
        if held:
            yield out()

    return run


def _merged(least: int, depths: tuple[int, ...], borders: list[tuple[bytes, ...]]):
    """Phrases of a range with at least `least` occurrences: lang, phrase, depth, a, lefts (counts of its beginnings), hash, start.
    Negative ranges hold languages alone, and give the words of each (depth 0)."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: Trie | None = None
        for batch in batches:
            held = [] if whole is None else [whole]
            for data in batch.column("trie").to_pylist():
                held.append(unpack(data))
                if len(held) >= 16:
                    held = [merge(held)]
            whole = merge(held) if len(held) > 1 else held[0]
        part = key[0].as_py()
        if part < 0:
            _, code, count = whole.levels[0]
            n = len(count)
            rows = {"lang": whole.langs.take(pa.array(code)).cast(pa.string()), "phrase": pa.array([""] * n), "depth": pa.array([0] * n, pa.int32()), "a": pa.array(count)}
            yield pa.RecordBatch.from_pydict(rows | {"lefts": pa.array([[]] * n, pa.list_(pa.int64())), "hash": pa.array([0] * n, pa.int64()), "start": pa.array([0] * n, pa.int64())})
            return
        for depth in depths:
            count = whole.levels[depth][2]
            at = np.flatnonzero(count >= least)
            if depth == 1:  # words stand in all ranges of their pairs; the first of them gives them
                at = np.array([i for i in at if bisect_left(borders, whole.path(1, i)) == part], np.int64)
            if not len(at):
                continue
            up, names, counts = at, [], []
            for d in range(depth, -1, -1):
                p, c, n = whole.levels[d]
                names.append((whole.words if d else whole.langs).take(pa.array(c[up])))
                counts.append(n[up])
                up = p[up]
            lang, *words = reversed(names)
            lang_hash, word_hash = _hashes(lang), [_hashes(w) for w in words[:2]]
            start = _mix(lang_hash, word_hash[0])
            phrase = pc.binary_join_element_wise(*words, b" ") if len(words) > 1 else words[0]
            lefts = np.stack(counts[-2:0:-1], 1) if depth > 1 else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": lang.cast(pa.string()),
                    "phrase": phrase.cast(pa.string()),
                    "depth": pa.array(np.full(len(at), depth), pa.int32()),
                    "a": pa.array(count[at]),
                    "lefts": pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (depth - 1), pa.int32()), pa.array(lefts.ravel())),
                    "hash": pa.array((_mix(start, word_hash[1]) if depth > 1 else start).view(np.int64)),
                    "start": pa.array(start.view(np.int64)),
                }
            )

    return run


_PHRASES = "lang string, phrase string, depth int, a long, lefts array<long>, hash long, start long"


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))


def _borders(rows: DataFrame, parts: int) -> list[tuple[bytes, ...]]:
    """Paths (lang, word, word) that cut the pairs of a hash sample into ranges of equal weight; few or none for little text."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, limit=STEP):
                trie = grow(*_columns(step), 2)
                if trie is None or not len(trie.levels[2][0]):
                    continue
                n = len(trie.levels[2][0])
                chosen = np.unique(np.linspace(0, n - 1, min(n, 512)).astype(int))
                paths = [tuple(x[:BORDER_BYTES] for x in trie.path(2, int(i))) for i in chosen]
                lang, first, second = zip(*paths, strict=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.binary()), "first": pa.array(first, pa.binary()), "second": pa.array(second, pa.binary()), "weight": pa.array(np.full(len(chosen), n / len(chosen)))})

    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).mapInArrow(pairs, "lang binary, first binary, second binary, weight double")
    held = sample.orderBy(F.xxhash64("first", "second", "lang")).limit(BORDERS_FROM).collect()
    if not held or parts < 2:
        return []
    paths = sorted((bytes(r.lang), bytes(r.first), bytes(r.second), r.weight) for r in held)
    at = np.cumsum([p[3] for p in paths])
    places = np.searchsorted(at, at[-1] * np.arange(1, parts) / parts)
    return sorted({paths[min(i, len(paths) - 1)][:3] for i in places})


def _bits(pairs: DataFrame) -> Bits:
    """The table of frequent pairs, and of the words they start with."""
    n = 2 * pairs.count()
    size = 1 << 10
    while size < min(n * BITS_EACH, MOST_BITS):
        size *= 2
    hashes = pairs.select(F.explode(F.array("hash", "start")).alias("h")).select(F.col("h").bitwiseAND(size - 1).alias("at"))
    words = hashes.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    found = words.toArrow()  # at most MOST_BITS / 64 rows
    table_ = np.zeros(size // 64, np.uint64)
    table_[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bits(table_, size)


def _pass(rows: DataFrame, depth: int, depths: tuple[int, ...], borders: list[tuple[bytes, ...]], frequent: Bits | None, least: int) -> DataFrame:
    shards = rows.mapInArrow(_shards(depth, borders, frequent), "part int, trie binary")
    return shards.groupBy("part").applyInArrow(_merged(least, depths, borders), _PHRASES)


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, parts: int | None = None) -> DataFrame:
    """lang, phrase, depth, a, lefts: phrases of one to LONGEST words with at least `least` occurrences; lefts are the counts of their beginnings.

    Rows of depth 0, to be summed, have the words of a language as a."""
    spark = docs.sparkSession
    rows = _rows(docs, text_col, lang_col)
    borders = _borders(rows, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    short = materialize(_pass(rows, 2, (1, 2), borders, None, least), "short_phrases")
    pairs = short.where("depth = 2")
    found = short
    if LONGEST > 2 and not pairs.isEmpty():
        long = _pass(rows, LONGEST, tuple(range(3, LONGEST + 1)), borders, _bits(pairs), least)
        found = found.unionByName(materialize(long, "long_phrases").where("depth > 0"))
    return found.drop("hash", "start")


def _rest(phrase: str | Column) -> Column:
    """A phrase without its first word."""
    phrase = F.col(phrase) if isinstance(phrase, str) else phrase
    return F.substr(phrase, F.instr(phrase, " ") + 1)


def with_rights(found: DataFrame) -> DataFrame:
    """phrases() with rights: counts of their ends (all but the first word, all but the first two, ...), by suffix links from level to level."""
    levels = [found.where("depth = 1").withColumn("rights", F.array().cast("array<long>"))]
    for depth in range(2, LONGEST + 1):
        link = levels[-1].select(F.col("lang").alias("link_lang"), F.col("phrase").alias("link"), F.concat(F.array("a"), "rights").alias("rights"))
        own = found.where(F.col("depth") == depth)
        joined = own.join(link, (F.col("lang") == F.col("link_lang")) & (_rest("phrase") == F.col("link")))
        levels.append(joined.drop("link_lang", "link"))
    out = levels[1]
    for level in levels[2:]:
        out = out.unionByName(level)
    return out


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, depth, a, l, r, score: each phrase at its lowest-scoring cut, in exact arithmetic."""
    cuts = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda k: F.struct(k.alias("k"), F.element_at("lefts", k).alias("l"), F.element_at("rights", k).alias("r")))
    rows = with_rights(found).select("lang", "phrase", "depth", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "depth", "a", "c.*")
    rows = rows.withColumn("score", F.expr("(CAST(a AS DECIMAL(28, 0)) * 2000000) div (CAST(l AS DECIMAL(28, 0)) + r)"))
    lowest = rows.groupBy("lang", "phrase", "depth", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "depth", "a", "c.l", "c.r", "c.score")


def kept(rows: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """rows without the phrases that a longer one contains and nearly always accompanies."""
    words = F.split("phrase", " ", -1)
    longer = rows.where("depth > 2").select("lang", "a", "depth", words.alias("w"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("depth") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("depth") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    most = longer.select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer_a"))
    joined = rows.join(most, ["lang", "phrase"], "left")
    accompanied = F.coalesce(F.expr(f"CAST(longer_a AS DECIMAL(28, 0)) * 100 >= CAST(a AS DECIMAL(28, 0)) * {contained}"), F.lit(False))
    return joined.where(~accompanied).drop("longer_a")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, parts: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, then count, then phrase."""
    spark = docs.sparkSession
    found = phrases(docs, text_col, lang_col, least, parts)
    words = found.where("depth = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    rows = materialize(kept(materialize(scored(found), "scored_phrases")), "kept_phrases")
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))  # a language's phrases are ranked in parts, whose first ones are ranked again
    first = salted.withColumn("r0", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r0") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
 SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
 FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS d FROM i),
c AS (SELECT lang, d, array_to_string(w[i : i + d - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE d = 1 GROUP BY lang),
h AS (SELECT lang, d, phrase, f AS a, string_split(phrase, ' ') AS v FROM c WHERE d > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, d)) AS k FROM h),
s AS (
 SELECT k.lang, k.d, k.phrase, k.a, k.v, k.k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * k.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
 FROM k JOIN c x ON x.lang = k.lang AND x.phrase = array_to_string(k.v[1 : k.k], ' ') JOIN c y ON y.lang = k.lang AND y.phrase = array_to_string(k.v[k.k + 1 : k.d], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, a, d, v, unnest(range(2, d)) AS m FROM h WHERE d > 2),
t AS (SELECT lang, a, v, m, unnest(range(1, d - m + 2)) AS o FROM u),
z AS (SELECT lang, array_to_string(v[o : o + m - 1], ' ') AS phrase, max(a) AS longer FROM t GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase
WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80
QUALIFY rank <= 2000
"""
