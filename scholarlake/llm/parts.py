"""Whole texts from ids of their distinct parts, assembled in numpy."""

from __future__ import annotations

from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct parts that a Python worker holds the ids of, unless a coder says otherwise.
HELD = 100_000


def spread(flat: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of flat (run i has counts[i] items) in the order given; a run may be named often."""
    starts = np.cumsum(counts) - counts
    sizes = counts[order]
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts[order] - (ends - sizes), sizes) + np.arange(ends[-1])]


class PartCoder:
    """Ids of whole texts, each distinct part of a step encoded once.

    A text is cut before each space that stands between two other characters, where a byte-level pattern always starts a
    new piece; letters and a run of marks after them are two pieces. So ids of a text are those of its parts. Texts with
    other white space around a space, or with a special token's string, are encoded whole.

    A subclass gives alone(texts): ids of texts as they stand, end to end, and how many each has; it may give
    after_space(parts), the same for parts without white space that follow a space.
    """

    special: list[str] = []

    def __init__(self, held: int | None = None) -> None:
        self.held = held or HELD
        self.places: dict[str, int] = {}
        self.flat, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def after_space(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.alone([" " + p for p in parts])

    def _looked_up(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """after_space(), where parts of earlier steps are looked up while they are held."""
        if len(self.places) + len(parts) > self.held:
            self.places, self.flat, self.counts = {}, np.empty(0, np.uint32), np.empty(0, np.int64)
        places = self.places
        fresh = [p for p in parts if p not in places]
        flat, counts = self.after_space(fresh)
        places.update(zip(fresh, range(len(places), len(places) + len(fresh)), strict=True))
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        order = np.fromiter(map(places.__getitem__, parts), np.int64, len(parts))
        return spread(self.flat, self.counts, order), self.counts[order]

    def _parts(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids after a space of each distinct part."""
        stems = pc.utf8_rtrim(distinct, punctuation)
        marked = pc.and_(pc.utf8_is_alpha(stems), pc.not_equal(stems, distinct)).to_numpy(zero_copy_only=False)
        base = pc.if_else(pa.array(marked), stems, distinct).dictionary_encode()
        flat, counts = self._looked_up(base.dictionary.to_pylist())
        runs = [c[len(s) :] for c, s in zip(distinct.filter(pa.array(marked)).to_pylist(), stems.filter(pa.array(marked)).to_pylist(), strict=True)]
        known = {r: i for i, r in enumerate(dict.fromkeys(runs))}
        mark_flat, mark_counts = self.alone(list(known))
        n, none = len(counts), len(counts) + len(mark_counts)
        flat, counts = np.concatenate([flat, mark_flat]), np.concatenate([counts, mark_counts, [0]])
        pairs = np.full((len(distinct), 2), none)
        pairs[:, 0] = base.indices.to_numpy()
        pairs[marked, 1] = n + np.array([known[r] for r in runs], np.int64)
        return spread(flat, counts, pairs.ravel()), counts[pairs].sum(1)

    def encode(self, texts: pa.StringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and ids of each; end_id is put after each text."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        parts, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        coded = parts.dictionary_encode()
        order, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        first, last = pc.utf8_slice_codeunits(distinct, 0, 1), pc.utf8_slice_codeunits(distinct, -1)
        blank = pc.or_(pc.or_(pc.utf8_is_space(first), pc.utf8_is_space(last)), pc.equal(distinct, "")).to_numpy(zero_copy_only=False)
        heads = bounds[:-1]
        odd = blank[order]
        odd[heads] = pc.utf8_is_space(pc.utf8_slice_codeunits(parts.take(pa.array(heads)), -1)).to_numpy(zero_copy_only=False)
        odd[heads] |= pc.equal(parts.take(pa.array(heads)), "").to_numpy(zero_copy_only=False) & (np.diff(bounds) > 1)
        whole = np.logical_or.reduceat(odd, heads) if len(heads) else np.empty(0, bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        flat, counts = self._parts(distinct)
        own = pc.if_else(pa.array(whole), texts, parts.take(pa.array(heads)))  # encoded as they stand
        own_flat, own_counts = self.alone(own.to_pylist())
        end = np.array([] if end_id is None else [end_id], np.uint32)
        n = len(counts)
        flat, counts = np.concatenate([flat, own_flat, end]), np.concatenate([counts, own_counts, [len(end), 0]])
        order[np.repeat(whole, np.diff(bounds))] = len(counts) - 1  # nothing but the text itself
        order[heads] = n + np.arange(len(heads))
        order = np.insert(order, bounds[1:], len(counts) - 2)
        sizes = np.add.reduceat(counts[order], bounds[:-1] + np.arange(len(heads))) if len(heads) else np.empty(0, np.int64)
        return spread(flat, counts, order), sizes
