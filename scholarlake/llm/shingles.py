"""64-bit hashes of words and word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE)]))
    return _powers


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word (a run of bytes other than space and 9 to 13), in order, A-Z taken as a-z."""
    out = []
    start = 0
    while start < len(text):
        end = min(len(text), start + (1 << 20))
        while end < len(text) and not _SPACE[text[end]]:  # a cut never splits a word
            end += 1
        raw = np.frombuffer(text[start:end].lower(), np.uint8)
        inside = np.concatenate([[False], ~_SPACE[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, size = edges[::2], edges[1::2] - edges[::2]
        if len(first):
            letters = raw[inside[1:-1]]
            begins = np.cumsum(size) - size
            at = np.arange(len(letters)) - np.repeat(begins, size)
            out.append(mix(np.add.reduceat(_BYTE[letters] * _power(int(size.max()))[at], begins) + size.astype(np.uint64)))
        start = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; fewer words are one shingle; no words give none."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total = total + words[i : len(words) - k + 1 + i] * _ORDER[i]
    return np.unique(mix(total + np.uint64(k)))
