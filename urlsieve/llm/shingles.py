"""Sets of hashed word shingles of whole texts, computed on the text bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import text_runs

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)  # A-Z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers, inverses) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, pointer of each text into them). Words are runs of non-space bytes, A-Z folded.

    The hash is a polynomial over the bytes: differences of one running sum give every word's value.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    part, off = data[lo:hi], offsets - lo
    inside = np.zeros(len(part) + 2, bool)
    inside[1:-1] = ~_SPACE[part]
    starts = inside[1:-1] & ~inside[:-2]
    edges = off[(off > 0) & (off < len(part))]
    starts[edges] |= inside[1:-1][edges]
    ends = inside[1:-1] & ~inside[2:]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_FOLD[part] * powers[:len(part)], out=total[1:])
    h = (total[e] - total[s]) * inverses[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(s, off)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 3) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of `k` words; a shorter text is one shingle, no word none."""
    powers = inverses = np.zeros(0, np.uint64)
    for i, j in text_runs(offsets):
        size = int(offsets[j] - offsets[i])
        if size > len(powers):
            size += size // 4
            powers, inverses = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
        words, at = word_hashes(data, offsets[i:j + 1], powers, inverses)
        grams = _grams(words, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                g = np.sort(grams[a:b - k + 1])
                yield g[np.concatenate(([True], g[1:] != g[:-1]))]
            else:
                yield _grams(words[a:b], b - a)[:1] if b > a else words[:0]


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(words) - k + 1)
    h = np.full(n, k, np.uint64)
    for x in range(k):
        h = mix(h * np.uint64(0xA0761D6478BD642F) + words[x:x + n])
    return h
