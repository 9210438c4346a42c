"""Hashes of word shingles of a whole text, computed with whole-array operations."""

from __future__ import annotations

import numpy as np

# Odd multipliers of the hashes.
BASE = 0x9E3779B97F4A7C15 | 1
PLACES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** i modulo 2^64 for i < n."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 2 * len(_POWERS)), BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """One hash per word `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased."""
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    if not inside.any():
        return np.zeros(0, np.uint64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins[inside])
    values = raw[inside].astype(np.uint64) + np.uint64(1)
    sizes = np.diff(np.append(starts, len(values)))
    offsets = np.arange(len(values)) - np.repeat(starts, sizes)
    return mix(np.add.reduceat(values * powers(int(sizes.max()))[offsets], starts) + sizes.astype(np.uint64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of `words` words; a shorter
    text is one shingle, a text without words has none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        total += w[i : len(w) - n + 1 + i] * np.uint64(PLACES[i] | 1)
    return np.unique(mix(total))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0
