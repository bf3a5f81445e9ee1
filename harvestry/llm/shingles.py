"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .batches import mixed

BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word; A-Z count as a-z, words end at space and controls 9 to 13."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    black = ~((low == 32) | ((low >= 9) & (low <= 13)))
    first = np.zeros(len(data) + 1, bool)  # where a text begins
    first[at] = True
    starts = black.copy()
    starts[1:] &= ~black[:-1] | first[1:-1]
    ends = black.copy()
    ends[:-1] &= ~black[1:] | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[e] - total[s]) * down[s]
    return mixed(h + (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), np.searchsorted(at, s, "right") - 1


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each text, sorted, one text after the other, and the offsets of the texts.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    h, owner = words(data, at)
    texts = len(at) - 1
    odd = [np.uint64(x) for x in (mixed(np.arange(1, n + 2, dtype=np.uint64)) | np.uint64(1))]
    many = np.bincount(owner, minlength=texts)
    begin = np.concatenate([[0], np.cumsum(many)])
    m = max(0, len(h) - n + 1)
    s = np.zeros(m, np.uint64)
    for k in range(n):
        s += h[k : k + m] * odd[k]
    same = owner[:m] == owner[n - 1 : n - 1 + m] if m else np.zeros(0, bool)
    s, whose = mixed(s[same]), owner[:m][same]
    at_s = np.searchsorted(whose, np.arange(texts + 1))
    sets = []
    for i in range(texts):
        if many[i] >= n:
            sets.append(np.unique(s[at_s[i] : at_s[i + 1]]))
        elif many[i]:
            own = h[begin[i] : begin[i + 1]]
            parts = np.append(own, np.uint64(len(own))) * np.array([*odd[: len(own)], odd[n]])
            sets.append(mixed(parts.sum(keepdims=True, dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
