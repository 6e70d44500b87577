"""Sets of hashed word shingles of a batch of texts, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_BYTE = _odd(1, 256)
_PLACE = _odd(2, 64)
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, U)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def word_hashes(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word: a stretch without space, tab, line feed, or the three between them; A-Z as a-z."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate(([False], solid[:-1]))))
    end = np.flatnonzero(solid & (edge[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    power, inverse = _powers(n)
    total = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[low] * power[:n], dtype=U)))
    h = (total[end] - total[start]) * inverse[start]
    row = np.searchsorted(at, start, "right") - 1
    return row, mix64(h + (end - start).astype(U))


def shingle_sets(at: np.ndarray, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes per row, all sets one after the other, each ascending and without repeats).

    A row with fewer than ``k`` words has its whole sequence as one shingle; one without words has none.
    """
    rows = len(at) - 1
    row, h = word_hashes(at, raw)
    words = np.bincount(row, minlength=rows).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(words)))
    size = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    cut = np.concatenate(([0], np.cumsum(size)))
    of = np.repeat(np.arange(rows), size)
    head = first[of] + np.arange(cut[-1]) - cut[of]
    out = np.minimum(words[of], k).astype(U) * U(0x632BE59BD9B4E019)
    for j in range(k):
        some = j < words[of]
        out[some] += h[head[some] + j] * _PLACE[j]
    out = mix64(out)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return np.bincount(of[keep], minlength=rows).astype(np.int64), out[keep]
