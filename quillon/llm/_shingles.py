"""Hashed word shingles of whole texts, in NumPy.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's
hash is a polynomial in its bytes modulo 2**64, taken from prefix sums; a
shingle's hash mixes the hashes of its words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps)
    return have[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word of a lower-cased text."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, U)
    inside = np.concatenate(([False], ~_SPACE[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, U), np.cumsum((b.astype(U) + U(1)) * _powers(_BASE, len(b)))))
    return mix((sums[end] - sums[start]) * _powers(_INVERSE, len(b))[start] if len(start) else np.empty(0, U))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of text's k-word shingles; the whole sequence where it has fewer words."""
    w = word_hashes((text or "").encode("utf-8", "replace").lower())
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, U(n))
    for j in range(n):
        h = mix(h * U(0xD6E8FEB86659FD93) + w[j : len(w) - n + 1 + j])
    return np.unique(h)
