"""Hashes of word shingles of many texts at once, in numpy.

Words are runs of bytes other than [\\x20\\x09-\\x0D] once A-Z are lower-cased. A word's
64-bit hash is a polynomial of random byte values, taken from one prefix sum over the
block; a shingle's is a random linear form of its words' hashes. Both are mixed at the end.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
BLOCK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
_BYTE[_SEPARATOR] = 0
_PLACE = mix(np.arange(1001, 1065, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        out = np.empty(max(n, BLOCK_BYTES + 1), U)
        out[0], done = 1, 1
        while done < len(out):
            more = min(done, len(out) - done)
            out[done : done + more] = out[:more] * U(pow(base, done, 2**64))
            done += more
        _powers[name] = out
    return _powers[name]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one more at the end)."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    buffer = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    inside = ~_SEPARATOR[buffer]
    edge = np.flatnonzero(np.diff(np.r_[False, inside].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(buffer) + 1, U)
    np.cumsum(_BYTE[buffer] * _power(_BASE, "up", len(buffer))[: len(buffer)], out=total[1:])
    words = (total[ends] - total[starts]) * _power(pow(_BASE, -1, 2**64), "down", len(buffer))[starts]
    bounds = np.searchsorted(starts, np.r_[0, np.cumsum(lengths)])
    return mix(words), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and where each text's begin. A text of fewer words,
    but one at least, has its whole sequence as one shingle."""
    count = np.diff(bounds)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begins = np.r_[0, np.cumsum(n)]
    first = np.repeat(bounds[:-1] - begins[:-1], n) + np.arange(begins[-1])
    padded = np.r_[words, np.zeros(k, U)]
    out = np.zeros(len(first), U)
    short = np.repeat(count < k, n)
    size = np.repeat(np.minimum(count, k), n)[short] if short.any() else None
    for j in range(k):
        term = padded[first + j] * _PLACE[j]
        if size is not None:
            term[short] = np.where(j < size, term[short], _PLACE[k + j])
        out += term
    return mix(out), begins


def distinct_sorted(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and where they begin. Sorts in place."""
    edges = begins.tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a > 1:
            hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    if len(hashes):
        keep[1:] = hashes[1:] != hashes[:-1]
        keep[begins[:-1][begins[:-1] < len(hashes)]] = True
    kept = np.r_[0, np.cumsum(keep)]
    return hashes[keep], kept[begins]


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted, flat, and where each text's begin."""
    return distinct_sorted(*shingle_hashes(*word_hashes(texts), k))
