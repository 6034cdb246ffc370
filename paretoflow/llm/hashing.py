"""Vectorised hashes of words, shingles and byte windows of one text (numpy, inside tasks)."""

from __future__ import annotations

import functools

import numpy as np

#: Multiplier of the polynomial hash (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: 64-bit values for each byte, of two independent hashes.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_OTHER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    return _powers(1 << max(16, n.bit_length()))


def prefix(raw: np.ndarray, other: bool = False) -> np.ndarray:
    """Running polynomial sums of a text's bytes, or the other hash's: what :func:`spans` needs."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_OTHER if other else _BYTES)[raw] * powers(len(raw))[0][: len(raw)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal values wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def words(raw: bytes) -> np.ndarray:
    """Hashes of a text's words in order, A-Z lower-cased."""
    return words_of_lines(raw)[0]


def _edges(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~SPACE[b]
    edges = np.diff(inside)
    starts = np.flatnonzero(edges == 1)
    return starts, np.flatnonzero(edges == -1), np.searchsorted(np.flatnonzero(b == 10), starts)


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and line of each word of a text."""
    return _edges(np.frombuffer(raw, np.uint8))


def words_of_lines(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words in order, A-Z lower-cased, and the number of each word's line."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, line = _edges(b)
    return spans(prefix(b), starts, ends), line


def runs(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, at a cost that does not depend on it; fewer words have none."""
    n = len(word_hashes)
    if n < width:
        return word_hashes[:0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes * powers(n)[0][:n], out=sums[1:])
    starts = np.arange(n - width + 1)
    return spans(sums, starts, starts + width)


def windows(word_hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all windows of ``width`` words; fewer words are one window, none has none."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    used = min(width, n)
    out = np.full(n - used + 1, used, np.uint64)
    for j in range(used):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + word_hashes[j : n - used + 1 + j])
    return out
