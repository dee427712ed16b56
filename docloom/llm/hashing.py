"""64-bit hashes of byte spans, whole arrays at a time."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20
#: Byte values, A-Z as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> list[np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * _BLOCK)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[s:e] for each ascending span: differences of a running polynomial, blockwise."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + _BLOCK, "left"))
        stop = int(ends[j - 1])
        power, inverse = _power(stop - base + 1)
        run = np.zeros(stop - base + 1, U64)
        np.cumsum(_CODE[data[base:stop]] * power[: stop - base], out=run[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (run[e] - run[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def word_spans(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes within each row, and each row's first span (rows + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = member[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    edge = off[(off > 0) & (off < n)]
    first[edge] = m[edge]
    last[edge - 1] = m[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)
