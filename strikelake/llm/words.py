"""Words of whole texts as arrays: spans, 64-bit hashes and shingles, on UTF-8 bytes.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Those are ASCII, so bytes and
characters give the same words.
"""

from __future__ import annotations

import numpy as np

GAP = np.zeros(256, bool)
GAP[[32, 9, 10, 11, 12, 13]] = True
_STEP = 0x9E3779B97F4A7C13 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses rows."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~GAP[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]
    end = offsets[1:][offsets[1:] > 0] - 1
    last[end] = inside[end]
    starts = np.flatnonzero(first)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, np.flatnonzero(last) + 1, rows


class Hasher:
    """64-bit hashes of byte ranges: random values of the bytes, weighted by powers of an odd number."""

    def __init__(self, seed: int = 1, size: int = 1 << 20):
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)
        self._grow(size)

    def _grow(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(size, _STEP, np.uint64))
            self.inverse = np.cumprod(np.full(size, pow(_STEP, -1, 1 << 64), np.uint64))

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ``data[start:end]``; both arrays ascend."""
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            base = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, base + len(self.power), "right")))
            stop = int(ends[hi - 1])
            if stop - base > len(self.power):
                self._grow(stop - base)
            total = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(self.table[data[base:stop]] * self.power[: stop - base], out=total[1:])
            a, b = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = mix((total[b] - total[a]) * self.inverse[a] + (b - a).astype(np.uint64))
            lo = hi
        return out


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> list[np.ndarray]:
    """Per row its sorted distinct k-word shingles; all words as one where there are fewer than k."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    seed = _U(0xA0761D6478BD642F)
    chained = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k if len(chained) else 0):
        chained = mix(chained * seed + hashes[j : j + len(chained)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(chained[a : b - k + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                whole = mix(whole * seed + hashes[j : j + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out
