"""Texts of an Arrow batch as one byte array, and hashes of their words and shingles, by numpy.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D. A word's hash is
a polynomial of randomly chosen 64-bit values of its bytes, taken for all words of a block at once from running
sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_TURN = pow(_BASE, -1, 1 << 64)
_PLACES = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _BYTE[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)
#: Bytes of text that are worked on at a time, unless one text is longer.
BLOCK = 1 << 19
PIECE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64; a bijection."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _TURN, np.uint64)
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts) of runs of rows; starts has one more entry than there are rows.

    Each text is followed by one space. Null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        own = at[first : last + 1] - at[first]
        data = raw[at[first] : at[last]]
        data = np.insert(data, own[1:], 32) if last - first > 1 else np.append(data, np.uint8(32))  # insert makes flags of the same length
        yield first, data, own + np.arange(len(own))
        first = last


def _long_sum(own: np.ndarray, value: np.ndarray) -> int:
    """The polynomial of a run longer than PIECE, by pieces."""
    up, total, scale = _powers(PIECE)[0], 0, 1
    for a in range(0, len(own), PIECE):
        part = value[own[a : a + PIECE]]
        total += scale * int((part * up[: len(part)]).sum(dtype=np.uint64))
        scale = scale * pow(_BASE, PIECE, 1 << 64) % (1 << 64)
    return total % (1 << 64)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes from start to end, by stretches of about PIECE bytes, as a hash doesn't depend on the place."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        a = start[i]
        if end[i] - a > PIECE:
            out[i], i = _long_sum(data[a : end[i]], value), i + 1
            out[i - 1 : i] = mix(out[i - 1 : i])
            continue
        j = max(i + 1, int(np.searchsorted(end, a + PIECE, "right")))
        up, down = _powers(end[j - 1] - a + 1)
        own = data[a : end[j - 1]]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[own] * up[: len(own)], dtype=np.uint64)))
        out[i:j] = mix((sums[end[i:j] - a] - sums[start[i:j] - a]) * down[start[i:j] - a])
        i = j
    return out


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words of one text, by the hashes of its words."""
    n = max(len(h) - size + 1, 0)
    return mix(sum((h[j : j + n] * _PLACES[j] for j in range(size)), np.full(n, size, np.uint64)))


class Words:
    """Words of a block: starts and ends in bytes, 64-bit hashes, and first: the first word of each row and the end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lower: bool = True):
        """lower: letters A to Z count as a to z."""
        inside = ~_IS_SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = _hashes(data, self.start, self.end, _VALUE if lower else _BYTE)
        self.first = np.searchsorted(self.start, starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of size words of each row, and the first run of each row and the end."""
        n = len(self.hash)
        if len(self.first) == 2 and n >= size:  # a long text is a block of its own: by stretches, without indices
            out = np.empty(n - size + 1, np.uint64)
            for a in range(0, len(out), PIECE):
                b = min(a + PIECE, len(out))
                out[a:b] = run_hashes(self.hash[a : b + size - 1], size)
            return out, np.array([0, len(out)])
        runs = np.maximum(self.counts() - size + 1, 0)
        at = np.repeat(self.first[:-1], runs) + _within(runs)
        h = np.full(len(at), size, np.uint64)
        for j in range(size):
            h += self.hash[at + j] * _PLACES[j]
        return mix(h) if n else h, np.concatenate(([0], np.cumsum(runs)))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """As windows; a row with fewer words has its whole sequence as its only shingle."""
        h, first = self.windows(size)
        n = self.counts()
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            own = n[short].astype(np.uint64)
            for j in range(size - 1):
                has = n[short] > j
                own[has] += self.hash[self.first[short[has]] + j] * _PLACES[j]
            h = np.insert(h, first[short], mix(own))
            runs = np.diff(first)
            runs[short] = 1
            first = np.concatenate(([0], np.cumsum(runs)))
        return h, first


def _within(runs: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run."""
    return np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending, and the first of each row and the end."""
    out = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate(out) if out else h, np.concatenate(([0], np.cumsum([len(x) for x in out], dtype=np.int64)))
