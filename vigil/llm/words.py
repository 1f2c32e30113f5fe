"""Words and shingles of Arrow text batches as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is a run
of characters other than those; A-Z count as a-z. A word's hash is a polynomial
in its bytes over 64-bit integers, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Integers that are mixed at once.
_MIXED = 1 << 14
#: Bytes of text that are turned into arrays at once.
SLICE_BYTES = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers. Steps in between are as small as a cache."""
    out = np.array(x, np.uint64, order="C", ndmin=1)
    flat = out.reshape(-1)
    for a in range(0, len(flat), _MIXED):
        y = flat[a : a + _MIXED]
        y ^= y >> np.uint64(30)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(27)
        y *= np.uint64(0x94D049BB133111EB)
        y ^= y >> np.uint64(31)
    return out


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes, null as empty) with about `most` bytes each; a longer text comes alone."""
    rows, size, first = [], 0, 0
    for i, x in enumerate(column):
        b = x.as_buffer().to_pybytes() if x.is_valid else b""
        if rows and size + len(b) > most:
            yield first, rows
            rows, size, first = [], 0, i
        rows.append(b)
        size += len(b)
    if rows:
        yield first, rows


class Words:
    """All words of some texts: hash, start and end in the joined bytes, and the first word of each text in `bounds`."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts)
        self.raw = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        begins = np.zeros(len(texts), np.int64)
        np.cumsum(sizes[:-1] + 1, out=begins[1:])
        solid = np.zeros(len(self.raw) + 2, np.int8)
        solid[1:-1] = ~_SPACE[self.raw]
        step = np.diff(solid)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.bounds = np.append(np.searchsorted(self.starts, begins), len(self.starts))
        up, down = _powers(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(_BYTE[self.raw] * up[: len(self.raw)], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def text(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k in a row."""
    n = len(h) - k + 1
    out = np.full(max(n, 0), np.uint64(k), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_BASE) + h[j : j + n])
    return out


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k words in a row; of fewer words, one of all; of none, empty."""
    if len(h) == 0:
        return np.empty(0, np.uint64)
    return np.unique(rolled(h, k)) if len(h) >= k else rolled(h, len(h)) ^ np.uint64(0x5555555555555555)
