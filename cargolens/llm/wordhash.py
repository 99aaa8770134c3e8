"""Words of whole Arrow text columns as arrays of 64-bit hashes, without a loop over words.

A word is a run of anything but ASCII white space. Its hash is a polynomial over its bytes,
taken from running sums over the whole buffer and mixed at the end, so that the cost is a
few array operations a byte. Equal words have equal hashes wherever they stand.

All arithmetic is modulo 2**64; an odd base has an inverse, which shifts a difference of
running sums back to the origin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are worked on at a time; a longer text is cut between words.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


class Words:
    """Hashes of words. ``fold``: A-Z count as a-z."""

    def __init__(self, fold: bool, seed: int = 1):
        byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1) + np.uint64(seed))
        if fold:
            byte[65:91] = byte[97:123]
        self.byte = byte
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)

    def _hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.byte[data] * self.up[:n], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.down[start])

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word; texts lie between neighbouring offsets."""
        word = ~self.space[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        first[edge] = word[edge]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[edge - 1] = word[edge - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts in a row, and where each text's words begin (one more than texts)."""
        start, end = self.bounds(data, offsets)
        parts, at = [], 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, side="right")))
            lo, hi = start[at], end[to - 1]
            parts.append(self._hash(data[lo:hi], start[at:to] - lo, end[at:to] - lo))
            at = to
        hashes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        return hashes, np.searchsorted(start, offsets)


def batches(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets): as many whole texts as fit into ``limit`` bytes, one at least.

    Null texts are empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        lo, hi = offsets[row], offsets[to]
        yield row, to, raw[lo:hi], offsets[row : to + 1] - lo
        row = to


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` neighbouring words, by the first word's place; crosses text borders."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if k <= 8:
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= np.uint64(BASE)
            out += hashes[j : j + n]
        return mix(out)
    up, down = powers(BASE, len(hashes)), powers(INVERSE, n)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down)
