"""Words of whole texts as numpy arrays, straight from Arrow's string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about this many bytes, which bounds memory; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: equal in, equal out, otherwise like random draws."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n + 1:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for i, base in enumerate((_BASE, inverse)):
            step = np.full(n + 1, base, np.uint64)
            step[0] = 1
            _powers[i] = np.cumprod(step)
    return _powers[0], _powers[1]


class Words:
    """Words of some texts: ``doc`` (row of the text), byte ``start`` and ``end`` in ``data``; ``first[i]:first[i+1]`` are text i's; ``solid`` says which bytes lie in words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = self.solid = ~_IS_SPACE[data]
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        edges = offsets[:-1][np.diff(offsets) > 0]  # words end with their text
        opens[edges] = solid[edges]
        tails = edges[edges > 0] - 1
        closes[tails] = solid[tails]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z lower-cased if asked.

        Each byte is mixed with its place in the word before the sum, so no pattern of bytes cancels out.
        """
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        first = np.cumsum(size) - size
        place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
        own = self.data[place + np.repeat(self.start, size)]
        codes = _LOWER[own] if lower else own.astype(np.uint64)
        return mix64(np.add.reduceat(mix64((codes << np.uint64(40) | place.astype(np.uint64)) + _BASE), first) + size.astype(np.uint64))


def run_hashes(word: np.ndarray, k: int, step: int = int(_STEP)) -> np.ndarray:
    """A hash of each k consecutive entries (also across texts: the caller knows where texts end)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, power = np.zeros(n, np.uint64), 1
    for j in range(k):
        total += word[j : j + n] * np.uint64(power)
        power = power * step % (1 << 64)
    return mix64(total)


def pieces(batch: pa.RecordBatch, text: str, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive rows of a batch, each of about ``size`` bytes; null is empty."""
    column = batch.column(text) if isinstance(batch, pa.RecordBatch) else batch[text]
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(places, width, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    pa.default_memory_pool().release_unused()  # workers live on from task to task
