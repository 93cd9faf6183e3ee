"""Words of whole Arrow text batches and their 64-bit hashes, computed on the UTF-8 bytes with NumPy.

A word hash is a polynomial over a random table of byte values, mixed with the word's length, so
two words agree by chance with a probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import by_weight

_RNG = np.random.Generator(np.random.PCG64(20_24))
_VALUES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 500_000

# Bytes that belong to words: anything but ASCII white space, or letters, digits and non-ASCII.
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        factors = np.full(max(n, _BLOCK + 1), base, np.uint64)
        factors[0] = 1
        found = np.cumprod(factors)
        if len(found) <= 2 * _BLOCK:
            _POWERS[base] = found
    return found[:n]


@dataclass
class Words:
    """The words of the rows ``at`` .. ``at + len(first) - 1`` of a batch.

    Row r has the words ``first[r] : first[r + 1]``; ``start`` and ``end`` are byte offsets in
    ``data``, the concatenated texts.
    """

    at: int
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def row(self) -> np.ndarray:
        """Row of every word, counted from 0 within these rows."""
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def joined(self, stay: np.ndarray) -> pa.Array:
        """Text of every row from the words that ``stay``, by single spaces."""
        chosen = np.flatnonzero(stay)
        size = self.end[chosen] - self.start[chosen] + 1
        kept_until = np.concatenate([[0], np.cumsum(stay)])[self.first]
        final = kept_until[1:][np.diff(kept_until) > 0] - 1
        size[final] -= 1  # no space after the last word of a row
        until = np.cumsum(size)
        source = np.arange(int(until[-1]) if len(until) else 0) + np.repeat(self.start[chosen] - until + size, size)
        body = np.append(self.data, np.uint8(0))[source]  # each word and the byte after it
        body[np.delete(until - 1, final)] = 0x20
        offsets = np.concatenate([[0], until])[kept_until].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), self.rows, [None, pa.py_buffer(offsets), pa.py_buffer(body)])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of ``k`` consecutive words of one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += self.hash[j : j + n] * _GRAM[j]
        row = self.row
        at = np.flatnonzero(row[:n] == row[k - 1 :])
        return at, mix(total[at] + np.uint64(k))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    values = _VALUES[_LOWER] if fold else _VALUES
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        low, high = int(start[i]), int(end[j - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * _powers(_BASE, high - low), out=sums[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * _powers(_BASE_INVERSE, high - low)[s]
        i = j
    return mix(out + (end - start).astype(np.uint64))


def words_of(texts: pa.Array, kind: np.ndarray, fold: bool, hashed: bool = True) -> Iterator[Words]:
    """Words of every row, some rows at a time; NULL has none. ``fold`` hashes A-Z as a-z.

    Without ``hashed`` the words have no hashes, which saves most of the work.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    for at, to in by_weight(texts):
        part = texts.slice(at, to - at)
        _, offsets, body = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(body or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        mask = kind[data]
        inside = np.zeros(len(mask) + 1, bool)  # True where a word goes on from byte i - 1 to i
        inside[1:-1] = mask[1:] & mask[:-1]
        inside[offsets] = False
        start = np.flatnonzero(mask & ~inside[:-1])
        end = np.flatnonzero(mask & ~inside[1:]) + 1
        hashes = _hashes(data, start, end, fold) if hashed else np.empty(0, np.uint64)
        yield Words(at, np.searchsorted(start, offsets), start, end, hashes, data)
