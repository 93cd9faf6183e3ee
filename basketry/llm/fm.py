"""FM-index over word numbers: wavelet matrix, ranks, backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with one running count per 64 of them."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)])[:-1]

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones in front of each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Counts of a symbol in front of a position, from one bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            bit = ((symbols >> shift) & 1).astype(np.uint8)
            zeros = int(len(bit) - bit.sum(dtype=np.int64))
            self.levels.append((shift, Bits(bit), zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.start = self._down(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def count(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(symbol, i) - self.start[symbol]


def suffix_array(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Order of all suffixes, if the first ``longest`` symbols of each decide. Prefix doubling."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    width = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        if width >= longest or fresh[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: n - width] = fresh[width:] + 1
        rank = fresh * (n + 1) + second
        order = np.argsort(rank, kind="stable")
        width *= 2


class FmIndex:
    """Index of pieces, sequences of 64-bit words. Its text and suffix array are kept uncompressed.

    A separator ends each piece. Separators differ from each other for the suffix order, so the
    order is decided inside a piece; in the index they are one symbol that no search asks for.
    """

    def __init__(self, pieces: np.ndarray, lengths: np.ndarray):
        words, symbol = np.unique(pieces, return_inverse=True)
        count = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(len(pieces) + count, np.int64)
        body = np.ones(len(text), bool)
        body[ends] = False
        text[body] = symbol + 1
        self.text, self.piece = text, np.repeat(np.arange(count), lengths + 1)
        order = text + count
        order[ends] = np.arange(count)
        self.order = suffix_array(order, int(lengths.max()) + 1)
        alphabet = len(words) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.tree = WaveletMatrix(text[self.order - 1], alphabet)

    def search(self, at: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the words before each place ``at``, and their suffix intervals.

        Backward search takes one more word in front per step, up to ``longest`` in all, and stops
        where what it has occurs once only. The statistic is the number of words that occur again
        elsewhere; the interval is that of the last step.
        """
        symbol = self.text[at - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        matched = np.where(high - low > 1, 1, 0)
        going = np.flatnonzero(matched)
        for j in range(2, longest + 1):
            symbol = np.tile(self.text[at[going] - j], 2)
            ends = self.first[symbol] + self.tree.count(symbol, np.concatenate([low[going], high[going]]))
            low[going], high[going] = np.split(ends, 2)
            going = going[high[going] - low[going] > 1]
            matched[going] = j
        return matched, low, high


def earlier_windows(
    pieces: np.ndarray, lengths: np.ndarray, owner: np.ndarray, span: int, step: int = 200_000
) -> tuple[np.ndarray, np.ndarray]:
    """Piece and offset of the windows of ``span`` words that occur in a piece of a smaller owner.

    All pieces are indexed; then the windows of all pieces are streamed through the index. Those
    whose matching statistic reaches ``span`` occur several times, and the smallest owner of their
    suffix interval tells whether one is an earlier one.
    """
    index = FmIndex(pieces, lengths)
    owners = owner[index.piece[index.order]]
    start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    windows = lengths - span + 1
    piece = np.repeat(np.arange(len(lengths)), windows)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = start[piece] + offset
    out_piece, out_offset = [], []
    for i in range(0, len(at), step):
        matched, low, high = index.search(at[i : i + step] + span, span)
        again = np.flatnonzero(matched == span)
        # Intervals of one length are equal or disjoint.
        begins, which = np.unique(low[again], return_inverse=True)
        ends = np.zeros(len(begins), np.int64)
        ends[which] = high[again]
        edges = np.ravel(np.column_stack([begins, ends]))
        padded = np.append(owners, np.iinfo(np.int64).max)
        least = np.minimum.reduceat(padded, edges)[::2] if len(edges) else padded[:0]
        hit = again[least[which] < owner[piece[i + again]]]
        out_piece.append(piece[i + hit])
        out_offset.append(offset[i + hit])
    none = [np.empty(0, np.int64)]
    return np.concatenate(out_piece or none), np.concatenate(out_offset or none)
