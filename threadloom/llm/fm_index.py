"""Compressed full-text index of word sequences: suffix order, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the length they are compared on."""
    n = text.size
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    length = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - length] = rank[length:] + 1
        keys = rank * (n + 1) + follow
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = new
        if new[-1] == n - 1 or length >= n:
            return order
        length *= 2


class FMIndex:
    """Backward search over a set of word sequences; no match crosses two of them.

    The Burrows-Wheeler text is kept in a wavelet matrix: one packed bit vector
    per bit of the symbol with a count every 64 bits, 1.5 bits of memory for each
    bit stored.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        # Symbol 0 closes every sequence, so it is in no query.
        self.vocabulary, symbols = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths) + np.arange(lengths.size)
        text = np.zeros(words.size + lengths.size, np.int64)
        mask = np.ones(text.size, bool)
        mask[ends] = False
        text[mask] = symbols + 1
        self.size = text.size
        last = text[suffix_array(text) - 1]
        self.levels = max(1, int(self.vocabulary.size).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        seq = last
        for level in range(self.levels):
            bit = (seq >> (self.levels - 1 - level)) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            padded = np.zeros((self.size // 64 + 1) * 8, np.uint8)
            padded[: packed.size] = packed
            blocks = padded.view(np.uint64)
            self.bits.append(blocks)
            ones = np.bitwise_count(blocks).astype(np.uint32)
            self.counts.append(np.cumsum(ones, dtype=np.uint32) - ones)
            self.zeros.append(int(self.size - ones.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        all_symbols = np.arange(self.vocabulary.size + 1)
        before = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=all_symbols.size))[:-1]])
        self.shift = before - self._descend(all_symbols, np.zeros(all_symbols.size, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            one = ((symbols >> (self.levels - 1 - level)) & 1).astype(bool)
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][block] + np.bitwise_count(self.bits[level][block] & mask)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def prepend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that start with the symbol and go on as before."""
        n = symbols.size
        moved = self._descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        shift = self.shift[symbols]
        return moved[:n] + shift, moved[n:] + shift

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for words that the index does not hold."""
        if not self.vocabulary.size:
            return np.zeros(words.size, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), self.vocabulary.size - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def matches(self, words: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
        """For each word of the queries: does a run of ``least`` words that starts here occur?

        Works from the end of each query. While the run from the current word to
        the current end occurs it is extended to the left; its length is the
        matching statistic. When it stops occurring, the next end is the last one
        for which a run of ``least`` words may still occur.
        """
        found = np.zeros(words.size, bool)
        text = self.symbols(words)
        start = np.cumsum(lengths) - lengths
        active = lengths >= least
        start, end = start[active], (lengths[active] - 1).astype(np.int64)
        at = end.copy()
        low, high = np.zeros(end.size, np.int64), np.full(end.size, self.size, np.int64)
        while end.size:
            symbol = text[start + at]
            low, high = self.prepend(symbol, low, high)
            known = symbol > 0
            good = known & (high > low)
            long = good & (end - at + 1 >= least)
            found[(start + at)[long]] = True
            # A word the index does not hold ends all runs that contain it.
            retry = np.where(known, np.minimum(end - 1, at + least - 1), at - 1)
            end = np.where(good, end, retry)
            low, high = np.where(good, low, 0), np.where(good, high, self.size)
            at = np.where(good, at - 1, retry)
            going = (at >= 0) & (end >= least - 1)
            if not going.all():
                start, end, at, low, high = (x[going] for x in (start, end, at, low, high))
        return found
