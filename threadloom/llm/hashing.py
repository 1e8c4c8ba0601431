"""64-bit hashes of words and of runs of words, for whole batches of texts in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

_KNOWN = 1 << 20


class WordHashes(dict):
    """Hash of each word, remembered; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between the six spaces, as UTF-8; ``lower`` turns A-Z into a-z."""
    raw = (text or "").encode()
    # bytes.split() knows exactly these six spaces, bytes.lower() only A-Z.
    return (raw.lower() if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order; empty if there are fewer."""
    n = words.size - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = mix(total + words[j : j + n] + np.uint64(j + 1))
    return total


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct runs; fewer words than ``size`` count as one run, no words as none."""
    return np.unique(run_hashes(words, min(size, words.size))) if words.size else np.zeros(0, np.uint64)


def seeds(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms of ``n`` hash functions."""
    draw = np.random.default_rng(seed).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def minhashes(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest value of the shingles under each function, a block of shingles at a time."""
    factors, terms = functions
    best = np.full(factors.size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, shingles.size, 4096):
        x = shingles[None, at : at + 4096] * factors[:, None] + terms[:, None]
        best = np.minimum(best, (x ^ (x >> np.uint64(32))).min(axis=1))
    return best


def fold(values: np.ndarray, group: int) -> np.ndarray:
    """One hash for each ``group`` successive values, which also depends on their place."""
    parts = values.reshape(-1, group)
    total = np.arange(parts.shape[0], dtype=np.uint64)
    for j in range(group):
        total = mix(total + parts[:, j] + np.uint64(1))
    return total


def as_longs(values: Sequence[int] | np.ndarray) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)
