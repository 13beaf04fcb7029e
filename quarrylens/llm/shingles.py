"""Sets of word shingles as sorted 64-bit hashes, and their minimum hashes."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIER
    return x ^ (x >> SHIFT)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Distinct shingles of ``size`` words; of a shorter text, all its words as one; sorted.

    Words are separated by ASCII white space; A-Z are lower-cased.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    width = min(size, len(words))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mixed(out + hashes[i : i + n])
    return np.unique(out)


class MinHash:
    """``total`` minimum hashes, the band keys of the first ``bands`` * ``rows``, and the low bits of all, packed in longs."""

    def __init__(self, bands: int, rows: int, total: int, bits: int, seed: int = 20):
        random = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.factors = random.integers(0, 2**63, total, np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = random.integers(0, 2**63, total, np.uint64)
        self.salts = random.integers(0, 2**63, bands, np.uint64)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The smallest value of each hash function; long sets are read in blocks."""
        out = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 256):
            block = hashes[i : i + 256, None] * self.factors + self.offsets
            out = np.minimum(out, block.min(axis=0))
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        key = self.salts.copy()
        for column in minima[: self.bands * self.rows].reshape(self.bands, self.rows).T:
            key = mixed(key + column)
        return key.view(np.int64)

    def signature(self, minima: np.ndarray) -> np.ndarray:
        per = 64 // self.bits
        low = mixed(minima) >> np.uint64(64 - self.bits)
        low = np.concatenate([low, np.zeros(-len(low) % per, np.uint64)]).reshape(-1, per)
        shifts = (np.arange(per) * self.bits).astype(np.uint64)
        return np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64)
