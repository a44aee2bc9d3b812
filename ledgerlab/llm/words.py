"""Words of a text and hashes of word windows, for code that runs inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd multiplier of the rolling hash; arithmetic is modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str, lower: bool = False) -> list[bytes]:
    """Runs of other bytes than x20 and x09-x0D: what `bytes.split` parts at is exactly that set.

    `lower` changes A-Z alone, as `bytes.lower` does.
    """
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of `width` words, mixed at the end so that any bits of it can be used.

    The multiplier is odd and word hashes are 64-bit, so two different windows collide with probability 2**-64.
    """
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for offset in range(1, width):
        out *= BASE
        out += hashes[offset:offset + count]
    return mix(out)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose result bits all depend on all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values
