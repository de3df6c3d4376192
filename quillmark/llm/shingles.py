"""Sets of five-word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Odd multipliers, one per place in a shingle, drawn once from a fixed generator.
_PLACES = np.random.default_rng(20240501).integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words without A-Z, as UTF-8: bytes.lower touches A-Z alone and bytes.split cuts at \\x20 and \\x09-\\x0D alone."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles, ascending; a text of fewer words is one shingle, an empty one has none."""
    words = words_of(text)
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    rolled = np.zeros(n - WORDS + 1, np.uint64)
    for j in range(WORDS):
        rolled += hashes[j : n - WORDS + 1 + j] * _PLACES[j]
    return np.unique(mix(rolled))


def set_key(shingles: np.ndarray) -> int:
    """Equal for equal sets; signed 64-bit."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), len(shingles)))))


def prefix_length(n: int, percent: int = 80) -> int:
    """Two sets of Jaccard >= percent/100 share one of so many first elements in any common order."""
    return n - -(-n * percent // 100) + 1


def similar(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """100 * |a & b| >= percent * |a | b|, in whole numbers."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)
