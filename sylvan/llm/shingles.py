"""Five-word shingles as 64-bit hashes, and the universe partition that near-duplicate search indexes."""

from __future__ import annotations


import numpy as np
import xxhash

WIDTH = 5

#: Odd multipliers for the words of a shingle, by place.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case. (bytes.split() parts at exactly 0x20 and 0x09 to 0x0D.)"""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash for each run of `width` words; of fewer words, one for all of them. It covers the words and their number."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    w = min(n, width)
    with np.errstate(over="ignore"):
        out = np.full(n - w + 1, np.uint64(w) * np.uint64(0x2545F4914F6CDD1D), np.uint64)
        for i in range(w):
            out = mix(out + h[i : n - w + 1 + i] * _PLACES[i % WIDTH])
    return out


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(words_of(text))))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """True if 100 times the intersection is at least 75 times the union."""
    if not len(a) or not len(b) or 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)
