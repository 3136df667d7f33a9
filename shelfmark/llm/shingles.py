"""Words and five-word shingles of whole texts, as 64-bit hashes.

Words are runs of bytes other than ASCII white space, A-Z in lower case. A set of shingles is a sorted array of distinct
hashes; a text of fewer words than five has the whole sequence as its only shingle, one without words has none. Two
different shingles of one pair of texts share a hash with a chance of about n² / 2^65.
"""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def words(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def word_hashes(own: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))


def combine(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A hash of every ``size`` neighbours."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out *= _MULTIPLIERS[0]
        out ^= out >> np.uint64(29)
        out += hashes[i : i + n]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLIERS[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Hashes in order of the text, repeats included."""
    own = words(text)
    if 0 < len(own) < SIZE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), len(own))], np.uint64)
    return combine(word_hashes(own))


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingles(text))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
