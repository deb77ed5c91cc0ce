"""Word shingles as 64-bit hashes, batch-wise with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
_CACHE_WORDS = 1 << 16
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"word", k) | 1 for k in range(SIZE)], dtype=np.uint64)
_U = np.uint64


class _WordHash(dict):
    """64-bit hash of a word, remembered while the table is small."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHE_WORDS:
            self[word] = value
        return value


_hash_of = _WordHash()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words make one shingle; no word, none."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        if len(words) < SIZE:
            whole = (h * _MULTIPLIERS[: len(h)]).sum(dtype=np.uint64)
            return mix(np.array([whole + _U(len(words))], dtype=np.uint64))
        n = len(h) - SIZE + 1
        total = h[:n] * _MULTIPLIERS[0]
        for k in range(1, SIZE):
            total += h[k : k + n] * _MULTIPLIERS[k]
    total = mix(total)
    total.sort()
    keep = np.empty(n, dtype=bool)
    keep[0] = True
    np.not_equal(total[1:], total[:-1], out=keep[1:])
    return total[keep]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
