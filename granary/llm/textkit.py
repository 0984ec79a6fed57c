"""Small numpy helpers shared by the text operators: words, hashes, shingles.

Words are the maximal runs of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``).  On UTF-8 bytes that is exactly ``bytes.split()``, and
``bytes.lower()`` lower-cases A-Z alone, so both stay away from locale and
Unicode tables.
"""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text as bytes; a null text has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of k consecutive word hashes (none if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd = _ODD + np.uint64(2 * seed)
    out = h[:n].copy()
    for j in range(1, k):
        out *= odd
        out += h[j : j + n]
    return mix64(out)


def shingle_set(text: str | None, k: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; a shorter text is one shingle as a whole."""
    h = word_hashes(words(text, lower))
    if len(h) == 0:
        return h
    return np.unique(gram_hashes(h, min(k, len(h)), seed=0 if len(h) >= k else len(h)))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0:
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
