"""Sets of word shingles as sorted arrays of 64-bit fingerprints, without a Python object for each word."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are hashed in pieces of about so many bytes, cut at white space.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_piece(data: np.ndarray) -> np.ndarray:
    blank = _BLANK[data]
    solid = ~blank
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    offset = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    # a word is the sum of strong hashes of its bytes with their places; a polynomial modulo 2**64 has equal words by construction
    value = mix(data.astype(np.uint64) + (offset.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    value[blank] = 0
    return mix(np.add.reduceat(value, starts) + mix(sizes.astype(np.uint64)))


def word_hashes(data: bytes) -> np.ndarray:
    """A fingerprint for each word of a text whose A-Z are in lower case."""
    if len(data) <= PIECE:
        return _hash_piece(np.frombuffer(data, np.uint8))
    out, at = [], 0
    whole = np.frombuffer(data, np.uint8)
    while at < len(whole):
        end = min(len(whole), at + PIECE)
        while end < len(whole) and not _BLANK[whole[end]]:
            end += 1
        out.append(_hash_piece(whole[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of all runs of `size` words; of the whole text as one where it has fewer."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = min(size, len(words))
    if not n:
        return words
    count = len(words) - n + 1
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[k : k + count])
    return np.unique(out)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
