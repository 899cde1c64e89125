"""Word shingles, their sets and b-bit MinHash signatures (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

SYMBOLS = 60                    # MinHash values in a signature
BITS = 16                       # of each that are kept

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text (ASCII letters lower-cased, split at ASCII white space)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    octets = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lens) - lens
    place = (np.arange(len(octets)) - np.repeat(starts, lens)).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(octets + (place << np.uint64(9))), starts) + lens.astype(np.uint64) * _ODD)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; all words as one run if there are fewer; empty without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = mixed(h * _ODD + w[j:len(w) - k + 1 + j])
    return np.unique(h)


def set_name(s: np.ndarray) -> int:
    """64-bit name of a set (signed); equal sets have equal names."""
    total = mixed(s + _ODD).sum(dtype=np.uint64, keepdims=True) + mixed(np.array([len(s)], dtype=np.uint64))
    return int(mixed(total).view(np.int64)[0])


def signature(s: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """The low ``BITS`` bits of the smallest hash of the set under each of ``symbols`` hash functions."""
    seeds = mixed(np.arange(1, symbols + 1, dtype=np.uint64) * _ODD)[:, None]
    odd = mixed(np.arange(1, symbols + 1, dtype=np.uint64) * _MIX2)[:, None] | np.uint64(1)
    least = np.full(symbols, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(s), 2048):
        h = s[None, at:at + 2048] ^ seeds
        h *= odd
        h >>= np.uint64(32)
        least = np.minimum(least, h.min(axis=1).astype(np.uint32))
    return (mixed(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def chunks(m: int, symbols: int = SYMBOLS) -> list[tuple[int, int]]:
    """``m`` consecutive parts of a signature, of nearly equal size."""
    edges = [symbols * i // m for i in range(m + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def keys(signatures: np.ndarray, m: int) -> np.ndarray:
    """Index keys of signatures (rows): every chunk, with one of its symbols at a time left out as the allowed error.

    Two signatures that differ in at most ``2 * m - 1`` symbols have a chunk with at most one
    difference, and so share the key that leaves it out.
    """
    out = []
    for n, (a, b) in enumerate(chunks(m, signatures.shape[1])):
        for left_out in range(a, b):
            h = np.full(len(signatures), n * 1000 + left_out - a, dtype=np.uint64)
            for j in range(a, b):
                if j != left_out:
                    h = mixed(h * _ODD + signatures[:, j].astype(np.uint64))
            out.append(h)
    return np.stack(out, axis=1)


def chunk_count(similarity: float, symbols: int = SYMBOLS, loss: float = 1e-6) -> int:
    """Fewest chunks at which a pair of that similarity exceeds the distance with probability below ``loss``."""
    from math import comb

    p = 1 - similarity
    for m in range(1, symbols // 2 + 1):
        if sum(comb(symbols, k) * p ** k * (1 - p) ** (symbols - k) for k in range(2 * m, symbols + 1)) < loss:
            return m
    return symbols // 2
