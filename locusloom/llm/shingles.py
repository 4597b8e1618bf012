"""Sets of word shingles as sorted 64-bit hashes, computed over whole batches of texts with numpy."""

from __future__ import annotations

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes, as 64-bit values; the base of the polynomial and its inverse modulo 2**64.
VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of a number modulo 2**64, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), 1 << 64))
            self.values = np.concatenate((self.values, self.values * step))
        return self.values[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one number more than there are texts)."""
    raw = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    white = WHITE[raw]
    begin = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    end = np.flatnonzero(white & ~np.concatenate(([True], white[:-1])))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUES[raw] * UP(len(raw)), dtype=np.uint64)))
    hashes = mixed((sums[end] - sums[begin]) * DOWN(len(raw))[begin] + (end - begin).astype(np.uint64))
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(begin, edges)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``k`` words; of all its words if it has fewer, but some."""
    words, at = word_hashes(texts)
    if not len(words):
        return [np.empty(0, np.uint64)] * len(texts)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    value = np.full(len(words), k, np.uint64)
    for j in range(k):
        value = mixed(value * np.uint64(BASE) + padded[j : j + len(words)])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            x = np.sort(value[a : b - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                x = mixed(x * np.uint64(BASE) + words[j : j + 1])
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(x: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set, as two signed numbers."""
    with np.errstate(over="ignore"):
        return tuple(int(np.sum(mixed(x ^ np.uint64(seed)), dtype=np.uint64).astype(np.int64)) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
