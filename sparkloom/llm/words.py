"""Words, shingles and rolling hashes of whole blocks of text as array operations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes that are hashed at once: the size of the two tables of powers, whatever the size of a text.
WINDOW = 1 << 20

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for the places of a window."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.append(U(1), np.full(WINDOW - 1, U(b), np.uint64)), dtype=np.uint64) for b in (_BASE, inverse))


def _sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over a window whose differences, times an inverse power, are polynomial hashes of any run of its bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(values[data], powers()[0][: len(data)], out=sums[1:])
    np.cumsum(sums, out=sums)
    return sums


def run_hashes(data: np.ndarray, length: int, values: np.ndarray = _VALUE) -> np.ndarray:
    """Hash of the ``length`` (less than a window) bytes from every place on, of the places that have so many."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = WINDOW - length + 1
    for a in range(0, n, step):
        sums = _sums(data[a : a + step + length - 1], values)
        found = sums[length:] - sums[:-length]
        found *= powers()[1][: len(found)]
        out[a : a + len(found)] = mix(found)
    return out


def windows(data: np.ndarray, breaks: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of at least ``most`` bytes (the last may be shorter) that end between words."""
    a = 0
    while a < len(data):
        b = a + most
        while b < len(data):
            rest = breaks[data[b : b + most]]
            if rest.any():
                b += int(rest.argmax())
                break
            b += most
        b = min(b, len(data))
        yield a, b
        a = b


def _word_hashes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each word; windows end between words, and a word longer than one is hashed by its parts."""
    out = np.empty(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        a = begin[k]
        m = int(np.searchsorted(stop, a + WINDOW, "right"))
        if m > k:
            sums = _sums(data[a : stop[m - 1]], _VALUE)
            out[k:m] = (sums[stop[k:m] - a] - sums[begin[k:m] - a]) * powers()[1][begin[k:m] - a]
        else:
            m, total, scale = k + 1, 0, 1
            for x in range(int(a), int(stop[k]), WINDOW):
                total += scale * int(_sums(data[x : min(x + WINDOW, stop[k])], _VALUE)[-1])
                scale = scale * pow(_BASE, WINDOW, 1 << 64) % (1 << 64)
            out[k] = total % (1 << 64)
        k = m
    return mix(out + (stop - begin).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, breaks: np.ndarray = _BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (by default white-space separated) of texts laid end to end, where each starts, and each text's word offsets."""
    if lower:
        data = _LOWER[data]
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside & np.append(True, ~inside[:-1])[: len(data)]
    start |= inside & edge[:-1]
    end = inside & np.append(~inside[1:], True)[: len(data)]
    end |= inside & edge[1:]
    begin, stop = np.flatnonzero(start), np.flatnonzero(end) + 1
    return _word_hashes(data, begin, stop), begin, np.searchsorted(begin, offsets)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in each text, and the texts' offsets in them.

    A text of fewer words has one shingle, the whole of it; one without words has none.
    """
    counts = np.diff(at)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.append(0, np.cumsum(number))
    first = np.repeat(at[:-1] - bounds[:-1], number) + np.arange(bounds[-1])
    have = np.repeat(np.minimum(counts, size), number)
    padded = np.append(hashes, np.zeros(size, np.uint64))
    total = mix(have.astype(np.uint64))
    for k in range(size):
        total = total * U(0xD6E8FEB86659FD93) + np.where(have > k, padded[first + k], U(0))
    return mix(total), bounds


def long_set(data: np.ndarray, size: int = 5, most: int = 4 * WINDOW) -> np.ndarray:
    """Sorted distinct shingle hashes of one text, ``most`` bytes at a time (cut between words, so a longer word stays whole)."""
    found, tail, a = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
    fresh: list[np.ndarray] = []
    while a < len(data):
        rest = _BREAK[data[a + most :]] if a + most < len(data) else np.zeros(0, bool)
        b = a + most + int(rest.argmax()) if rest.any() else len(data)
        own, _, _ = words(data[a:b], np.array([0, b - a]))
        run = np.append(tail, own)
        if len(run) >= size:
            fresh.append(np.unique(shingles(run, np.array([0, len(run)]), size)[0]))
        tail, a = run[-(size - 1) :], b
        if sum(map(len, fresh)) > max(len(found), most):
            found, fresh = np.unique(np.concatenate([found, *fresh])), []
    if not len(found) and not fresh:
        return shingles(tail, np.array([0, len(tail)]), size)[0]
    return np.unique(np.concatenate([found, *fresh]))


def distinct_each(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each group, and the groups' new offsets."""
    values = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[at[:-1][at[:-1] < len(values)]] = True
    return values[keep], np.append(0, np.cumsum(keep))[at]


def minima(values: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Smallest value of each group under every seed's hash function: groups x seeds. Groups must not be empty."""
    out = np.empty((len(at) - 1, len(seeds)), np.uint64)
    for j, seed in enumerate(seeds):
        out[:, j] = np.minimum.reduceat((values ^ seed) * (seed | U(1)), at[:-1])
    return out
