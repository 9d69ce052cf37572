"""Suffix arrays of byte strings in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, in order of their first ``depth`` bytes at least.

    Suffixes are first sorted by eight bytes. Each round then sorts only the
    groups that are still tied, by the rank of the suffix so many bytes on, which
    doubles the sorted depth. A suffix alone in its group is never touched again.
    """
    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    order = np.argsort(key)
    # a zero byte and the end of the data look alike here; ends are told apart below, where a missing rank is the lowest
    rank = np.empty(n, np.int64)
    head = np.append(True, key[order[1:]] != key[order[:-1]]) if n else np.zeros(0, bool)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1] if n else 0
    if n:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        order[tied] = np.sort(rank[order[tied]] * n + order[tied]) % n  # ties in order of place
    reached = 8
    while reached < depth and n:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        suffix = order[tied]
        after = np.full(len(suffix), 0, np.int64)
        inside = suffix + reached < n
        after[inside] = rank[suffix[inside] + reached] + 1
        pair = rank[suffix] * (n + 1) + after
        if n < 1 << 20:  # pair and place fit one number
            both = np.sort(pair * n + suffix)
            pair, suffix = np.divmod(both, n)
        else:
            sort = np.argsort(pair, kind="stable")
            pair, suffix = pair[sort], suffix[sort]
        order[tied] = suffix
        new = np.append(True, pair[1:] != pair[:-1])
        head[tied] = new
        rank[suffix] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        reached *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, stride: int = 64) -> np.ndarray:
    """For each place in the suffix array, the bytes it shares with the one before, up to ``most`` (the first: 0).

    Kasai's pass: going through the text, a suffix shares at least one byte less
    with its predecessor than the suffix one byte before did. That needs the
    predecessor's own next suffix to come before it, which holds for a complete
    order; in one of limited depth it is looked up, and counting starts anew where
    it fails. The text is cut into strides that each make this pass, all at the
    same time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.arange(n)
    rank[n] = n
    shared = np.zeros(n, np.int64)
    at = np.arange(0, n, stride)
    end = np.minimum(at + stride, n)
    length = np.zeros(len(at), np.int64)
    padded = np.append(data, np.zeros(1, np.uint8))
    while len(at):
        other = before[at]
        a, b = at + length, other + length
        go = (other >= 0) & (length < most) & (a < n) & (b < n)
        go &= padded[np.minimum(a, n)] == padded[np.clip(b, 0, n)]
        stop = ~go
        shared[at[stop]] = length[stop]
        holds = rank[other + 1] < rank[np.minimum(at + 1, n)]
        length = np.where(go, length + 1, np.where(holds, np.maximum(length - 1, 0), 0))
        at = at + stop
        live = at < end
        if not live.all():
            at, end, length = at[live], end[live], length[live]
    return shared[order]


def repeats(data: np.ndarray, order: np.ndarray, shared: np.ndarray, usable: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each usable start of a string of ``length`` bytes: the first usable start of an equal string, and if it is another one."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    group = np.cumsum(shared < length)
    keep = usable[order]
    start, group = order[keep], group[keep]
    first = np.full(len(data), -1, np.int64)
    if len(start):
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(start, heads)
        first[start] = np.repeat(least, np.diff(np.append(heads, len(start))))
    return first, (first >= 0) & (first != np.arange(len(data)))
