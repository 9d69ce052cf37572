"""Byte-level BPE over whole blocks of text.

A block's pre-tokens are found with array operations on its code points, equal
pre-tokens are encoded once, and the ids are gathered back in place.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Distinct pre-tokens whose ids a worker remembers between blocks.
CACHE_WORDS = 400_000


@lru_cache(1)
def _classes() -> np.ndarray:
    """The pattern's class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    valid = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, valid):
            a, b = ord(m[0][0]), ord(m[0][-1])
            kinds[a : b + 1] = kind
    return kinds


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    points = lead.astype(np.int32)
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        first, where = lead[wide].astype(np.int32), at[wide]
        size = np.where(first >= 0xF0, 4, np.where(first >= 0xE0, 3, 2))
        value = first & np.where(size == 4, 0x07, np.where(size == 3, 0x0F, 0x1F))
        for k in (1, 2, 3):
            on = size > k
            value[on] = (value[on] << 6) | (data[where[on] + k] & 0x3F)
        points[wide] = value
    return points, at


def pre_tokens(data: np.ndarray, offsets: np.ndarray, most: int = 2 << 20) -> np.ndarray:
    """As ``_pre_tokens``, a few whole texts at a time so that the arrays stay small."""
    cuts = [0]
    while cuts[-1] < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[cuts[-1]] + most, "right")) - 1
        cuts.append(max(end, cuts[-1] + 1))
    return np.concatenate([np.zeros(0, np.int64), *(_pre_tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) + offsets[a] for a, b in zip(cuts, cuts[1:]))])


def _pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which a match of the public GPT-2 pattern starts, for texts laid end to end.

    Every text starts a match; contractions ('s, 't, 're, 've, 'm, 'll, 'd) are
    matches only where an apostrophe starts one.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    points, at = code_points(data)
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True  # empty texts share a place
    first[n] = True
    space = kind == SPACE
    start = np.empty(n, bool)
    start[0] = True
    before, now = kind[:-1], kind[1:]
    start[1:] = np.where(
        now == SPACE,
        (before != SPACE) | ~np.append(space[2:], True) & ~first[2:],
        np.where(before == SPACE, points[:-1] != 0x20, before != now),
    )
    start[first[:n]] = True
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        padded = np.append(points, [0, 0])
        padded_first = np.append(first, [True, True])
        one, two = padded[quote + 1], padded[quote + 2]
        inside1 = ~padded_first[quote + 1]
        inside2 = inside1 & ~padded_first[quote + 2]
        short = inside1 & np.isin(one, [ord(c) for c in "stmd"])
        long = inside2 & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        start[quote[long] + 2] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        start[after[after < n]] = True
    return at[start]


def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks from a .tiktoken file, or from the vocabulary of a byte-level tokenizer's .json file."""
    if path.endswith(".json"):
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        special = {t["content"] for t in whole.get("added_tokens", [])}
        return {bytes(byte_of[c] for c in t): i for t, i in whole["model"]["vocab"].items() if t not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def added_of(path: str) -> dict[bytes, int]:
    """Added tokens of a .json file: strings that are one id wherever a text holds them, found before it is pre-tokenised."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take or need what stands beside them are not supported")
    return {t["content"].encode(): t["id"] for t in added}


class Encoder:
    """Encodes blocks of texts by the ranks in a vocabulary file, and decodes ids to bytes.

    A .json file's added tokens are found in texts as the ``tokenizers`` library
    finds them by default; a .tiktoken file has none.
    """

    def __init__(self, path: str):
        import tiktoken

        self.ranks = ranks_of(path)
        core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self._encode = core.encode_ordinary  # of a whole pre-token
        self.added = added_of(path)
        self._find = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._cache: dict[bytes, list[int]] = {}
        size = max([*self.ranks.values(), *self.added.values()]) + 1
        table = [b""] * size
        for token, i in [*self.ranks.items(), *self.added.items()]:
            table[i] = token
        self.token_bytes = pa.array(table, pa.large_binary())
        self.decimals = pa.array([f"{i}," for i in range(size)], pa.large_string())

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that start at ``starts`` and cover ``data``, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        bounds = np.append(starts, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        _, at, own_bytes = coded.dictionary.buffers()
        at, own_bytes = np.frombuffer(at, np.int64)[: len(coded.dictionary) + 1].tolist(), own_bytes.to_pybytes()
        distinct = [own_bytes[a:b] for a, b in zip(at, at[1:])]
        cache, one = self._cache, self._encode
        own = list(map(cache.get, distinct))
        for k in [k for k, ids in enumerate(own) if ids is None]:
            word = distinct[k]
            own[k] = cache[word] = [self.added[word]] if word in self.added else one(word.decode())
        if len(cache) > CACHE_WORDS:
            cache.clear()
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter(chain.from_iterable(own), np.int32, int(lengths.sum()))
        begin = np.cumsum(lengths) - lengths
        which = np.asarray(coded.indices)
        counts = lengths[which]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(begin[which] - (ends - counts), counts) + np.arange(ends[-1])]
        return ids, counts

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and the offsets of each text's ids."""
        begin, end = self._added_in(data, offsets)
        starts = pre_tokens(data, np.union1d(offsets, np.concatenate([begin, end])) if len(begin) else offsets)
        if len(begin):
            around = np.searchsorted(begin, starts, "right") - 1
            starts = starts[(around < 0) | (starts == begin[around]) | (starts >= end[around])]
        ids, counts = self.encode(data, starts)
        total = np.append(0, np.cumsum(counts))
        return ids, total[np.searchsorted(starts, offsets)]


    def _added_in(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where added tokens begin and end in the texts."""
        spans: list[tuple[int, int]] = []
        if self._find is not None:
            raw = data.tobytes()
            near = {int(np.searchsorted(offsets, x, "right")) - 1 for m in self._find.finditer(raw) for x in (m.start(), m.end() - 1)}
            for k in sorted(near):  # a find across two texts is none
                spans += (m.span() for m in self._find.finditer(raw, int(offsets[k]), int(offsets[k + 1])))
        begin, end = zip(*spans) if spans else ((), ())
        return np.array(begin, np.int64), np.array(end, np.int64)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)
