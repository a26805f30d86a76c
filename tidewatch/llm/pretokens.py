"""Byte-level BPE pre-tokens of whole batches, by array work in place of a regular expression.

`pretoken_starts` finds the matches of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

in all texts of a batch at once; tests hold it against the pattern itself.
`WordTable` then numbers the distinct pre-tokens, so that each is encoded once.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd

from tidewatch.llm.arrays import U64, RollingHash, mix, spread

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Fixed value: the endings that the pattern cuts off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = 0x10FFFF
    every = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


@functools.lru_cache(maxsize=1)
def point_hashes() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=U64) * U64(0xA24BAED4963EE407))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row as code points, and len + 1 offsets."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), offsets


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each pre-token starts; it ends where the next one starts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    start = text_start[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # A run of white space gives up its last character if text follows it.
    space = kind == SPACE
    last = space.copy()
    last[:-1] &= ~space[1:] | text_start[1:n]
    last &= ~text_start[1:]  # text follows
    last = np.flatnonzero(last)
    start[last] = True
    joined = last[points[last] == 32] + 1  # a blank joins what follows
    start[joined] = False
    # Contractions, where a pre-token starts with an apostrophe.
    marks = np.flatnonzero((points == 39) & start)
    if len(marks):
        text_end = offsets[np.searchsorted(offsets, marks, side="right")]
        found = np.zeros(len(marks), np.int64)
        for ending in CONTRACTIONS:
            fits = (found == 0) & (marks + len(ending) < text_end)
            for i, c in enumerate(ending, 1):
                fits[fits] &= points[marks[fits] + i] == ord(c)
            found[fits] = len(ending)
        cut = found > 0
        start[marks[cut] + 1] = False
        after = marks[cut] + found[cut] + 1
        start[after[after < n]] = True
    return np.flatnonzero(start)


class WordTable:
    """Distinct words seen so far and the token ids of each; `encode` is asked for new ones only.

    It is emptied once it holds `limit` words, so a worker's memory stays bounded.
    """

    def __init__(self, encode, limit: int = 800_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: list[pd.Index] = []
        self.size = 0
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1. The index is kept in a few parts of growing size."""
        found, before = np.full(len(hashes), -1, np.int64), 0
        for part in self.index:
            at = part.get_indexer(hashes)
            hit = at >= 0
            found[hit] = at[hit] + before
            before += len(part)
        return found

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word of the batch, and len + 1 offsets of the texts into them."""
        points, offsets = code_points(texts)
        starts = pretoken_starts(points, offsets)
        ends = np.append(starts[1:], len(points))[: len(starts)]
        hashes = RollingHash(point_hashes()[points]).of(starts, ends)
        code, distinct = pd.factorize(hashes)
        row = self.lookup(distinct)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            if self.size + len(missing) > self.limit:
                self.clear()
                missing = np.arange(len(distinct))
            sample = np.empty(len(distinct), np.int64)
            sample[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            text = "".join(texts)
            words = [text[a:b] for a, b in zip(starts[sample[missing]], ends[sample[missing]], strict=True)]
            self.add(distinct[missing], *self.encode(words))
            row = self.lookup(distinct)
        return row[code], np.searchsorted(starts, offsets)

    def add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        new = pd.Index(hashes)
        while self.index and len(self.index[-1]) <= 2 * len(new):
            new = self.index.pop().append(new)
        self.index.append(new)
        self.first = np.append(self.first, len(self.ids) + np.cumsum(counts) - counts)
        self.count = np.append(self.count, counts)
        self.ids = np.append(self.ids, ids.astype(np.int32))
        self.size += len(counts)

    def tokens(self, rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words in `rows`, and the texts' offsets into them."""
        counts = self.count[rows]
        before = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        return self.ids[spread(self.first[rows], counts)], before[offsets]
