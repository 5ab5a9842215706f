"""Pair merging for many words at once: every round merges, in each word, the leftmost pair of lowest rank."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from itertools import islice

import numpy as np

from quillspark.llm.common import ranges

#: No pair: larger than any rank.
NONE = np.int32(2**31 - 1)
_EMPTY = np.uint32(2**32 - 1)


class PairTable:
    """(left id, right id) -> (rank, merged id), in hash levels that numpy can probe for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        self.levels: list[tuple[np.uint32, int, np.ndarray, np.ndarray, np.ndarray]] = []
        bits, at, multiplier = 19, np.arange(len(keys)), 2654435761
        while len(at):
            if len(self.levels) == 3:
                bits = max(4, int(len(at)).bit_length() + 6)
            slot = (keys[at] * np.uint32(multiplier)) >> np.uint32(32 - bits)
            own, ranks, ids = np.full(1 << bits, _EMPTY, np.uint32), np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
            _, first = np.unique(slot, return_index=True)
            own[slot[first]], ranks[slot[first]], ids[slot[first]] = keys[at[first]], rank[at[first]], merged[at[first]]
            self.levels.append((np.uint32(multiplier), 32 - bits, own, ranks, ids))
            at = np.delete(at, first)
            multiplier = (multiplier * 2246822519 + 2) % 2**32 | 1
            bits = max(8, bits - 3)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where the two do not merge; negative ids never do) and merged ids."""
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        ranks, ids = np.full(keys.shape, NONE, np.int32), np.zeros(keys.shape, np.int32)
        for multiplier, shift, own, r, m in self.levels:
            slot = (keys * multiplier) >> np.uint32(shift)
            hit = own[slot] == keys
            ranks = np.where(hit, r[slot], ranks)
            ids = np.where(hit, m[slot], ids)
        ranks[(left < 0) | (right < 0)] = NONE
        return ranks, ids

    def one(self, left: int, right: int) -> tuple[int, int]:
        r, m = self.look(np.array([left], np.int32), np.array([right], np.int32))
        return int(r[0]), int(m[0])


def merge_long(ids: Sequence[int], pairs: PairTable) -> list[int]:
    """One long word, by a heap of pairs and links to the neighbours."""
    n = len(ids)
    value, after, before = list(ids), [*range(1, n), -1], [-1, *range(n - 1)]
    ranks, merged = pairs.look(np.array(value[:-1], np.int32), np.array(value[1:], np.int32))
    heap = [(int(r), i, value[i], value[i + 1], int(m)) for i, (r, m) in enumerate(zip(ranks, merged)) if r != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i]
        if value[i] != a or j < 0 or value[j] != b:
            continue
        value[i], value[j] = new, -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for p, q in ((before[i], i), (i, after[i])):
            if p >= 0 and q >= 0:
                r, m = pairs.one(value[p], value[q])
                if r != NONE:
                    heapq.heappush(heap, (r, p, value[p], value[q], m))
    return [v for v in value if v >= 0]


def merge_all(flat: np.ndarray, lengths: np.ndarray, pairs: PairTable, wide: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(merged ids of all words in order, their number in each word) of words given as symbols in a row and lengths.

    Words beyond `wide` symbols are merged one by one, the others in matrices by length.
    """
    starts = np.cumsum(lengths) - lengths
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, counts, ids
    for i in np.flatnonzero(lengths > wide):
        own = np.array(merge_long(flat[starts[i] : starts[i] + lengths[i]].tolist(), pairs), np.int32)
        done.append((np.array([i]), np.array([len(own)]), own))
    low = 0
    for high in (4, 8, 12, 18, 26, wide):
        rows = np.flatnonzero((lengths > low) & (lengths <= high))
        low = high
        if len(rows):
            have = lengths[rows]
            grid = np.full((len(rows), high + 1), -1, np.int32)
            grid.ravel()[ranges(np.arange(len(rows)) * (high + 1), have)] = flat[ranges(starts[rows], have)]
            _merge_grid(grid, pairs)
            there = grid >= 0
            done.append((rows, there.sum(axis=1), grid[there]))
    counts = np.zeros(len(lengths), np.int64)
    for rows, sizes, _ in done:
        counts[rows] = sizes
    to = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int32)
    for rows, sizes, ids in done:
        out[ranges(to[rows], sizes)] = ids
    return out, counts


def _merge_grid(grid: np.ndarray, pairs: PairTable) -> None:
    """In place; each row is left-aligned, with -1 behind."""
    ranks, merged = pairs.look(grid[:, :-1], grid[:, 1:])
    columns = np.arange(grid.shape[1])
    live = np.flatnonzero(ranks.min(axis=1) != NONE)
    g, r, m = grid[live], ranks[live], merged[live]
    while len(live):
        at = r.argmin(axis=1)
        every = np.arange(len(live))
        go = r[every, at] != NONE
        if not go.all():
            grid[live[~go]] = g[~go]
            live, g, r, m, at = live[go], g[go], r[go], m[go], at[go]
            every = np.arange(len(live))
            if not len(live):
                break
        g[every, at] = m[every, at]
        move = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), grid.shape[1] - 1)
        g = np.take_along_axis(g, move, 1)
        g[:, -1] = -1
        move = np.minimum(columns[None, :-1] + (columns[None, :-1] > at[:, None]), r.shape[1] - 1)
        r, m = np.take_along_axis(r, move, 1), np.take_along_axis(m, move, 1)
        r[:, -1] = NONE
        r[every, at], m[every, at] = pairs.look(g[every, at], g[every, at + 1])
        back = np.maximum(at - 1, 0)
        rb, mb = pairs.look(g[every, back], g[every, back + 1])
        some = at > 0
        r[every[some], back[some]], m[every[some], back[some]] = rb[some], mb[some]


class Numbers(dict):
    """Word -> its number; a new word gets the next one when it is looked up."""

    def __missing__(self, word) -> int:
        self[word] = number = len(self)
        return number


class WordCache:
    """Word -> its ids, kept across batches in flat arrays and emptied when it holds `most` words."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self._empty()

    def _empty(self) -> None:
        self.at = Numbers()
        self.starts, self.counts, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def ids(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        if len(self.at) > self.most:
            self._empty()
        before = len(self.at)
        k = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        if len(self.at) > before:
            try:
                own, counts = self.encode([*islice(self.at, before, None)])
            except BaseException:
                self._empty()  # else the new words would have numbers and no ids
                raise
            total = len(own)
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used) + total, np.int32)])
            self.flat[self.used : self.used + total] = own
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.used += total
        counts = self.counts[k]
        return self.flat[ranges(self.starts[k], counts)], counts
