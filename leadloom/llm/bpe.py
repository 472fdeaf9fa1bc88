"""Byte-pair merges on padded numpy matrices, shared by the tokenizer operators.

Symbol sequences are bucketed by length into padded matrices.  In each round every row merges its leftmost pair of
minimum rank; pairs are looked up in an open-addressing hash table held in arrays, all rows at once, and rows without a
mergeable pair leave the matrix (compaction).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

NONE = np.int32(np.iinfo(np.int32).max)
#: Fills rows up to the width of their bucket; never merges.
PAD = -2
#: Widths of the buckets.
WIDTHS = np.array([2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128])
#: Longer sequences are merged one by one with a heap, so that their cost grows as n log n.
LONG = int(WIDTHS[-1])


class PairTable:
    """(left id, right id) -> (rank, merged id).  Negative ids never merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        size = 1 << max(4, int(len(keys) * 3).bit_length())
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.full(size, -1, np.int32)
        self.probes = 0
        todo, slot = np.arange(len(keys)), self._hash(keys)
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            put = todo[first]
            self.keys[slot[first]], self.rank[slot[first]], self.merged[slot[first]] = keys[put], rank[put], merged[put]
            left_over = np.ones(len(todo), bool)
            left_over[first] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(30)).astype(np.int64) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; a slot of -1 (the last, empty by construction) means no such pair."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._hash(keys)
        out = np.full(keys.shape, -1, np.int64)
        at = self.keys[slot]
        real = (left >= 0) & (right >= 0)
        hit = (at == keys) & real
        out[hit] = slot[hit]
        todo = np.flatnonzero(((at != keys) & (at != -1) & real).ravel())
        flat_keys, flat_slot, flat_out = keys.ravel(), slot.ravel(), out.ravel()
        step = 1
        while len(todo):
            s = (flat_slot[todo] + step) & self.mask
            at = self.keys[s]
            hit = at == flat_keys[todo]
            flat_out[todo[hit]] = s[hit]
            todo = todo[~hit & (at != -1)]
            step += 1
        return flat_out.reshape(keys.shape)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.find(left, right)
        found = slot >= 0
        return np.where(found, self.rank[slot], NONE), np.where(found, self.merged[slot], -1)


def _merge_matrix(ids: np.ndarray, table: PairTable, out: list, rows: np.ndarray) -> None:
    """Merge all rows of a padded matrix; out[row] gets the ids that remain."""
    rank, merged = table.ranks(ids[:, :-1], ids[:, 1:])
    while len(rows):
        width = ids.shape[1]
        if width > 1:
            at = rank.argmin(1)
            live = rank[np.arange(len(rows)), at] != NONE
        else:
            live = np.zeros(len(rows), bool)
        for row, left in zip(rows[~live].tolist(), ids[~live]):
            out[row] = left[left != PAD]
        if not live.any():
            return
        if not live.all():
            ids, rank, merged, rows, at = ids[live], rank[live], merged[live], rows[live], at[live]
        n = np.arange(len(rows))
        keep = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > at[:, None])
        new = merged[n, at]
        ids = np.take_along_axis(ids, keep, 1)
        ids[n, at] = new
        if width == 2:
            rank, merged = np.empty((len(rows), 0), np.int32), np.empty((len(rows), 0), np.int32)
            continue
        # a pair starts at each kept symbol but the last; pairs that touch the new symbol are looked up again
        keep = np.arange(width - 2)[None, :] + (np.arange(width - 2)[None, :] >= at[:, None])
        rank, merged = np.take_along_axis(rank, keep, 1), np.take_along_axis(merged, keep, 1)
        for first in (at - 1, at):
            ok = (first >= 0) & (first < width - 2)
            i, j = n[ok], first[ok]
            rank[i, j], merged[i, j] = table.ranks(ids[i, j], ids[i, j + 1])


def _merge_long(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """The same merges for one long sequence, by a linked list and a heap of (rank, position)."""
    sym = ids.tolist()
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    cache: dict[tuple[int, int], tuple[int, int]] = {}
    rank, merged = table.ranks(ids[:-1], ids[1:])
    heap = [(r, i, sym[i], sym[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), merged.tolist())) if r != NONE]
    heapq.heapify(heap)

    def push(i: int, j: int) -> None:
        pair = (sym[i], sym[j])
        if pair not in cache:
            r, m = table.ranks(np.array(pair[:1]), np.array(pair[1:]))
            cache[pair] = int(r[0]), int(m[0])
        r, m = cache[pair]
        if r != NONE:
            heapq.heappush(heap, (r, i, *pair, m))

    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = m, -2
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            push(i, after[i])
        if before[i] >= 0:
            push(before[i], i)
    return np.array([s for s in sym if s != -2], np.int32)


def merge_all(flat: np.ndarray, sizes: Sequence[int], table: PairTable, cells: int = 400_000) -> list[np.ndarray]:
    """Merge many symbol sequences, given one after another in `flat`; -1 stands for a symbol without merges."""
    sizes = np.asarray(sizes, np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    out: list = [None] * len(sizes)
    for row in np.flatnonzero((sizes <= 1) | (sizes > LONG)).tolist():
        part = flat[start[row] : start[row + 1]]
        out[row] = _merge_long(part, table) if len(part) > 1 else part
    middle = np.flatnonzero((sizes > 1) & (sizes <= LONG))
    bucket = np.searchsorted(WIDTHS, sizes[middle])
    for b in np.unique(bucket):
        width, rows = int(WIDTHS[b]), middle[bucket == b]
        for at in range(0, len(rows), max(1, cells // width)):
            some = rows[at : at + max(1, cells // width)]
            place = start[some][:, None] + np.arange(width)
            ids = np.where(np.arange(width) < sizes[some][:, None], flat[np.minimum(place, len(flat) - 1)], PAD)
            _merge_matrix(ids.astype(np.int32), table, out, some)
    return out
