"""Canonical byte-pair merging: the pair of lowest rank first, the leftmost among equals.

``merge_all`` steps through many short chunks together with numpy; a chunk of more than
``LONG`` symbols goes through a heap.  ``merge_loop`` is the definition, for tests.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

LONG = 256
_NONE = np.int64(1) << 62


@dataclass
class PairTable:
    """Merges (left, right) -> target by rank; of a pair given twice the first counts."""

    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    target: np.ndarray
    _slots: np.ndarray | None = field(default=None, repr=False, compare=False)
    _dict: dict | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"left": self.left, "right": self.right, "rank": self.rank, "target": self.target, "_slots": None, "_dict": None}

    @staticmethod
    def _hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        return key ^ (key >> np.uint64(32))

    def _build(self) -> None:
        bits = max(8, int(4 * len(self.left)).bit_length())
        slots = np.full(1 << bits, -1, np.int32)
        mask = np.uint64((1 << bits) - 1)
        waiting = np.arange(len(self.left))
        key = self.left.astype(np.int64) << 32 | self.right
        _, first = np.unique(key, return_index=True)
        waiting = np.sort(first)
        place = self._hash(self.left[waiting], self.right[waiting]) & mask
        while len(waiting):
            free = slots[place.astype(np.int64)] < 0
            at, who = place[free].astype(np.int64), waiting[free]
            slots[at[::-1]] = who[::-1]
            lost = slots[place.astype(np.int64)] != waiting
            waiting, place = waiting[lost], (place[lost] + np.uint64(1)) & mask
        self._slots = slots

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 for none; negative symbols have none."""
        if self._slots is None:
            self._build()
        mask = np.uint64(len(self._slots) - 1)
        out = np.full(len(left), -1)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        place = self._hash(left[at], right[at]) & mask
        while len(at):
            got = self._slots[place.astype(np.int64)]
            hit = got >= 0
            at, place, got = at[hit], place[hit], got[hit]
            same = (self.left[got] == left[at]) & (self.right[got] == right[at])
            out[at[same]] = got[same]
            at, place = at[~same], (place[~same] + np.uint64(1)) & mask
        return out

    def lookup(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) -> (rank, target)."""
        if self._dict is None:
            rows = zip(self.left.tolist(), self.right.tolist(), self.rank.tolist(), self.target.tolist())
            self._dict = {}
            for a, b, r, t in rows:
                self._dict.setdefault((a, b), (r, t))
        return self._dict


def merge_loop(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges one chunk by looking for the best pair again and again."""
    symbols = list(symbols)
    while True:
        best = min(((pairs[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs), default=None)
        if best is None:
            return symbols
        i = best[1]
        symbols[i : i + 2] = [pairs[symbols[i], symbols[i + 1]][1]]


def merge_heap(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges one chunk with a heap of pairs and a linked list of symbols."""
    sym, n = list(symbols), len(symbols)
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(sym, sym[1:])) if p in pairs]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i] = pairs[a, b][1]
        gone[j] = True
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0 and y < n and (sym[x], sym[y]) in pairs:
                heapq.heappush(heap, (pairs[sym[x], sym[y]][0], x, sym[x], sym[y]))
    return [s for s, g in zip(sym, gone) if not g]


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def merge_all(symbols: np.ndarray, first: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges many chunks: chunk i is symbols[first[i]:first[i + 1]]; the result has the same shape.

    Negative symbols never merge.
    """
    n = len(first) - 1
    size = np.diff(first)
    counts = np.zeros(n, np.int64)
    owners: list[np.ndarray] = []
    values: list[np.ndarray] = []

    def keep(chunk: np.ndarray, value: np.ndarray) -> None:
        owners.append(chunk)
        values.append(value)

    for c in np.flatnonzero(size > LONG).tolist():
        got = np.array(merge_heap(symbols[first[c] : first[c + 1]].tolist(), table.lookup()), np.int64)
        counts[c] = len(got)
        keep(np.full(len(got), c), got)
    chunks = np.flatnonzero((size > 0) & (size <= LONG))
    size = size[chunks]
    sym = symbols[_spread(first[:-1][chunks], size)].astype(np.int64) if len(chunks) else np.zeros(0, np.int64)
    start = np.cumsum(size) - size
    pair = np.full(len(sym), -1)
    if len(sym):
        pair[:-1] = table.find(sym[:-1], sym[1:])
        pair[start + size - 1] = -1
    rank = table.rank.astype(np.int64) if len(table.rank) else np.zeros(1, np.int64)
    while len(chunks):
        value = np.where(pair >= 0, (rank[pair] << 32) | np.arange(len(sym)), _NONE)
        best = np.minimum.reduceat(value, start)
        live = best < _NONE
        if not live.all():
            done = ~live
            counts[chunks[done]] = size[done]
            keep(np.repeat(chunks[done], size[done]), sym[_spread(start[done], size[done])])
            stay = _spread(start[live], size[live])
            moved = np.cumsum(size[live]) - size[live]
            best = best[live] - start[live] + moved
            sym, pair, chunks, size, start = sym[stay], pair[stay], chunks[live], size[live], moved
            if len(chunks) == 0:
                break
        at = best & 0xFFFFFFFF
        sym[at] = table.target[pair[at]]
        left = np.ones(len(sym), bool)
        left[at + 1] = False
        sym, pair = sym[left], pair[left]
        at = at - np.arange(len(at))  # every chunk before has lost one symbol
        size = size - 1
        start = np.cumsum(size) - size
        inner = at < start + size - 1
        pair[at] = -1
        pair[at[inner]] = table.find(sym[at[inner]], sym[at[inner] + 1])
        led = at[at > start]
        pair[led - 1] = table.find(sym[led - 1], sym[led])
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return flat[np.argsort(owner, kind="stable")], np.concatenate(([0], np.cumsum(counts)))
