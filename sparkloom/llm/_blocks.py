"""Vectorised work on whole Arrow string columns.

Spark hands Arrow record batches to Python as one contiguous UTF-8 buffer plus row offsets.  The
operators cut such a buffer into blocks of about a megabyte (always at row boundaries, a longer row
is a block of its own) and find words, lines, n-grams and hashes with numpy over the whole block, so
that a short text costs no Python call and temporary arrays stay inside the CPU cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_LONG_WORD = 2048

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` (after lower-casing): digits, a-z and all non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of ``[^\x20\x09-\x0D]``.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: UTF-8 bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a fresh uint64 array."""
    x ^= x >> U64(30)
    x *= _C2
    x ^= x >> U64(27)
    x *= _C3
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    """``mix`` of one Python integer."""
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


@dataclass
class Block:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and n + 1 offsets into them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a string column in blocks of about ``size`` bytes."""
    raw, offsets = string_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 65536)
        at = offsets[lo : hi + 1]
        yield Block(lo, hi, raw[at[0] : at[-1]], at - at[0])
        lo = hi


@dataclass
class Words:
    """Words of a block: start and end byte of each, and the first word of each row (n + 1)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def runs(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of true bytes that stay within one row."""
    size = len(inside)
    if size == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < size]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    ends[edge] = inside[edge]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def words(block: Block, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, Words]:
    """The block's bytes (lower-cased if asked) and its words by a byte table."""
    data = LOWER[block.data] if lower else block.data
    return data, runs(table[data], block.offsets)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes in every process."""
    length = (end - start).astype(np.int64)
    buffer = np.zeros(len(data) + 8, np.uint8)
    buffer[: len(data)] = data
    load = np.ndarray((len(data) + 1,), "<u8", buffer, strides=(1,))
    h = load[start] & _MASK[np.minimum(length, 8)]
    h += length.astype(U64) * _C1 + U64(mix_int(seed + 1))
    mix(h)
    at, done = np.flatnonzero(length > 8), 8
    long = at[length[at] > _LONG_WORD]
    at = at[length[at] <= _LONG_WORD]
    while len(at):
        part = load[start[at] + done] & _MASK[np.minimum(length[at] - done, 8)]
        h[at] = mix(h[at] * _C1 + part)
        done += 8
        at = at[length[at] > done]
    for i in long.tolist():
        key = int(seed).to_bytes(8, "little", signed=True)
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return h


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries (``len(h) - n + 1`` of them)."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    out = mix(h[:size] + U64(mix_int(n)))
    for k in range(1, n):
        out = mix(out * _C1 + h[k : k + size])
    return out


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Indexes of words with which n consecutive words of one row begin."""
    counts = np.diff(first)
    per = np.maximum(counts - n + 1, 0)
    total = int(per.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    base = np.repeat(first[:-1] - (np.cumsum(per) - per), per)
    return base + np.arange(total)


def uniq(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorts; quicker than numpy's own for integers of 64 bits)."""
    if len(x) == 0:
        return x
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def uniq_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    if len(x) == 0:
        return x, np.zeros(0, np.int64)
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[at], np.diff(np.append(at, len(x)))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], zero for empty ranges."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start[i], start[i] + count[i])."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


def cover(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, as sorted maximal disjoint ones (touching ones join)."""
    if len(start) == 0:
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return start[new], end[np.append(new[1:], len(start)) - 1]


class HashTable:
    """Finds 64-bit keys (already well mixed) among distinct ones: layers of direct-mapped slots, each
    layer for the keys that found their slot taken in the layer before."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, U64(0))
        self.layers: list[tuple[np.ndarray, int]] = []
        left, shift = np.arange(len(keys)), 0
        while len(left):
            bits = max(int(4 * len(left)).bit_length(), 4)
            slot = self._slot(keys[left], shift, bits)
            table = np.full(1 << bits, len(keys), np.int32)
            table[slot[::-1]] = left[::-1]  # of several keys the first stays
            self.layers.append((table, bits))
            left = left[table[slot] != left]
            shift += 1

    @staticmethod
    def _slot(keys: np.ndarray, shift: int, bits: int) -> np.ndarray:
        if shift:
            keys = keys * U64((0x9E3779B97F4A7C15 * (2 * shift + 1)) & (2**64 - 1))
        return (keys >> U64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key, -1 for those that aren't there."""
        out = np.full(len(keys), -1)
        at = None
        for i, (table, bits) in enumerate(self.layers):
            own = keys if at is None else keys[at]
            place = table[self._slot(own, i, bits)]
            ok = self.keys[place] == own
            ok &= place < len(self.keys) - 1
            if at is None:
                out[ok] = place[ok]
                at = np.flatnonzero(~ok & (place < len(self.keys) - 1))
            else:
                out[at[ok]] = place[ok]
                at = at[~ok & (place < len(self.keys) - 1)]
            if len(at) == 0:
                break
        return out


class Growing:
    """An array that grows by doubling."""

    def __init__(self, dtype) -> None:
        self._room = np.zeros(1 << 12, dtype)
        self.n = 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self._room):
            room = np.zeros(max(need, 2 * len(self._room)), self._room.dtype)
            room[: self.n] = self._room[: self.n]
            self._room = room
        self._room[self.n : need] = values
        self.n = need

    @property
    def values(self) -> np.ndarray:
        return self._room[: self.n]


class KeyMap:
    """Numbers for 64-bit keys in order of arrival: two sorted tiers, merged as they grow."""

    def __init__(self) -> None:
        none = np.zeros(0, U64), np.zeros(0, np.int64)
        self.tiers = [none, none]
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of sorted keys, -1 for unknown ones."""
        out = np.full(len(keys), -1)
        for have, number in self.tiers:
            if len(have):
                place = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                ok = have[place] == keys
                out[ok] = number[place[ok]]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for new keys."""
        new = np.arange(self.n, self.n + len(keys))
        self.n += len(keys)
        big, small = self.tiers
        small = _merged(small, (keys, new))
        if len(small[0]) > max(1 << 15, len(big[0]) // 4):
            big, small = _merged(big, small), (small[0][:0], small[1][:0])
        self.tiers = [big, small]
        return new


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, numbers = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.argsort(keys, kind="stable")
    return keys[order], numbers[order]
