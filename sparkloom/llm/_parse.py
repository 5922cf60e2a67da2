"""Prefix-free parsing of texts into phrases by rolling-hash triggers.

Every window of ``window`` bytes has one trigger: among the ``gram``-byte rolling hashes inside it
the leftmost smallest.  Consecutive windows with the same trigger form a phrase, the bytes that
these windows cover.  Neighbouring phrases overlap by ``window - 1`` bytes, so each window lies in
exactly one phrase, the text follows from its phrases, and no phrase is a proper prefix of another
parse's phrase that begins with the same windows.  The parse depends on content alone: equal
windows have equal triggers at equal places, wherever they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sparkloom.llm._blocks import U64, mix, mix_int

_M = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2 ** 64
_MINV = pow(_M, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        out = np.empty(size, U64)
        out[0] = 1
        done = 1
        while done < size:
            take = min(done, size - done)
            out[done : done + take] = out[:take] * U64(pow(base, done, 1 << 64))
            done += take
        _powers[key] = have = out
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte codes times powers; ``span_hash`` takes differences of them."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _power(_M, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of spans, by content (of at most a few hundred bytes) and seed."""
    h = prefix[end] - prefix[start]
    h *= _power(_MINV, len(prefix))[start]
    h += U64(mix_int(seed))
    return mix(h)


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w consecutive values, by block prefixes and suffixes."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate((x, np.repeat(x[-1:], pad))).reshape(-1, w)
    pre = f.accumulate(y, axis=1).ravel()
    suf = f.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(suf[:n], pre[w - 1 : w - 1 + n])


@dataclass
class Phrases:
    """Phrases of a block: windows begin at lo..hi (inclusive); the trigger stands at ``at``."""

    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    row: np.ndarray
    trigger: np.ndarray
    content: np.ndarray


def parse(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[Phrases, np.ndarray]:
    """Phrases of all rows, and the prefix hashes."""
    prefix = prefix_hash(data)
    size = len(data)
    none = np.zeros(0, np.int64)
    if size < window:
        return Phrases(none, none, none, none, none.view(U64), none.view(U64)), prefix
    inv = _power(_MINV, size + 1)
    h = prefix[gram:] - prefix[:-gram]
    h *= inv[: len(h)]
    h = mix(h) | U64(1)
    w = window - gram + 1
    low = _sliding(h, w, np.minimum)[: size - window + 1]
    count = np.maximum(np.diff(offsets) - window + 1, 0)
    valid = np.zeros(size - window + 2, np.int8)
    has = count > 0
    np.add.at(valid, offsets[:-1][has], 1)
    np.add.at(valid, (offsets[:-1] + count)[has], -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    # A phrase ends where the smallest hash changes, where the trigger leaves, or where a row ends.
    # Equal neighbours in value may still have another trigger: the leftmost has just left.
    change = np.empty(len(low), bool)
    change[0] = True
    np.not_equal(low[1:], low[:-1], out=change[1:])
    change[1:] |= h[: len(low) - 1] == low[:-1]
    change[offsets[:-1][has]] = True
    change &= valid
    lo = np.flatnonzero(change)
    ends = np.flatnonzero(valid & ~np.append(valid[1:], False))
    follow = np.append(lo[1:] - 1, size)
    hi = np.minimum(follow, ends[np.searchsorted(ends, lo)])
    key = low[lo]
    # The trigger is the first place with that hash at or after lo: if the phrase's last window is
    # hi, that place is at most lo + w - 1. Phrases are short, so step all of them together.
    at = lo.copy()
    left = np.arange(len(lo))
    while len(left):
        left = left[h[at[left]] != key[left]]
        at[left] += 1
    row = np.searchsorted(offsets, lo, "right") - 1
    content = span_hash(prefix, lo, hi + window, 11)
    content = mix(content + (at - lo).astype(U64) * U64(_M) + (hi - lo).astype(U64))
    # The smallest of many hashes is a small number: it is mixed anew to spread over all key ranges.
    return Phrases(lo, hi, at, row, mix(key + U64(_M)), content), prefix
