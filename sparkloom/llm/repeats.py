"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

Every text is parsed into phrases by rolling-hash triggers (``_parse``); each window of ``length``
bytes lies in one phrase, and equal windows lie in phrases with the same trigger.  The distinct phrases
are the dictionary, their sequence in a text is the parse.

1. Each chunk of texts asks about its distinct phrases.  One that an earlier text has is a repeat as a
   whole; one whose trigger no other phrase shares has no repeated window.
2. The bytes of the remaining phrases go to the key range of their trigger, the range's dictionary.
   There its suffix array is built, all suffixes of ``length`` bytes and more in order of their bytes
   (``suffix_order``): neighbours with a common prefix of ``length`` bytes are equal windows.  Since a
   phrase holds each of its windows whole, what follows a phrase in the parse can't change this order
   within ``length`` bytes; the parse only ranks equal suffixes, by where their phrases stand in the
   corpus, and the first of them stays.
3. The covered bytes are the union of the repeated windows, chunk by chunk.

Phrases are combined in every chunk first, so neither thousands of copies nor a passage in a third of
all texts makes a large group.  A trigger in varying surroundings has many different phrases: from
``CROWDED`` of them in one chunk, or ``MOST`` in all, they aren't sent to one place; their windows
are told apart by hashes instead, which spread over all key ranges.  Phrases are compared by trigger and
content hash (128 bits), windows in the suffix array by their bytes, others by a window and a trigger
hash (96 bits).

Ids are integers.  "Earlier" means a smaller id, or the same text and an earlier start.  Defined
results: null and empty texts have no bytes; null ids come last; rows with the same id, null ones too,
come in the order in which they are read; texts of any length are treated whole; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import _blocks as B
from sparkloom.llm import _exchange as X
from sparkloom.llm import _parse as P

LENGTH = 100
GRAM = 40
CROWDED = 64
MOST = 4096
_BLOCK = 1 << 19
_LAST = np.iinfo(np.int64).max
NOTHING, REPEAT, SHARED, HASHED = 0, 1, 2, 3
_MARK = B.U64(0xA5A5A5A5A5A5A5A5)


@dataclass
class _Chunk:
    """A chunk's texts in order, and its phrases."""

    table: pa.Table
    data: np.ndarray
    offsets: np.ndarray
    order: np.ndarray  # id of each row, nulls last
    lo: np.ndarray
    hi: np.ndarray
    row: np.ndarray
    trigger: np.ndarray
    content: np.ndarray


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    ids = pc.fill_null(table["id"].combine_chunks(), _LAST).to_numpy(zero_copy_only=False)
    at = np.argsort(ids, kind="stable")
    table, ids = table.take(at), ids[at]
    data, offsets = B.string_buffers(table["text"])
    return table, data[offsets[0] : offsets[-1]], offsets - offsets[0], ids


def _parsed(table: pa.Table, length: int, gram: int) -> _Chunk:
    table, data, offsets, ids = _sorted(table)
    parts = []
    for block in B.blocks(pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))), _BLOCK):
        p, _ = P.parse(block.data, block.offsets, length, gram)
        base = offsets[block.lo]
        parts.append((p.lo + base, p.hi + base, p.row + block.lo, p.trigger, p.content))
    if parts:
        lo, hi, row, trigger, content = (np.concatenate(x) for x in zip(*parts))
    else:
        lo = hi = row = np.zeros(0, np.int64)
        trigger = content = np.zeros(0, B.U64)
    return _Chunk(table, data, offsets, ids, lo, hi, row, trigger, content)


@dataclass
class _Dictionary:
    """Distinct phrases of a chunk by trigger: where each first stands, and of which entry each is."""

    first: np.ndarray  # phrase index
    entry: np.ndarray  # entry of every phrase
    crowded: np.ndarray  # per entry
    ask: np.ndarray  # entries that are asked about, in order; then the marks
    keys: np.ndarray  # triggers of ask and marks together, sorted
    contents: np.ndarray
    ids: np.ndarray
    slot: np.ndarray  # place of each asked entry in the question


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """First index of every run of equal values."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def _dictionary(c: _Chunk) -> _Dictionary:
    at = np.argsort(c.content, kind="stable")
    new = _groups(c.content[at])
    first = at[new]
    size = np.diff(np.append(new, len(at)))
    entry = np.empty(len(at), np.int64)
    entry[at] = np.repeat(np.arange(len(new)), size)
    trigger = c.trigger[first]
    by = np.argsort(trigger, kind="stable")
    run = _groups(trigger[by])
    run_size = np.diff(np.append(run, len(by)))
    crowded = np.zeros(len(first), bool)
    crowded[by] = np.repeat(run_size > CROWDED, run_size)
    marks = trigger[by[run[run_size > CROWDED]]]
    ask = np.flatnonzero(~crowded)
    keys = np.concatenate((trigger[ask], marks))
    contents = np.concatenate((c.content[first[ask]], B.mix(marks ^ _MARK)))
    ids = np.concatenate((c.order[c.row[first[ask]]], np.full(len(marks), _LAST)))
    order = np.argsort(keys, kind="stable")
    slot = np.empty(len(order), np.int64)
    slot[order] = np.arange(len(order))
    return _Dictionary(first, entry, crowded, ask, keys[order], contents[order], ids[order], slot[: len(ask)])


def _narrow(ids: np.ndarray) -> list[np.ndarray]:
    """Ids as (base, offsets) in as few bytes as they need."""
    base = int(ids.min()) if len(ids) else 0
    span = (int(ids.max()) - base) if len(ids) else 0
    if span < 1 << 32:
        return [np.array([base], np.int64), (ids - base).astype(np.uint32)]
    return [np.array([0], np.int64), ids]


def _wide(base: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return offsets.astype(np.int64) + base[0]


def _least(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the narrowest unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _ask_phrases(n: int, length: int, gram: int):
    def run(chunk: X.Chunk, table: pa.Table) -> X.Rows:
        d = _dictionary(_parsed(table, length, gram))
        cut = X.slices(d.keys, n)
        rows = []
        for k in range(n):
            own = slice(cut[k], cut[k + 1])
            rows.append((k, chunk.to, 0, X.pack(np.array([chunk.number]), *X.thin(d.keys[own]), d.contents[own], *_narrow(d.ids[own]))))
        return rows

    return run


def _later(new: np.ndarray, ids: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Which entries of the groups that begin at ``new`` another one precedes, by id, then chunk."""
    size = np.diff(np.append(new, len(ids)))
    least = np.repeat(np.minimum.reduceat(ids, new), size)
    tied = ids == least
    first = np.repeat(np.minimum.reduceat(np.where(tied, chunk, np.iinfo(np.int64).max), new), size)
    return ~tied | (chunk != first)


def _judge_phrases(asked: list[list[np.ndarray]]) -> list[tuple]:
    """REPEAT: an earlier text has the phrase.  SHARED: another phrase has its trigger.  HASHED: too
    many have it."""
    triggers = [X.thick(*a[1:4]) for a in asked]
    trigger = np.concatenate(triggers)
    content = np.concatenate([a[4] for a in asked])
    ids = np.concatenate([_wide(a[5], a[6]) for a in asked])
    chunk = np.repeat([int(a[0][0]) for a in asked], [len(t) for t in triggers])
    at = np.lexsort((trigger, content)) if len(trigger) else np.zeros(0, np.int64)
    t, c = trigger[at], content[at]
    new = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])))) if len(at) else at
    size = np.diff(np.append(new, len(at)))
    code = np.zeros(len(at), np.uint8)
    if len(at):
        heads = t[new]
        by = np.argsort(heads, kind="stable")
        run = _groups(heads[by])
        run_size = np.diff(np.append(run, len(by)))
        marked = np.logical_or.reduceat((c[new] == B.mix(heads ^ _MARK))[by], run)
        kind = np.where(marked | (run_size > MOST), HASHED, np.where(run_size > 1, SHARED, NOTHING))
        kinds = np.empty(len(heads), np.uint8)
        kinds[by] = np.repeat(kind, run_size)
        code[at] = np.where(_later(new, ids[at], chunk[at]), REPEAT, np.repeat(kinds, size))
    ends = np.cumsum([len(x) for x in triggers])
    return [(x,) for x in np.split(code, ends[:-1])]


def suffix_order(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffixes that begin at the given places in order of their first ``length``
    bytes, and a number of each in that order, equal for equal ones.

    Suffixes are sorted by eight bytes at a time; those that differ from both neighbours are done.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    load = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    n = len(start)
    order, fresh = np.arange(n), np.zeros(n, bool)  # fresh: the suffix at this rank differs from the one before
    if n:
        fresh[0] = True
    rank, group = np.arange(n), np.zeros(n, np.int64)  # ranks still tied, and the tie that each belongs to
    for depth in range(0, length, 8):
        word = load[start[order[rank]] + depth].astype(B.U64)
        if depth + 8 > length:
            word >>= B.U64(8 * (depth + 8 - length))
        by = np.lexsort((word, group))
        order[rank] = order[rank][by]
        word = word[by]
        differs = np.ones(len(rank) + 1, bool)
        differs[1:-1] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        fresh[rank] |= differs[:-1]
        keep = ~(differs[:-1] & differs[1:])
        rank, group = rank[keep], np.cumsum(differs[:-1])[keep]
        if len(rank) == 0:
            break
    return order, np.cumsum(fresh)


@dataclass
class _Windows:
    """Windows of phrases: hash, check, text row and place, and which are first of their kind."""

    first: np.ndarray  # index of the distinct ones, by hash
    hash: np.ndarray
    check: np.ndarray
    place: np.ndarray
    again: np.ndarray  # places of windows that an earlier one of the chunk equals


def _windows(c_data: np.ndarray, lo: np.ndarray, hi: np.ndarray, check: np.ndarray, length: int) -> _Windows:
    size = hi - lo + length
    place_parts, hash_parts = [], []
    for a in range(0, len(lo), 4096):
        own = slice(a, a + 4096)
        raw = c_data[B.ranges(lo[own], size[own])]
        prefix = P.prefix_hash(raw)
        count = hi[own] - lo[own] + 1
        local = B.ranges(np.cumsum(size[own]) - size[own], count)
        hash_parts.append(P.span_hash(prefix, local, local + length, 23))
        place_parts.append(B.ranges(lo[own], count))
    h = np.concatenate(hash_parts) if hash_parts else np.zeros(0, B.U64)
    place = np.concatenate(place_parts) if place_parts else np.zeros(0, np.int64)
    check = np.repeat(check, hi - lo + 1)
    at = np.argsort(h, kind="stable")
    hs, cs = h[at], check[at]
    is_new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1]))) if len(at) else np.zeros(0, bool)
    first = at[is_new]
    return _Windows(first, h[first], check[first], place[first], place[at[~is_new]])


def _ask_windows(n: int, length: int, gram: int):
    """Phrases of SHARED triggers by trigger: (windows of each, id, place in the chunk, bytes); windows of
    HASHED ones by their hashes."""

    def run(chunk: X.Chunk, table: pa.Table, answers: pa.Table) -> X.Rows:
        c = _parsed(table, length, gram)
        d = _dictionary(c)
        codes = np.concatenate([a[0] for a in X.collect(answers)]) if answers.num_rows else np.zeros(0, np.uint8)
        code = np.full(len(d.first), HASHED, np.uint8)
        code[d.ask] = codes[d.slot]
        # All places of a phrase but its first in the chunk repeat; so does the first of a REPEAT.
        is_first = np.zeros(len(c.lo), bool)
        is_first[d.first] = True
        repeat = ~is_first | (code[d.entry] == REPEAT)
        start, end = B.cover(c.lo[repeat], c.hi[repeat] + length)
        shared = d.first[code == SHARED]
        shared = shared[np.lexsort((c.lo[shared], c.trigger[shared]))]
        lo, more = c.lo[shared], c.hi[shared] - c.lo[shared]
        flagged = np.sort(d.first[code == HASHED])
        check = (c.trigger[flagged] & B.U64(0xFFFFFFFF)).astype(np.uint32)
        w = _windows(c.data, c.lo[flagged], c.hi[flagged], check, length)
        ids = c.order[np.searchsorted(c.offsets, w.place, "right") - 1]
        cut, cut_w = X.slices(c.trigger[shared], n), X.slices(w.hash, n)
        rows = []
        for k in range(n):
            own, own_w = slice(cut[k], cut[k + 1]), slice(cut_w[k], cut_w[k + 1])
            raw = c.data[B.ranges(lo[own], more[own] + length)]
            phrases = [_least(more[own]), *_narrow(c.order[c.row[shared[own]]]), _least(lo[own]), raw]
            rows.append((k, chunk.to, 0, X.pack(np.array([chunk.number]), *phrases, *X.thin(w.hash[own_w]), w.check[own_w], *_narrow(ids[own_w]))))
        state = X.pack(_least(start), _least(end), _least(lo), _least(more), cut, _least(c.lo[flagged]), _least(c.hi[flagged] - c.lo[flagged]), check)
        return [*rows, (chunk.number % n, chunk.to, 1, state)]

    return run


def _judge_suffixes(asked: list[list[np.ndarray]], length: int) -> list[np.ndarray]:
    """For the windows of each message's phrases, whether an equal one precedes."""
    count = [a[1].astype(np.int64) + 1 for a in asked]
    data = np.concatenate([a[5] for a in asked])
    windows = np.concatenate(count)
    size = windows + length - 1
    start = B.ranges(np.cumsum(size) - size, windows)
    order, group = suffix_order(data, start, length)
    # Only suffixes with an equal neighbour are looked at.
    same = np.zeros(len(group) + 1, bool)
    same[1:-1] = group[1:] == group[:-1]
    tied = same[:-1] | same[1:]
    order, group = order[tied], group[tied]
    phrase = np.repeat(np.arange(len(windows)), windows)[order]
    ids = np.concatenate([_wide(a[2], a[3]) for a in asked])[phrase]
    chunk = np.repeat([int(a[0][0]) for a in asked], [len(x) for x in count])[phrase]
    place = np.concatenate([a[4].astype(np.int64) for a in asked])[phrase] + order - (np.cumsum(windows) - windows)[phrase]
    by = np.lexsort((place, chunk, ids, group))
    later = np.zeros(len(start), bool)
    later[order[by[1:]]] = group[by[1:]] == group[by[:-1]]
    return np.split(later, np.cumsum([int(x.sum()) for x in count])[:-1])


def _judge_hashes(asked: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For each message's windows, whether an earlier text has them."""
    hashes = [X.thick(*a[6:9]) for a in asked]
    h = np.concatenate(hashes)
    check = np.concatenate([a[9] for a in asked])
    ids = np.concatenate([_wide(a[10], a[11]) for a in asked])
    chunk = np.repeat([int(a[0][0]) for a in asked], [len(x) for x in hashes])
    at = np.argsort(h, kind="stable")
    hs, cs = h[at], check[at]
    later = np.zeros(len(at), bool)
    if len(at):
        same = hs[1:] == hs[:-1]
        if (same & (cs[1:] != cs[:-1])).any():
            at = np.lexsort((check, h))
            hs, cs = h[at], check[at]
        new = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1]))))
        later[at] = _later(new, ids[at], chunk[at])
    return np.split(later, np.cumsum([len(x) for x in hashes])[:-1])


def _judge_windows(length: int):
    def run(asked: list[list[np.ndarray]]) -> list[tuple]:
        return [(np.packbits(a), np.packbits(b)) for a, b in zip(_judge_suffixes(asked, length), _judge_hashes(asked))]

    return run


def _remove(n: int, length: int, id_col: str, id_type: pa.DataType):
    def run(chunk: X.Chunk, table: pa.Table, answers: pa.Table) -> pa.Table:
        table, data, offsets, _ = _sorted(table)
        start = end = np.zeros(0, np.int64)
        if answers.num_rows:
            start, end, lo, more, cut, hashed, further, check = X.collect(answers, 1)[0]
            start, end, lo, more, hashed, further = (x.astype(np.int64) for x in (start, end, lo, more, hashed, further))
            got = X.collect(answers)
            bits = [np.unpackbits(a[0], count=int((more[x:y] + 1).sum())) for a, x, y in zip(got, cut, cut[1:])]
            w = _windows(data, hashed, hashed + further, check, length)
            cut_w = X.slices(w.hash, n)
            bits_w = [np.unpackbits(a[1], count=int(y - x)) for a, x, y in zip(got, cut_w, cut_w[1:])]
            place = np.concatenate((B.ranges(lo, more + 1)[np.concatenate(bits) == 1], w.place[np.concatenate(bits_w) == 1], w.again))
            place.sort()
            start, end = B.cover(np.concatenate((start, place)), np.concatenate((end, place + length)))
        row = np.searchsorted(offsets, start, "right") - 1
        # Windows never cross texts, but those of neighbours may touch: cut the union at text ends.
        parts_s, parts_e, parts_r = [], [], []
        while len(start):
            stop = np.minimum(end, offsets[row + 1])
            parts_s.append(start), parts_e.append(stop), parts_r.append(row)
            more = end > stop
            start, end, row = stop[more], end[more], row[more]
            row = np.searchsorted(offsets, start, "right") - 1
        rows = len(offsets) - 1
        none = np.zeros(0, np.int64)
        s, e, r = (np.concatenate(x) if x else none for x in (parts_s, parts_e, parts_r))
        order = np.argsort(s)
        s, e, r = s[order], e[order], r[order]
        first = np.searchsorted(r, np.arange(rows + 1))
        removed = np.bincount(r, weights=(e - s), minlength=rows).astype(np.int64)
        digest = []
        raw = memoryview(np.ascontiguousarray(data))
        for i in range(rows):
            sha, last = hashlib.sha256(), int(offsets[i])
            for k in range(first[i], first[i + 1]):
                sha.update(raw[last : s[k]])
                last = int(e[k])
            sha.update(raw[last : offsets[i + 1]])
            digest.append(sha.hexdigest())
        columns = [table["id"].combine_chunks().cast(id_type), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(first)), pa.array(digest, pa.string())]
        return pa.table(columns, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: bytes, bytes removed, removed runs, digest of the bytes that are left."""
    if not 1 <= gram <= length:
        raise ValueError("gram must lie between 1 and length")
    n = X.parts(docs)
    chunks = X.chunked(docs, n, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("string"))
    phrases = X.answer(X.ask(chunks, n, _ask_phrases(n, length, gram)), n, _judge_phrases)
    asked = X.ask_again(chunks, phrases, n, _ask_windows(n, length, gram))
    windows = X.answer(asked, n, _judge_windows(length))
    schema = T.StructType([T.StructField(id_col, T.LongType()), *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields])
    return X.finish(chunks, windows, _remove(n, length, id_col, pa.int64()), schema)
