"""SentencePiece encoding and decoding with a given vocabulary.

Two segmentations are offered.  ``best`` is the one of largest total piece score, by dynamic
programming in the max-plus semiring.  Giant documents (``GIANT`` bytes and more) and giant words are
split into chunks of ``CHUNK`` characters wherever these end: each chunk yields a transfer matrix from the
states at its left boundary to those at its right one (a state is how far a piece reaches over the
boundary), the matrices are combined associatively by a parallel scan, and every chunk is traced back by
itself once the boundary states are known; chunks are worked on side by side.  ``ids`` is the library's
own result for models of the BPE kind (highest-scoring pair first), which no sum of scores can express.

No piece of the vocabulary may hold a space mark after another character (checked at load), so units
"blanks + following non-blanks" are independent, and for shorter documents each distinct unit is segmented
once: all new units of a block at the same time, with numpy.  Results are kept in a bounded cache per
process.  Both ways give the same segmentation.

Defined results: null and empty texts have no ids; a literal space mark U+2581 counts as a space;
characters that no piece covers become byte pieces; of segmentations with equal sums the one whose last
piece is longer counts, at every place; texts are encoded whole; repeated rows and rows with null or
repeated ids give one result each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import _blocks as B
from sparkloom.llm import _map

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NEVER = -1e30
CACHE_UNITS = 1 << 20
#: Bytes from which a document, and characters from which a unit, goes through the scan.
GIANT = 1 << 15
UNIT = 2048
#: Characters of a chunk of the scan, and chunks whose lattice is in memory at a time.
CHUNK = 256
GROUP = 512


@dataclass
class Vocabulary:
    """Pieces, their scores, and look-up tables."""

    pieces: list[str]
    score: np.ndarray
    byte_id: np.ndarray  # 256
    arena: np.ndarray  # bytes of all pieces, spaces for marks
    arena_first: np.ndarray
    char_id: dict[int, int]
    table: dict[str, int]
    longest: int
    unknown: float
    pair_table: B.HashTable = field(default=None)
    pair_key: np.ndarray = field(default=None)
    pair_id: np.ndarray = field(default=None)
    pair_rank: np.ndarray = field(default=None)
    prefix_table: B.HashTable = field(default=None)
    prefix_id: np.ndarray = field(default=None)
    char_table: np.ndarray = field(default=None)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a SentencePiece model file."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        size = p.get_piece_size()
        rows = [(p.id_to_piece(i), p.get_score(i), p.is_byte(i), p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in range(size)]
        return cls.build(rows)

    @classmethod
    def build(cls, rows: list[tuple[str, float, bool, bool]]) -> Vocabulary:
        """From (piece, score, is a byte, is no ordinary piece) by id."""
        byte_id = np.full(256, -1, np.int64)
        raw, table = [], {}
        for i, (piece, _, is_byte, special) in enumerate(rows):
            if is_byte:
                byte_id[int(piece[1:-1], 16)] = i
                raw.append(bytes([int(piece[1:-1], 16)]))
            elif special:
                raw.append(b"")
            else:
                raw.append(piece.replace(MARK, " ").encode())
                table.setdefault(piece, i)
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"a piece with a space mark after another character isn't supported: {piece!r}")
        if (byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so some texts couldn't be encoded")
        score = np.array([r[1] for r in rows], np.float64)
        chars = {ord(c): table[c] for piece in table for c in piece if c in table}
        missing = {c for piece in table for c in piece if c not in table}
        if missing:
            raise ValueError(f"characters of pieces that are no pieces: {sorted(missing)[:5]}")
        v = cls(
            [r[0] for r in rows], score, byte_id, np.frombuffer(b"".join(raw), np.uint8),
            np.concatenate(([0], np.cumsum([len(x) for x in raw]))), chars, table,
            max(len(x) for x in table), float(min(s for s in score[list(table.values())] if s > -1e8)) - 10,
        )
        keys, ids = [], []
        for piece, i in table.items():
            for k in range(1, len(piece)):
                left, right = table.get(piece[:k]), table.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left * size_key(len(rows)) + right)
                    ids.append(i)
        keys, ids = np.array(keys, np.int64), np.array(ids, np.int64)
        order = np.argsort(keys)
        v.pair_key, v.pair_id = keys[order], ids[order]
        # Rank: by falling score; pieces of equal score are equal, the leftmost pair goes first.
        distinct = np.unique(-score)
        v.pair_rank = np.searchsorted(distinct, -score[v.pair_id])
        v.char_table = np.full(0x110000, -1, np.int32)
        for c, i in chars.items():
            v.char_table[c] = i
        v.pair_table = B.HashTable(B.mix(v.pair_key.astype(B.U64)))
        # All prefixes of pieces, so that a look-up stops where no longer piece can follow.
        names = sorted({x[:k] for x in table for k in range(1, len(x) + 1)})
        codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        length = np.array([len(x) for x in names])
        end = np.cumsum(length)
        v.prefix_table = B.HashTable(_span_codes(codes, end - length, length))
        v.prefix_id = np.array([table.get(x, -1) for x in names])
        return v


def size_key(n: int) -> int:
    """Base of pair keys."""
    return 1 << int(n).bit_length()


def _span_codes(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of code points."""
    h = np.zeros(len(start), B.U64)
    at, k = np.arange(len(start)), 0
    while True:
        at = at[length[at] > k]
        if len(at) == 0:
            return h
        h[at] = B.mix(h[at] * B.U64(0x9E3779B97F4A7C15) + codes[start[at] + k].astype(B.U64) + B.U64(1))
        k += 1


def _pairs(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Index of each pair in the pair tables, -1 for none."""
    key = left * size_key(len(v.pieces)) + right
    place = v.pair_table.find(B.mix(key.astype(B.U64)))
    place[(left < 0) | (right < 0)] = -1
    return place


def bpe(v: Vocabulary, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, unit offsets): best pair first in every unit, all units a step at a time.

    A negative symbol -1 - c is a character c without a piece.
    """
    sym = v.char_table[codes].astype(np.int64)
    sym[sym < 0] = -1 - codes[sym < 0].astype(np.int64)
    n = len(first) - 1
    out_len = np.zeros(n, np.int64)
    out_parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = np.diff(first)
    long = np.flatnonzero(size > 256)
    for u in long.tolist():
        got = _bpe_heap(v, sym[first[u] : first[u + 1]].tolist())
        out_len[u] = len(got)
        out_parts.append((np.full(len(got), u), np.array(got, np.int64)))
    units = np.flatnonzero((size <= 256) & (size > 0))
    keep = B.ranges(first[:-1][units], size[units])
    sym, size = sym[keep], size[units]
    none = np.int64(1) << 62
    start = np.cumsum(size) - size
    left = sym.copy()
    pair = np.full(len(sym), -1)
    pair[:-1] = _pairs(v, sym[:-1], sym[1:])
    pair[start + size - 1] = -1
    while len(units):
        value = np.where(pair >= 0, (v.pair_rank[pair] << 32) | np.arange(len(sym)), none)
        best = np.minimum.reduceat(value, start)
        live = best < none
        if not live.all():
            done = np.flatnonzero(~live)
            out_len[units[done]] = size[done]
            out_parts.append((np.repeat(units[done], size[done]), sym[B.ranges(start[done], size[done])]))
            stay = B.ranges(start[live], size[live])
            moved = np.cumsum(size[live]) - size[live]
            best = best[live] - start[live] + moved  # the low half is the place
            sym, pair, units, size, start = sym[stay], pair[stay], units[live], size[live], moved
            if len(units) == 0:
                break
        at = best & 0xFFFFFFFF
        sym[at] = v.pair_id[pair[at]]
        gone = np.ones(len(sym), bool)
        gone[at + 1] = False
        sym, pair = sym[gone], pair[gone]
        at = at - np.arange(len(at))  # one symbol fewer for every unit before
        size = size - 1
        start = np.cumsum(size) - size
        last = start + size - 1
        follow = np.minimum(at + 1, len(sym) - 1)
        pair[at] = np.where(at < last, _pairs(v, sym[at], sym[follow]), -1)
        before = at > start
        pair[at[before] - 1] = _pairs(v, sym[at[before] - 1], sym[at[before]])
    owner = np.concatenate([p[0] for p in out_parts]) if out_parts else np.zeros(0, np.int64)
    symbols = np.concatenate([p[1] for p in out_parts]) if out_parts else np.zeros(0, np.int64)
    return symbols[np.argsort(owner, kind="stable")], np.concatenate(([0], np.cumsum(out_len)))


def _bpe_heap(v: Vocabulary, sym: list[int]) -> list[int]:
    """The same for one long unit, with a heap of pairs and a linked list of symbols."""
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    p = _pairs(v, np.array(sym[:-1], np.int64), np.array(sym[1:], np.int64)).tolist()
    rank, target, base = v.pair_rank.tolist(), v.pair_id.tolist(), size_key(len(v.pieces))
    keys = dict(zip(v.pair_key.tolist(), range(len(target))))
    heap = [(rank[k], i, sym[i], sym[i + 1], k) for i, k in enumerate(p) if k >= 0]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        _, i, a, b, k = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i] = target[k]
        gone[j] = True
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and sym[x] >= 0 and sym[y] >= 0:
                k = keys.get(sym[x] * base + sym[y], -1)
                if k >= 0:
                    heapq.heappush(heap, (rank[k], x, sym[x], sym[y], k))
    return [s for s, g in zip(sym, gone) if not g]


def _edges(v: Vocabulary, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece id and score of the piece of length l + 1 that begins at each place (rows: l).

    ``room``: characters from each place to the end of its unit.  Characters without a piece have an
    edge of length one with the unknown score and id -1 - c.
    """
    n = len(codes)
    ids = np.full((v.longest, n), -(1 << 40), np.int64)
    score = np.full((v.longest, n), NEVER)
    h = np.zeros(n, B.U64)
    at = np.arange(n)
    for l in range(v.longest):
        at = at[room[at] > l]
        if len(at) == 0:
            break
        h[at] = B.mix(h[at] * B.U64(0x9E3779B97F4A7C15) + codes[at + l].astype(B.U64) + B.U64(1))
        place = v.prefix_table.find(h[at])
        found = np.where(place >= 0, v.prefix_id[place], -1)
        ok = found >= 0
        ids[l, at[ok]] = found[ok]
        score[l, at[ok]] = v.score[found[ok]]
        if l == 0:
            bad = at[~ok]
            ids[0, bad] = -1 - codes[bad].astype(np.int64)
            score[0, bad] = v.unknown
        at = at[place >= 0]
    return ids, score


def best(v: Vocabulary, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, unit offsets, unit scores) of the segmentations with the largest sum of scores.

    Among equals the longer last piece wins, at every place.  Units of more than UNIT characters go
    through ``scan``; all others are stepped through together.
    """
    n = len(first) - 1
    size = np.diff(first)
    total = np.zeros(n)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for u in np.flatnonzero(size > UNIT).tolist():
        got, total[u] = scan(v, codes[first[u] : first[u + 1]])
        parts.append((np.full(len(got), u), got))
    units = np.flatnonzero((size <= UNIT) & (size > 0))
    if len(units):
        units = units[np.argsort(-size[units], kind="stable")]  # longest first: the live ones are a prefix
        size = size[units]
        keep = B.ranges(first[:-1][units], size)
        own = codes[keep]
        start = np.cumsum(size) - size
        room = np.repeat(start + size, size) - np.arange(len(own))
        ids, score = _edges(v, own, room)
        # value[start + units before + k]: best score of the first k characters.
        origin = start + np.arange(len(units))
        value = np.full(len(own) + len(units), NEVER)
        value[origin] = 0
        back = np.zeros(len(value), np.int64)
        for j in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -j, "right"))
            top, step = np.full(live, NEVER), np.ones(live, np.int64)
            for l in range(min(j, v.longest), 0, -1):
                x = value[origin[:live] + j - l] + score[l - 1, start[:live] + j - l]
                better = x > top
                top[better] = x[better]
                step[better] = l
            value[origin[:live] + j] = top
            back[origin[:live] + j] = step
        total[units] = value[origin + size]
        at, who = size.copy(), np.arange(len(units))
        owner, symbols, place = [], [], []
        while len(who):
            step = back[origin[who] + at[who]]
            at[who] -= step
            owner.append(units[who])
            symbols.append(ids[step - 1, start[who] + at[who]])
            place.append(at[who].copy())
            who = who[at[who] > 0]
        owner, symbols, place = np.concatenate(owner), np.concatenate(symbols), np.concatenate(place)
        order = np.lexsort((place, owner))
        parts.append((owner[order], symbols[order]))
    owner = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    symbols = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=n)
    return symbols[np.argsort(owner, kind="stable")], np.concatenate(([0], np.cumsum(counts))), total


def transfer(score: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Max-plus matrices of chunks: entry (a, b) is the best sum over paths that begin a characters after
    the chunk's left end (a piece from before reaches that far) and end b characters after its right end.

    ``score``: (longest, chunks, places) as from ``_edges``; pieces may reach over the right end.
    ``begin``: whether a unit begins at each place, which all paths pass then.  From the first such place
    on one row of the matrix serves for all.
    """
    longest, n, chunk = score.shape
    cut = np.where(begin.any(1), begin.argmax(1), chunk)
    left = np.full((n, longest), NEVER)
    out = np.full((n, longest, longest), NEVER)
    live = np.arange(n)
    value = np.full((n, longest, longest), NEVER)
    value[:, np.arange(longest), np.arange(longest)] = 0
    for i in range(chunk + 1):
        done = cut[live] == i
        if done.any():
            if i < chunk:
                left[live[done]] = value[done, :, 0]
            else:
                out[live[done]] = value[done]
            live, value = live[~done], value[~done]
        if len(live) == 0:
            break
        value = _moved(value, score[:, live, i].T[:, None, :])
    some = np.flatnonzero(cut < chunk)
    right = np.full((len(some), longest), NEVER)
    for i in range(int(cut[some].min(initial=chunk)), chunk):
        right[cut[some] == i, 0] = 0
        right = _moved(right, score[:, some, i].T)
    out[some] = left[some][:, :, None] + right[:, None, :]
    return out


def _moved(value: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The values one place further: the last axis counts characters from the place on."""
    out = np.full_like(value, NEVER)
    out[..., :-1] = value[..., 1:]
    return np.maximum(out, value[..., :1] + score)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of matrices (last two axes)."""
    out = a[..., :, 0, None] + b[..., 0, None, :]
    for k in range(1, a.shape[-1]):
        np.maximum(out, a[..., :, k, None] + b[..., k, None, :], out=out)
    return out


def prefixes(parts: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, by a balanced (parallel) scan."""
    n = len(parts)
    if n == 1:
        return parts
    done = prefixes(compose(parts[0 : n - 1 : 2], parts[1:n:2]))
    out = np.empty_like(parts)
    out[0] = parts[0]
    out[1::2] = done
    out[2::2] = compose(done[: len(out[2::2])], parts[2::2])
    return out


def scan(v: Vocabulary, codes: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, float]:
    """Best segmentation of one giant unit."""
    n = len(codes)
    begin = np.zeros(n, bool)
    begin[:1] = True
    symbols, _, total = scan_rows(v, codes, np.array([0, n]), n - np.arange(n), begin, chunk)
    return symbols, float(total[0])


def scan_rows(
    v: Vocabulary, codes: np.ndarray, first: np.ndarray, room: np.ndarray, begin: np.ndarray, chunk: int = CHUNK, group: int = GROUP
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, row offsets, row scores) of the best segmentations of giant rows, none of them empty, by
    chunks: matrices, their scan, backtraces.

    ``room``: characters from each place to the end of its unit; ``begin``: where units begin.
    """
    size, reach = np.diff(first), v.longest
    chunk = max(min(chunk, int(size.max())), reach)
    per = -(-size // chunk)
    bound = np.concatenate(([0], np.cumsum(per)))
    n = int(bound[-1])
    # Rows filled up to whole chunks with places that are units of their own and cost nothing.
    place = np.repeat(bound[:-1] * chunk - first[:-1], size) + np.arange(len(codes))
    full = np.zeros(n * chunk + reach, codes.dtype)
    rooms, begins, real = np.zeros(len(full), np.int64), np.ones(len(full), bool), np.zeros(len(full), bool)
    full[place], rooms[place], begins[place], real[place] = codes, room, begin, True

    def lattice(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(lo * chunk, hi * chunk + reach)
        count = (hi - lo) * chunk
        left = np.minimum(rooms[own], count + reach - np.arange(count + reach))
        left[count:] = 0
        ids, score = _edges(v, full[own], left)
        ids, score = ids[:, :count], score[:, :count]
        score[0, ~real[own][:count]] = 0
        return ids.reshape(reach, hi - lo, chunk), score.reshape(reach, hi - lo, chunk)

    spans = [(lo, min(lo + group, n)) for lo in range(0, n, group)]
    matrices = np.empty((n, reach, reach))
    kept = None
    for lo, hi in spans:
        kept = lattice(lo, hi)
        matrices[lo:hi] = transfer(kept[1], begins[lo * chunk : hi * chunk].reshape(-1, chunk))
    enter = np.full((n, reach), NEVER)
    enter[bound[:-1], 0] = 0
    total = np.zeros(len(size))
    for r in range(len(size)):
        got = prefixes(matrices[bound[r] : bound[r + 1]])
        enter[bound[r] + 1 : bound[r + 1]] = got[:-1, 0]
        total[r] = got[-1, 0, 0]
    last = np.zeros(n, bool)
    last[bound[1:] - 1] = True
    exit_ = np.zeros(n, np.int64)  # state at each chunk's right end, known from the chunk behind
    places, found, state = [], [], 0
    for k, (lo, hi) in enumerate(reversed(spans)):
        ids, score = kept if k == 0 else lattice(lo, hi)
        back = _backward(score, enter[lo:hi])
        lefts = _followed(back, chunk)
        for c in range(hi - 1, lo - 1, -1):
            exit_[c] = 0 if last[c] else state
            state = int(lefts[c - lo, exit_[c]])
        at, who = chunk + exit_[lo:hi], np.arange(hi - lo)
        while len(who):
            step = back[at, who]
            at, who, step = at[step > 0], who[step > 0], step[step > 0]
            at = at - step
            places.append((lo + who) * chunk + at)
            found.append(ids[step - 1, who, at])
    at, symbols = np.concatenate(places), np.concatenate(found)
    order = np.argsort(at)
    at, symbols = at[order], symbols[order]
    at, symbols = at[real[at]], symbols[real[at]]
    return symbols, np.searchsorted(at, np.append(bound[:-1] * chunk, n * chunk)), total


def _backward(score: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """(places, chunks): length of the last piece of the best path to each place of every chunk, up to
    the states behind its right end; 0 where the path came in from the left."""
    longest, n, chunk = score.shape
    value = np.full((chunk + longest, n), NEVER)
    value[:longest] = enter.T
    back = np.zeros((chunk + longest, n), np.int64)
    for j in range(1, chunk + longest):
        for size in range(min(j, longest), 0, -1):
            i = j - size
            if i < chunk:
                x = value[i] + score[size - 1, :, i]
                # A piece from before the chunk is longer than any that begins inside it.
                better = x > value[j]
                value[j, better], back[j, better] = x[better], size
    return back


def _followed(back: np.ndarray, chunk: int) -> np.ndarray:
    """(chunks, states): the state at the left end from which each state at the right end is reached."""
    places, n = back.shape
    states = places - chunk
    at = np.repeat(chunk + np.arange(states)[None, :], n, 0)
    who = np.arange(n)[:, None]
    while True:
        step = back[at, who]
        if not step.any():
            return np.minimum(at, states - 1)
        at = at - step


def _expand(v: Vocabulary, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with byte pieces in place of characters that have no piece."""
    bad = np.flatnonzero(symbols < 0)
    if len(bad) == 0:
        return symbols, first
    count = np.ones(len(symbols), np.int64)
    raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in symbols[bad].tolist()]
    count[bad] = [len(x) for x in raw]
    where = np.cumsum(count) - count
    out = np.repeat(symbols, count)
    for k, x in zip(where[bad].tolist(), raw):
        out[k : k + len(x)] = v.byte_id[list(x)]
    ends = np.concatenate(([0], np.cumsum(count)))
    return out, ends[first]


class Codec:
    """Encoder with its cache of units; one per process."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self._reset()

    def _reset(self) -> None:
        kind = np.uint16 if len(self.v.pieces) <= 65536 else np.int32
        self.known = B.KeyMap()
        self.ids, self.best_ids = B.Growing(kind), B.Growing(kind)
        self.ids_at, self.best_at = B.Growing(np.int64), B.Growing(np.int64)
        self.ids_at.add(np.zeros(1, np.int64))
        self.best_at.add(np.zeros(1, np.int64))
        self.score = B.Growing(np.float64)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Segments the given units and appends them to the cache."""
        raw = data[B.ranges(start, end - start)]
        mark = np.concatenate(([0], np.cumsum(B.LEAD[raw])))
        bounds = np.concatenate(([0], np.cumsum(end - start)))
        text = raw.tobytes().decode("utf-8", "replace").replace(" ", MARK)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = mark[bounds]
        sym, at = _expand(self.v, *bpe(self.v, codes, first))
        sym2, first2, score = best(self.v, codes, first)
        sym2, at2 = _expand(self.v, sym2, first2)
        self.ids_at.add(self.ids.n + at[1:])
        self.best_at.add(self.best_ids.n + at2[1:])
        self.ids.add(sym)
        self.best_ids.add(sym2)
        self.score.add(score)

    def units(self, block: B.Block) -> tuple[np.ndarray, np.ndarray, B.Words, np.ndarray]:
        """(bytes with a blank before every text, their row offsets, units, slot of every unit)."""
        data, offsets = block.data, block.offsets
        if MARK.encode() in data.tobytes():
            texts = [block.text(i).replace(MARK, " ").encode() for i in range(block.n)]
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            data = np.frombuffer(b"".join(texts), np.uint8)
        some = np.diff(offsets) > 0
        shift = np.concatenate(([0], np.cumsum(some)))
        full = np.full(len(data) + int(shift[-1]), 32, np.uint8)
        full[np.arange(len(data)) + np.repeat(shift[1:], np.diff(offsets))] = data
        offsets = offsets + shift
        blank = full == 32
        begin = np.zeros(len(full), bool)
        begin[1:] = blank[1:] & ~blank[:-1]
        begin[offsets[:-1][some]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(full))
        units = B.Words(start, end, np.searchsorted(start, offsets))
        h = B.hash_spans(full, start, end, 5)
        order = np.argsort(h)
        hs = h[order]
        new = np.concatenate(([True], hs[1:] != hs[:-1])) if len(hs) else np.zeros(0, bool)
        distinct = hs[new]
        if self.known.n + len(distinct) > CACHE_UNITS:
            self._reset()
        place = self.known.find(distinct)
        unknown = place < 0
        if unknown.any():
            pick = order[new][unknown]
            self._learn(full, start[pick], end[pick])
            place[unknown] = self.known.add(distinct[unknown])
        slot = np.empty(len(h), np.int64)
        if len(h):
            slot[order] = np.repeat(place, np.diff(np.append(np.flatnonzero(new), len(hs))))
        return full, offsets, units, slot

    def encode(self, block: B.Block, kind: str = "ids") -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets)."""
        full, offsets, units, slot = self.units(block)
        return self._gather(units, slot, kind) if kind == "ids" else self.best(full, offsets, units, slot)[:2]

    def best(self, full: np.ndarray, offsets: np.ndarray, units: B.Words, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, row offsets, row scores) of the best segmentations: giant rows by the scan over their
        chunks, others by their units."""
        flat, first = self._gather(units, slot, "best")
        score = B.sums(self.score.values[slot], units.first)
        giant = np.flatnonzero(np.diff(offsets) >= GIANT)
        if len(giant) == 0:
            return flat, first, score
        symbols, at, score[giant] = self._scanned(full, offsets, units, giant)
        parts, last = [], 0
        count = np.diff(first)
        for k, r in enumerate(giant.tolist()):
            parts += [flat[first[last] : first[r]], symbols[at[k] : at[k + 1]]]
            count[r] = at[k + 1] - at[k]
            last = r + 1
        return np.concatenate([*parts, flat[first[last] :]]), np.concatenate(([0], np.cumsum(count))), score

    def _scanned(self, full: np.ndarray, offsets: np.ndarray, units: B.Words, giant: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = full[B.ranges(offsets[giant], offsets[giant + 1] - offsets[giant])]
        text = raw.tobytes().decode("utf-8", "replace").replace(" ", MARK)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        points = np.concatenate(([0], np.cumsum(B.LEAD[full])))  # characters before each byte
        size = points[offsets[giant + 1]] - points[offsets[giant]]
        first = np.concatenate(([0], np.cumsum(size)))
        own = B.ranges(units.first[giant], units.first[giant + 1] - units.first[giant])
        shift = np.repeat(first[:-1] - points[offsets[giant]], units.first[giant + 1] - units.first[giant])
        start, end = points[units.start[own]] + shift, points[units.end[own]] + shift
        begin = np.zeros(len(codes), bool)
        begin[start] = True
        room = np.repeat(end, end - start) - np.arange(len(codes))
        symbols, at, score = scan_rows(self.v, codes, first, room, begin)
        symbols, at = _expand(self.v, symbols, at)
        return symbols, at, score

    def _gather(self, units: B.Words, slot: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        at, store = (self.ids_at, self.ids) if kind == "ids" else (self.best_at, self.best_ids)
        at, store = at.values, store.values
        count = at[slot + 1] - at[slot]
        flat = store[B.ranges(at[slot], count)]
        ends = np.concatenate(([0], np.cumsum(count)))
        return flat, ends[units.first]


def decode(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of rows of ids; the blank that encoding put in front is taken off."""
    ids = ids.astype(np.int64)
    count = v.arena_first[ids + 1] - v.arena_first[ids]
    flat = v.arena[B.ranges(v.arena_first[ids], count)]
    ends = np.concatenate(([0], np.cumsum(count)))[first]
    some = np.diff(ends) > 0
    lead = np.zeros(len(flat), bool)
    lead[ends[:-1][some]] = flat[ends[:-1][some]] == 32
    taken = np.concatenate(([0], np.cumsum(lead)))
    return flat[~lead], ends - taken[ends]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The process's codec for a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(Vocabulary.load(path))
    return _codecs[path]


def _sha(flat: np.ndarray, first: np.ndarray) -> list[str]:
    raw = flat.astype("<i4")
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def checked(block: B.Block, c: Codec) -> dict:
    """Columns of ``encode_digest`` for a block."""
    full, offsets, units, slot = c.units(block)
    ids, first = c._gather(units, slot, "ids")
    best_ids, best_first, best_score = c.best(full, offsets, units, slot)
    same = np.zeros((2, block.n), bool)
    plain, at = decode(c.v, ids, first), decode(c.v, best_ids, best_first)
    size = np.diff(offsets) - (np.diff(offsets) > 0)
    body = np.ones(len(full), bool)
    body[offsets[:-1][np.diff(offsets) > 0]] = False
    want = full[body]
    want_at = np.concatenate(([0], np.cumsum(size)))
    for k, (got, got_at) in enumerate((plain, at)):
        if np.array_equal(got_at, want_at):
            same[k] = B.sums(got != want, want_at) == 0
        else:
            same[k] = [np.array_equal(got[got_at[i] : got_at[i + 1]], want[want_at[i] : want_at[i + 1]]) for i in range(block.n)]
    return {
        "n_ids": np.diff(first),
        "ids_sha256": _sha(ids, first),
        "n_best": np.diff(best_first),
        "best_score": best_score,
        "best_sha256": _sha(best_ids, best_first),
        "round_trip": same.all(0),
    }


SCHEMA = "n_ids long, ids_sha256 string, n_best long, best_score double, best_sha256 string, round_trip boolean"


def encode_digest(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number and digest (of little-endian int32) of the library's ids and of
    the best-scoring segmentation, the latter's score, and whether both decode to the text."""
    return _map.measured(docs, id_col, text_col, SCHEMA, lambda block: checked(block, codec(model)))


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text", kind: str = "ids") -> DataFrame:
    """(id, ids): ``kind`` is "ids" (as the library) or "best" (largest sum of scores)."""

    def measure(block: B.Block) -> dict:
        flat, first = codec(model).encode(block, kind)
        return {"ids": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.astype(np.int32)))}

    return _map.measured(docs, id_col, text_col, "ids array<int>", measure)


def encode_both(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, best): the library's ids and the segmentation with the largest sum of scores."""

    def measure(block: B.Block) -> dict:
        c = codec(model)
        full, offsets, units, slot = c.units(block)
        both = (c._gather(units, slot, "ids"), c.best(full, offsets, units, slot)[:2])
        return {name: pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.astype(np.int32))) for name, (flat, first) in zip(("ids", "best"), both)}

    return _map.measured(docs, id_col, text_col, "ids array<int>, best array<int>", measure)


def round_trips(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, best): the texts to which both segmentations decode; each row is encoded once, where it lies."""

    def measure(block: B.Block) -> dict:
        c = codec(model)
        full, offsets, units, slot = c.units(block)
        out = {}
        for name, (ids, first) in (("text", c._gather(units, slot, "ids")), ("best", c.best(full, offsets, units, slot)[:2])):
            raw, at = decode(c.v, ids, first)
            raw = raw.tobytes()
            out[name] = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return out

    return _map.measured(docs, id_col, text_col, "text string, best string", measure)


def decode_ids(rows: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; bytes that are no UTF-8 become U+FFFD, ids out of range are skipped."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            v = codec(model).v
            texts = []
            for x in lists.to_pylist():
                own = np.array([i for i in x or [] if i is not None and 0 <= i < len(v.pieces)], np.int64)
                texts.append(decode(v, own, np.array([0, len(own)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, schema)
