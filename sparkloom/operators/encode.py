"""Encoding: native pre-tokenization, then merging of each distinct chunk in Arrow functions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.merge import PairTable, merge_all, merge_heap, merge_loop
from sparkloom.functions.normalize import metaspace, normal_function, normalize, normalize_text
from sparkloom.functions.pretokenize import at_marks, isolate
from sparkloom.plans.spec import AddedToken, Spec

#: A process's cache of a model is emptied when it holds so many chunks, or bytes of chunks.
CACHE_CHUNKS, CACHE_BYTES = 1 << 19, 1 << 23
#: Chunks, and their bytes, that are looked up together, and chunks whose ids are gathered together: what this
#: takes is all that a step needs besides its batch and its result.
BLOCK_CHUNKS, BLOCK_BYTES, GATHER = 1 << 20, 1 << 23, 1 << 17
#: Bytes of a batch on its way to Python and back, in sessions that leave Spark's 64 MB as they are: each step of a
#: task holds several batches, in the worker and outside the JVM's heap.
BATCH, SPARKS_OWN, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"
SPACE = "[ \\t\\n\\r\\x0b\\x0c]*"


@dataclass
class Tables:
    """What the workers need of a spec; fixed by the model, so it may be broadcast."""

    key: str
    byte_ids: np.ndarray
    merges: PairTable
    chars: dict[str, int]
    whole: dict[bytes, int]
    fallback: bool
    lengths: np.ndarray
    arena: np.ndarray
    arena_first: np.ndarray
    forms: tuple[str, ...]
    added: tuple[AddedToken, ...]
    strip: bool

    @classmethod
    def of(cls, spec: Spec) -> Tables:
        raw = spec.token_bytes
        lengths = np.array([len(b) for b in raw], np.int64)
        chars = {t: i for t, i in spec.vocab.items() if len(t) == 1} if spec.byte_fallback else {}
        digest = hashlib.sha1()
        for part in (spec.merges.left, spec.merges.right, spec.merges.rank, spec.merges.target, lengths, spec.byte_ids):
            digest.update(np.ascontiguousarray(part, np.int64).tobytes())
        digest.update(repr((spec.added, spec.forms, spec.byte_fallback, spec.ignore_merges, sorted(chars.items()))).encode())
        return cls(
            digest.hexdigest(), spec.byte_ids, spec.merges, chars, spec.whole_chunks, spec.byte_fallback, lengths,
            np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(lengths))), spec.forms, spec.added, spec.strip_decoded,
        )


@dataclass
class Merger:
    """Chunks to ids with a cache, one a process and model."""

    tables: Tables
    engine: str = "batch"
    place: dict[str, int] = field(default_factory=dict)
    held: int = 0
    char_points: tuple[np.ndarray, np.ndarray] | None = None
    ids: np.ndarray = field(default_factory=lambda: np.zeros(1 << 12, np.int32))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1 << 12, np.int64))

    def seeds(self, chunk: str) -> list[int]:
        """Initial symbols of a chunk; bytes without a token are dropped."""
        t = self.tables
        if not t.fallback:
            own = t.byte_ids[np.frombuffer(chunk.encode("utf-8", "replace"), np.uint8)]
            return own[own >= 0].tolist()
        out = []
        for c in chunk:
            i = t.chars.get(c)
            if i is not None:
                out.append(i)
            else:
                out += [int(x) for x in t.byte_ids[list(c.encode("utf-8", "replace"))] if x >= 0]
        return out

    def _char_seeds(self, raw: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """A symbol for every byte: a character that is a token stands at its first byte, -1 at the others."""
        t = self.tables
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if self.char_points is None:
            pairs = sorted((ord(c), i) for c, i in t.chars.items())
            self.char_points = np.array([p for p, _ in pairs], np.uint32), np.array([i for _, i in pairs], np.int64)
        own, ids = self.char_points
        if len(own) == 0:
            return symbols
        at = np.minimum(np.searchsorted(own, points), len(own) - 1)
        known = own[at] == points
        out = np.where(np.repeat(known, np.diff(np.append(lead, len(raw)))), -1, symbols)
        out[lead[known]] = ids[at[known]]
        return out

    def learn(self, chunks: list[str]) -> None:
        """Merges chunks that aren't in the cache and adds them."""
        t = self.tables
        known = {i: t.whole[b] for i, c in enumerate(chunks) if (b := c.encode("utf-8", "replace")) in t.whole} if t.whole else {}
        if self.engine != "batch":
            seeds = [[known[i]] if i in known else self.seeds(c) for i, c in enumerate(chunks)]
            first = np.concatenate(([0], np.cumsum([len(s) for s in seeds]))).astype(np.int64)
            symbols = np.array([x for s in seeds for x in s], np.int64)
        else:
            column = pa.array(chunks, pa.large_string())
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, np.int64)[: len(chunks) + 1]
            raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
            symbols, first = t.byte_ids[raw], offsets - offsets[0]
            if t.fallback:
                symbols = self._char_seeds(raw, symbols)
            if known:
                keep = np.ones(len(symbols), bool)
                for i, whole in known.items():
                    keep[first[i] + 1 : first[i + 1]] = False
                    symbols[first[i]] = whole
                symbols, first = symbols[keep], np.concatenate(([0], np.cumsum(keep)))[first]
            if (symbols < 0).any():
                keep = symbols >= 0
                symbols, first = symbols[keep], np.concatenate(([0], np.cumsum(keep)))[first]
        if self.engine == "batch":
            ids, first = merge_all(symbols, first, t.merges)
        else:
            merge = merge_loop if self.engine == "loop" else merge_heap
            parts = [merge(symbols[a:b].tolist(), t.merges.lookup()) for a, b in zip(first[:-1], first[1:])]
            ids = np.array([x for p in parts for x in p], np.int64)
            first = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        n = len(self.place)
        base = int(self.first[n])
        self.ids = _room(self.ids, base + len(ids))
        self.first = _room(self.first, n + len(chunks) + 1)
        self.ids[base : base + len(ids)] = ids
        self.first[n + 1 : n + 1 + len(chunks)] = base + first[1:]
        self.place.update((c, n + i) for i, c in enumerate(chunks))

    def slots(self, chunks: pa.Array) -> np.ndarray:
        """Cache place of every chunk of a string array without nulls; it holds until the next call."""
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.place) + len(names) > CACHE_CHUNKS or self.held > CACHE_BYTES:
            self.place, self.held = {}, 0
            self.ids, self.first = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64)
        got = list(map(self.place.get, names))
        new = [c for c, i in zip(names, got) if i is None]
        if new:
            self.learn(new)
            self.held += sum(map(len, new))
            got = list(map(self.place.get, names))
        return np.array(got, np.int32)[coded.indices.to_numpy()]

    def counts(self, values: pa.Array, first: np.ndarray, parts: list[np.ndarray] | None = None) -> np.ndarray:
        """Offsets in ids of rows of chunks; the ids are appended to ``parts``, if given.

        Goes through the chunks block by block, whatever rows they belong to: memory follows the block,
        not the batch or its longest row.
        """
        out = np.zeros(len(first), np.int64)
        total = 0
        for lo, hi in blocks(values):
            all_slots = self.slots(values.slice(lo, hi - lo))
            for lo in range(lo, hi, GATHER):
                slots, all_slots = all_slots[:GATHER], all_slots[GATHER:]
                begin = self.first[slots]
                run = np.zeros(len(slots) + 1, np.int64)
                np.cumsum(self.first[slots + 1] - begin, out=run[1:])
                a, b = np.searchsorted(first, (lo, lo + len(slots)))
                out[a:b] = total + run[first[a:b] - lo]
                if parts is not None:
                    at = np.repeat(begin - run[:-1], np.diff(run))
                    at += np.arange(run[-1])
                    parts.append(self.ids[at])
                total += int(run[-1])
        out[np.searchsorted(first, len(values)) :] = total
        return out

    def encoded(self, values: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of rows of chunks."""
        parts: list[np.ndarray] = []
        out = self.counts(values, first, parts)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32), out


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def blocks(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a string array of at most BLOCK_CHUNKS values and BLOCK_BYTES bytes, or of one value."""
    n = len(values)
    if n == 0:
        return
    wide = pa.types.is_large_string(values.type)
    ends = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + n + 1]
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(ends, int(ends[lo]) + BLOCK_BYTES, "right")) - 1
        hi = max(lo + 1, min(hi, lo + BLOCK_CHUNKS, n))
        yield lo, hi
        lo = hi


def spans_of(lengths: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in bytes of every id within its row."""
    start, end = np.empty(len(ids), np.int32), np.empty(len(ids), np.int32)
    total = base = 0
    for lo in range(0, len(ids), GATHER):
        hi = min(lo + GATHER, len(ids))
        size = lengths[ids[lo:hi]]
        run = np.cumsum(size) + total
        a, b = np.searchsorted(first, (lo, hi))  # the rows that begin here
        at = first[a:b] - lo
        bases = np.concatenate(([base], np.where(at > 0, run[at - 1], total)))
        own = run - np.repeat(bases, np.diff(np.concatenate(([0], at, [hi - lo]))))
        end[lo:hi], start[lo:hi] = own, own - size
        total, base = int(run[-1]), int(bases[-1])
    return start, end


_mergers: dict[tuple[str, str], Merger] = {}


def merger(tables: Tables, engine: str = "batch") -> Merger:
    """The process's merger of a model."""
    key = (tables.key, engine)
    if key not in _mergers:
        _mergers[key] = Merger(tables, engine)
    return _mergers[key]


def rows_of(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values, row offsets from 0) of a list array; null rows are empty."""
    if lists.null_count:
        sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        return lists.flatten(), np.concatenate(([0], np.cumsum(sizes)))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def list_array(values: np.ndarray, first: np.ndarray, valid: pa.Array | None, kind: pa.DataType) -> pa.Array:
    """A list array from flat values; rows that aren't valid are null."""
    mask = None if valid is None else pc.invert(valid)
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values).cast(kind), mask=mask)


def looked_up(lists: pa.Array, keys: pa.Array, values: pa.Array, drop: list[int] | None = None) -> pa.Array:
    """The lists with each key replaced by its value, null for others; keys in ``drop`` are left out."""
    flat, first = rows_of(lists)
    if drop:
        keep = pc.invert(pc.is_in(flat, value_set=pa.array(drop, flat.type)))
        flat, first = flat.filter(keep), np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))[first]
    parts = [pc.index_in(flat.slice(lo, BLOCK_CHUNKS).cast(keys.type), value_set=keys) for lo in range(0, len(flat), BLOCK_CHUNKS)]
    got = values.take(pa.concat_arrays(parts) if parts else pa.array([], pa.int32()))
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), got, mask=mask)


class Encoder:
    """Columns of one tokenizer."""

    def __init__(self, spark: SparkSession, spec: Spec, engine: str = "batch") -> None:
        self.spark, self.spec, self.engine = spark, spec, engine
        self.tables = Tables.of(spec)
        if spark.conf.get(BATCH) == SPARKS_OWN:
            spark.conf.set(BATCH, BATCH_BYTES)
        self.shared: Broadcast = spark.sparkContext.broadcast(self.tables)

    def chunks(self, text: Column, prefix: bool | Column = True, normalized: bool = False) -> Column:
        """Pre-tokens of a text; null for null."""
        s = self.spec
        if not normalized:
            text = normalize(text, s.forms)
        if s.metaspace:
            return at_marks(metaspace(text, s.metaspace, prefix))
        return isolate(text, s.stages)

    def ids(self, text: Column, prefix: bool = True) -> Column:
        """``encode_ordinary``: added tokens are ordinary text."""
        return self._merged(self.chunks(text, prefix))

    def _merged(self, chunks: Column) -> Column:
        return self.merge_function()(chunks)

    def normal_function(self):
        """The Arrow function that normalizes texts."""
        return normal_function(self.spec.forms)

    def merge_function(self):
        """The Arrow function from arrays of chunks to ids."""
        shared, engine = self.shared, self.engine

        @F.arrow_udf("array<int>")
        def run(lists: pa.Array) -> pa.Array:
            m = merger(shared.value, engine)
            values, first = rows_of(lists)
            ids, first = m.encoded(values, first)
            return list_array(ids, first, lists.is_valid() if lists.null_count else None, pa.int32())

        return run

    def count(self, text: Column) -> Column:
        """Number of ids, without making the lists."""
        return self.count_function()(self.chunks(text))

    def count_function(self):
        """The Arrow function from arrays of chunks to numbers of ids."""
        shared, engine = self.shared, self.engine

        @F.arrow_udf("long")
        def run(lists: pa.Array) -> pa.Array:
            m = merger(shared.value, engine)
            values, first = rows_of(lists)
            return pa.array(np.diff(m.counts(values, first)), mask=lists.is_null().to_numpy(zero_copy_only=False))

        return run

    def packed(self, text: Column) -> Column:
        """Ids as little-endian 32-bit integers in one binary value."""
        shared, engine = self.shared, self.engine

        @F.arrow_udf("binary")
        def run(lists: pa.Array) -> pa.Array:
            m = merger(shared.value, engine)
            values, first = rows_of(lists)
            ids, first = m.encoded(values, first)
            ok = pa.concat_arrays([lists.is_valid()]).buffers()[1] if lists.null_count else None
            ends = pa.array(4 * first, pa.int32())
            return pa.Array.from_buffers(pa.binary(), len(lists), [ok, ends.buffers()[1], pa.py_buffer(ids.astype("<i4", copy=False))])

        return run(self.chunks(text))

    def offsets(self, text: Column) -> Column:
        """(ids, spans): the byte span of every id in the text.

        Raises for models whose ids don't spell the text byte for byte; texts that normalization would
        change are an error when they are met.
        """
        s = self.spec
        if s.byte_fallback or s.metaspace:
            raise ValueError("offsets need a byte-level model")
        if (s.byte_ids < 0).any():
            raise ValueError("offsets need a token for every byte")
        shared, engine, forms = self.shared, self.engine, s.forms

        @F.arrow_udf("struct<ids: array<int>, spans: array<struct<start: int, end: int>>>")
        def run(lists: pa.Array, texts: pa.Array) -> pa.Array:
            m = merger(shared.value, engine)
            if forms:
                for t in texts.to_pylist():
                    if t is not None and normalize_text(t, forms) != t:
                        raise ValueError("offsets need texts that are normalized already")
            values, first = rows_of(lists)
            ids, first = m.encoded(values, first)
            span = pa.StructArray.from_arrays([pa.array(x) for x in spans_of(shared.value.lengths, ids, first)], names=["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), span)
            got = list_array(ids, first, None, pa.int32())
            mask = lists.is_null() if lists.null_count else None
            return pa.StructArray.from_arrays([got, spans], names=["ids", "spans"], mask=mask)

        return run(self.chunks(text, normalized=True), text)

    def special(self, text: Column) -> Column:
        """``encode_special``: added tokens are found first, longest at the leftmost place, and the
        text between them is encoded by itself."""
        s = self.spec
        if not s.added:
            return self.ids(text)
        plain = not s.forms and not any(a.lstrip or a.rstrip for a in s.added) and any(a.content for a in s.added)
        parts = native_added(text, s.added) if plain else split_added(text, self.shared)
        prefix = (lambda p: p.start == 0) if s.prepend == "first" else (lambda p: F.lit(True))
        pieces = F.transform(parts, lambda p: F.struct(p.id.alias("id"), self.chunks(p.text, prefix(p), normalized=True).alias("chunks")))
        shared, engine = self.shared, self.engine

        @F.arrow_udf("array<int>")
        def run(lists: pa.Array) -> pa.Array:
            m = merger(shared.value, engine)
            rows, first = rows_of(lists)
            special = rows.field("id").to_numpy(zero_copy_only=False).astype(np.int32)
            values, inner = rows_of(rows.field("chunks"))
            ids, inner = m.encoded(values, inner)
            own = special >= 0
            if own.any():  # a piece is either one added token, without chunks, or the ids of its chunks
                ids = np.insert(ids, inner[:-1][own], special[own])
                inner = inner + np.concatenate(([0], np.cumsum(own)))
            return list_array(ids, inner[first], lists.is_valid() if lists.null_count else None, pa.int32())

        return run(pieces)


def _matcher(added: tuple[AddedToken, ...]) -> tuple[re.Pattern, dict[str, AddedToken]]:
    by = {a.content: a for a in added if a.content}
    order = sorted(by.values(), key=lambda a: (-len(a.content), a.content))
    return re.compile("|".join(re.escape(a.content) for a in order)), by


def split_text(text: str, pattern: re.Pattern, by: dict[str, AddedToken], forms: tuple[str, ...]) -> list[tuple[int, str, int]]:
    """(id or -1, text, byte place) of the pieces of a text around added tokens."""
    out, last = [], 0

    def gap(a: int, b: int) -> None:
        if b > a:
            out.append((-1, normalize_text(text[a:b], forms), 0 if a == 0 else 1))

    for m in pattern.finditer(text):
        token = by[m.group()]
        a, b = m.start(), m.end()
        if token.lstrip:
            while a > last and text[a - 1] in " \t\n\r\x0b\x0c":
                a -= 1
        gap(last, max(a, last))
        out.append((token.id, "", 1))
        if token.rstrip:
            while b < len(text) and text[b] in " \t\n\r\x0b\x0c":
                b += 1
        last = max(last, b)
    gap(last, len(text))
    return out


def native_added(text: Column, added: tuple[AddedToken, ...]) -> Column:
    """The same pieces by native expressions, for added tokens that swallow no white space."""
    by = {a.content: a.id for a in added if a.content}
    longest = sorted(by, key=lambda c: (-len(c), c))
    tokens = "|".join(re.sub(r"([^\w\s])", r"\\\1", c) for c in longest)
    pieces = F.regexp_extract_all(text, F.lit(f"(?:{tokens})|(?:(?!{tokens})[\\s\\S])+"), F.lit(0))
    ids = F.create_map(*[x for c in longest for x in (F.lit(c), F.lit(by[c]))])

    def piece(p: Column, i: Column) -> Column:
        own = F.try_element_at(ids, p)
        return F.struct(F.coalesce(own, F.lit(-1)).alias("id"), F.when(own.isNull(), p).otherwise("").alias("text"), F.when(own.isNull() & (i == 0), 0).otherwise(1).alias("start"))

    return F.transform(pieces, piece)


def split_added(text: Column, shared: Broadcast) -> Column:
    """Array of (id, text, start) pieces around added tokens; ``start`` is 0 for a piece at the text's
    beginning.  The texts between are normalized here, so that no second Python step is needed.

    For tokens that swallow white space, and models that normalize; others are split natively."""

    @F.arrow_udf("array<struct<id: int, text: string, start: int>>")
    def run(texts: pa.Array) -> pa.Array:
        t = shared.value
        pattern, by = _matcher(t.added)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("text", pa.string()), ("start", pa.int32())]))
        rows = []
        for x in texts.to_pylist():
            rows.append(None if x is None else [{"id": i, "text": s, "start": p} for i, s, p in split_text(x, pattern, by, t.forms)])
        return pa.array(rows, kind)

    return run(text)


def token_frequency(df: DataFrame, encoder: Encoder, text: Column) -> DataFrame:
    """(id, n): how often every id occurs in a column of texts.

    The relational plan: chunks are counted first (partial counts before the shuffle), each distinct
    chunk is merged once, and its ids count as often as it occurs.
    """
    chunks = df.select(F.explode(encoder.chunks(text)).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
    ids = chunks.select(F.explode(encoder._merged(F.array("chunk"))).alias("id"), "n")
    return ids.groupBy("id").agg(F.sum("n").alias("n"))
