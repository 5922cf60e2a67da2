"""Benchmark decontamination by a positional inverted index.

``index`` stores the training texts' postings: a table of segments, each the sorted terms of a block of
texts and, term by term, the ascending positions of their words.  A segment holds whole texts, so no
term, however common, has a list longer than its segment, and no list is ever gathered.  A test phrase is
looked for by its rarest term first: the term's list, shifted by the term's place in the phrase, gives
candidates, and the shifted lists of the other terms, rarest first, are intersected with them.  With
``slop`` every term may stand that many words away from its place (proximity match).  The index needs no
shuffle and serves any number of tests; these travel to it in blocks of at most ``MAX_TEST_BYTES``, one
broadcast after the other.

Defined results: null and empty texts have no words, hit nothing and are never contaminated; tests
without words match nothing; rows with repeated or null ids, and equal rows, are judged one by one; a null
test id counts as the empty one, and repeated test ids as one item; texts are searched whole, and one
longer than a segment is a segment of its own; empty tables give empty results or no hits; other columns
are ignored by ``contamination`` and handed on by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import _blocks as B
from sparkloom.llm._components import ensure_checkpoint_dir
from sparkloom.llm._map import as_array, arrow_type

WINDOW = 13
#: Words that a term may stand away from its place in a proximity match of the query.
SLOP = 2
SEGMENT_BYTES = 4 << 20
#: Tests beyond this size are searched for in several blocks, each broadcast by itself.
MAX_TEST_BYTES = 16 << 20


@dataclass
class Tests:
    """Windows of a block of test items: places in the sequence of all their terms."""

    vocabulary: np.ndarray  # sorted word hashes
    sequence: np.ndarray  # term numbers of all items, one after the other
    at: np.ndarray  # where each window begins
    length: np.ndarray
    item: np.ndarray  # index into names
    names: list[str]
    by_key: np.ndarray  # windows ordered by their rarest term
    key_first: np.ndarray  # len(vocabulary) + 1 offsets into by_key
    window: int

    def terms(self, windows: np.ndarray) -> np.ndarray:
        """Term numbers of windows, -1 beyond a window's length."""
        step = np.arange(self.window)
        inside = step < self.length[windows][:, None]
        return np.where(inside, self.sequence[np.where(inside, self.at[windows][:, None] + step, 0)], -1)


def compile_tests(items: list[tuple[str, str | None]], window: int = WINDOW) -> Tests:
    """Windows of (name, text) items; an item shorter than a window is one window."""
    column = pa.array([t or "" for _, t in items], pa.large_string())
    hashes, begins, lengths, owners, base = [np.zeros(0, B.U64)], [], [], [], 0
    for block in B.blocks(column):
        data, w = B.words(block, B.ALNUM)
        hashes.append(B.hash_spans(data, w.start, w.end))
        at = B.window_starts(w.first, window)
        few = np.flatnonzero((w.counts > 0) & (w.counts < window))
        begins += [at + base, w.first[few] + base]
        lengths += [np.full(len(at), window), w.counts[few]]
        owners += [np.searchsorted(w.first, at, "right") - 1 + block.lo, few + block.lo]
        base += len(w.start)
    flat = np.concatenate(hashes)
    vocabulary, count = B.uniq_counts(flat)
    sequence = np.searchsorted(vocabulary, flat).astype(np.int32)
    none = np.zeros(0, np.int64)
    at, length, item = (np.concatenate(x).astype(np.int32) if x else none.astype(np.int32) for x in (begins, lengths, owners))
    tests = Tests(vocabulary, sequence, at, length, item, [n for n, _ in items], none, np.zeros(len(vocabulary) + 1, np.int64), window)
    key = np.zeros(len(at), np.int32)
    for lo in range(0, len(at), 1 << 16):
        terms = tests.terms(np.arange(lo, min(lo + (1 << 16), len(at))))
        rarest = np.argmin(np.where(terms >= 0, count[terms], np.int64(1) << 60), axis=1)
        key[lo : lo + len(terms)] = terms[np.arange(len(terms)), rarest]
    tests.by_key = np.argsort(key, kind="stable").astype(np.int32)
    tests.key_first = np.searchsorted(key[tests.by_key], np.arange(len(vocabulary) + 1))
    return tests


@dataclass
class Segment:
    """The inverted index of a block of texts; positions count the block's words."""

    first: np.ndarray  # first word of each text (texts + 1)
    terms: np.ndarray  # sorted word hashes
    lists: np.ndarray  # offsets of each term's list (terms + 1)
    positions: np.ndarray  # list by list, ascending


def index_segment(block: B.Block) -> tuple[Segment, B.Words]:
    """The segment of a block, and its words."""
    data, w = B.words(block, B.ALNUM)
    h = B.hash_spans(data, w.start, w.end)
    positions = np.argsort(h, kind="stable").astype(np.int32)
    terms, count = B.uniq_counts(h)
    return Segment(w.first.astype(np.int32), terms, np.concatenate(([0], np.cumsum(count))).astype(np.int32), positions), w


def search(segment: Segment, tests: Tests, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in the segment; with ``slop``, of every place at which each
    of the window's words stands at most so many words from where it should."""
    none = np.zeros(0, np.int64)
    if len(tests.vocabulary) == 0 or len(segment.terms) == 0:
        return none, none
    place = np.minimum(np.searchsorted(segment.terms, tests.vocabulary), len(segment.terms) - 1)
    present = segment.terms[place] == tests.vocabulary
    df = np.where(present, np.diff(segment.lists)[place], 0).astype(np.int64)
    known = np.flatnonzero(present)
    windows = tests.by_key[B.ranges(tests.key_first[known], tests.key_first[known + 1] - tests.key_first[known])]
    terms = tests.terms(windows)
    rare = np.where(terms >= 0, df[terms], 1 << 60)
    alive = (rare > 0).all(1)
    windows, terms, rare = windows[alive], terms[alive], rare[alive]
    if len(windows) == 0:
        return none, none
    # The lists of the tests' terms as one ascending list of (term, position).
    size = np.int64(segment.first[-1]) + 1
    count = df[known]
    keyed = np.repeat(known, count) * size + segment.positions[B.ranges(segment.lists[place[known]].astype(np.int64), count)]
    list_first = np.zeros(len(df) + 1, np.int64)
    np.cumsum(df, out=list_first[1:])
    order = np.argsort(rare, axis=1, kind="stable")
    lead = terms[np.arange(len(terms)), order[:, 0]]
    count = df[lead]
    which = np.repeat(np.arange(len(windows)), count)
    place = keyed[B.ranges(list_first[lead], count)] - lead[which] * size
    row = np.searchsorted(segment.first, place, "right") - 1
    start = place - order[which, 0]
    if slop:
        step = np.arange(-slop, slop + 1)
        start, row, which = (start[:, None] + step).ravel(), np.repeat(row, len(step)), np.repeat(which, len(step))
    # Windows lie in the text of their rarest term.
    ok = (start >= segment.first[row]) & (start + tests.length[windows[which]] <= segment.first[row + 1])
    start, which = start[ok], which[ok]
    for k in range(1, tests.window):
        if len(start) == 0:
            break
        offset = order[which, k]
        term = terms[which, offset]
        low = high = start + offset
        if slop:
            row = np.searchsorted(segment.first, start, "right") - 1
            low, high = np.maximum(low - slop, segment.first[row]), np.minimum(high + slop, segment.first[row + 1] - 1)
        near = np.searchsorted(keyed, term * size + low)
        ok = (term < 0) | ((near < len(keyed)) & (keyed[np.minimum(near, len(keyed) - 1)] <= term * size + high))
        start, which = start[ok], which[ok]
    return windows[which], start


def _marked(segment: Segment, tests: Tests, window: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each word of a segment lies in an occurrence."""
    mark = np.zeros(int(segment.first[-1]) + 1, np.int32)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + tests.length[window], -1)
    return np.cumsum(mark[:-1]) > 0


def _named(segment: Segment, tests: Tests, window: np.ndarray, start: np.ndarray) -> list[set]:
    """Names of the items found in each text."""
    names: list[set] = [set() for _ in range(len(segment.first) - 1)]
    row = np.searchsorted(segment.first, start, "right") - 1
    for p in B.uniq(row * max(len(tests.names), 1) + tests.item[window]).tolist():
        names[p // len(tests.names)].add(tests.names[p % len(tests.names)])
    return names


INDEX = "texts int, first binary, terms binary, lists binary, positions binary"


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of all texts as a table of segments: (segment, ids, texts, first, terms, lists,
    positions), the last four as little-endian arrays (32 bits; terms 64 bits).  Write it to keep it."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *T._parse_datatype_string(INDEX).fields])
    inner = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in B.blocks(batch.column(1), SEGMENT_BYTES):
                s, _ = index_segment(block)
                ids = batch.column(0).slice(block.lo, block.n)
                columns = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, block.n], pa.int32()), pa.concat_arrays([ids])), pa.array([block.n], pa.int32())]
                columns += [pa.array([a.tobytes()], pa.binary()) for a in (s.first, s.terms, s.lists, s.positions)]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return inner.mapInArrow(run, schema)


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, Segment]]:
    """(number, ids, segment) of every row of an index."""
    number, ids = batch.column("segment").to_pylist(), batch.column("ids")
    for i, n in enumerate(number):
        first, terms, lists, positions = (batch.column(c)[i].as_buffer() for c in ("first", "terms", "lists", "positions"))
        segment = Segment(np.frombuffer(first, np.int32), np.frombuffer(terms, B.U64), np.frombuffer(lists, np.int32), np.frombuffer(positions, np.int32))
        yield n, ids[i].values, segment


def _test_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The tests (name, text) in blocks of about bounded size, repeated ids and null texts included."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("name"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = total // MAX_TEST_BYTES + 1
    if parts == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k) for k in range(parts)]


def _collected(items: DataFrame) -> list[tuple[str, str | None]]:
    """A block of tests on the driver."""
    return [(r.name if r.name is not None else "", r.text) for r in items.collect()]


def _finish(segment: Segment, hit: np.ndarray, names: list[set], near: list[set]) -> dict:
    n_words, n_hit = np.diff(segment.first).astype(np.int64), B.sums(hit, segment.first)
    return {
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": np.array([len(x) for x in names], np.int64),
        "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names],
        "contaminated": (n_hit > 0) & (20 * n_hit >= n_words),
        "n_near": np.array([len(x | y) for x, y in zip(names, near)], np.int64),
    }


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long"
_HITS = "segment long, hit binary, names array<array<string>>, near array<array<string>>"


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP,
) -> DataFrame:
    """One row per document: words, words hit by any test window, items, the verdict, and the items of
    which a window occurs exactly or in proximity.

    A document is contaminated if at least one word in twenty is hit.  The index is stored in the
    checkpoint folder and searched there, by every block of tests.
    """
    ensure_checkpoint_dir(docs)
    stored = index(docs, id_col, text_col).checkpoint()
    fields = T._parse_datatype_string(SCHEMA).fields
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])
    spark, kinds = docs.sparkSession, [arrow_type(f.dataType) for f in fields]

    def rows(ids: pa.Array, got: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *[as_array(got[f.name], k) for f, k in zip(fields, kinds)]], names=out.names)

    def search_all(segment: Segment, tests: Tests) -> tuple[np.ndarray, list[set], list[set]]:
        window, start = search(segment, tests)
        near = search(segment, tests, slop) if slop else (window[:0], start[:0])
        return _marked(segment, tests, window, start), _named(segment, tests, window, start), _named(segment, tests, *near)

    blocks = _test_blocks(benchmark, item_col, item_text_col)
    if len(blocks) == 1:
        shared = spark.sparkContext.broadcast(compile_tests(_collected(blocks[0]), window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, ids, segment in _segments(batch):
                    yield rows(ids, _finish(segment, *search_all(segment, shared.value)))

        return stored.mapInArrow(run, out)
    # Several blocks of tests: each one's hits are stored, then the segments take them together.
    hits: DataFrame | None = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(compile_tests(_collected(block), window))

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, _, segment in _segments(batch):
                    hit, names, near = search_all(segment, shared.value)
                    if hit.any() or any(near):
                        lists = [[sorted(x) for x in sets] for sets in (names, near)]
                        kind = pa.list_(pa.list_(pa.string()))
                        columns = [pa.array([number]), pa.array([np.packbits(hit).tobytes()], pa.binary()), *[pa.array([x], kind) for x in lists]]
                        yield pa.RecordBatch.from_arrays(columns, names=["segment", "hit", "names", "near"])

        part = stored.mapInArrow(partial, _HITS).checkpoint()
        shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
    # A segment has at most one row of hits for each block of tests.
    joined = stored.join(hits.groupBy("segment").agg(F.collect_list(F.struct("hit", "names", "near")).alias("hits")), "segment", "left")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (_, ids, segment) in enumerate(_segments(batch)):
                n = len(segment.first) - 1
                hit, names, near = np.zeros(int(segment.first[-1]), bool), [set() for _ in range(n)], [set() for _ in range(n)]
                for x in batch.column("hits")[i].as_py() or []:
                    hit |= np.unpackbits(np.frombuffer(x["hit"], np.uint8), count=len(hit)).astype(bool)
                    for r in range(n):
                        names[r].update(x["names"][r])
                        near[r].update(x["near"][r])
                yield rows(ids, _finish(segment, hit, names, near))

    return joined.mapInArrow(together, out)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, length_col: str | None = "n_chars",
) -> DataFrame:
    """The documents without contaminated ones; from the others, hit words are cut out of the text.

    All columns return; ``length_col``, where present, follows texts that changed.  Tests in several
    blocks mark the unchanged text one after the other; it is judged and cut once, by all marks.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else -1
    schema, width = docs.schema, len(docs.columns)
    # Between blocks of tests a row carries the bits of the words that were hit so far, null for none.
    marks = "marks"
    while marks in docs.columns:
        marks += "_"
    marked = T.StructType([*schema.fields, T.StructField(marks, T.BinaryType())])
    spark = docs.sparkSession
    shared_tests = [spark.sparkContext.broadcast(compile_tests(_collected(x), window)) for x in _test_blocks(benchmark, item_col, item_text_col)]
    for k, shared in enumerate(shared_tests):
        last = k == len(shared_tests) - 1

        def run(batches, shared=shared, first=k == 0, last=last):
            for batch in batches:
                for block in B.blocks(batch.column(at), SEGMENT_BYTES):
                    segment, w = index_segment(block)
                    hit, counts = _marked(segment, shared.value, *search(segment, shared.value)), w.counts
                    part = batch.slice(block.lo, block.n)
                    if not first:
                        for r, bits in enumerate(part.column(width).to_pylist()):
                            if bits is not None:
                                hit[w.first[r] : w.first[r + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(counts[r])).astype(bool)
                        part = part.select(range(width))
                    n_hit = B.sums(hit, w.first)
                    if last:
                        yield _judged(part, block, w, hit, n_hit, at, length)
                        continue
                    bits = [np.packbits(hit[w.first[r] : w.first[r + 1]]).tobytes() if n_hit[r] else None for r in range(block.n)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bits, pa.binary())], names=[*part.schema.names, marks])

        docs = docs.mapInArrow(run, schema if last else marked)
    return docs


def _judged(part: pa.RecordBatch, block: B.Block, w: B.Words, hit: np.ndarray, n_hit: np.ndarray, at: int, length: int) -> pa.RecordBatch:
    """The rows of a block that stay, hit words cut out of their texts."""
    cut = np.flatnonzero((n_hit > 0) & (20 * n_hit < w.counts))
    if len(cut):
        texts = part.column(at).to_pylist()
        lengths = part.column(length).to_pylist() if length >= 0 else None
        for r in cut.tolist():
            texts[r] = _without(block, w, hit, r)
            if lengths is not None:
                lengths[r] = len(texts[r])
        part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
        if lengths is not None:
            part = part.set_column(length, part.schema.field(length), pa.array(lengths, part.schema.field(length).type))
    return part.filter(pa.array((n_hit == 0) | (20 * n_hit < w.counts)))


def _without(block: B.Block, w: B.Words, hit: np.ndarray, row: int) -> str:
    """A row's text without its runs of hit words (and what stands between their words)."""
    a, b = int(w.first[row]), int(w.first[row + 1])
    runs = B.runs(hit[a:b], np.array([0, b - a]))
    parts, last = [], int(block.offsets[row])
    for s, e in zip((runs.start + a).tolist(), (runs.end + a).tolist()):
        parts.append(block.data[last : w.start[s]].tobytes())
        last = int(w.end[e - 1])
    parts.append(block.data[last : block.offsets[row + 1]].tobytes())
    return b"".join(parts).decode()


def postings(stored: DataFrame) -> DataFrame:
    """An index's lists as a table: (term, segment, text, positions), ``text`` counting the segment's texts
    and ``positions`` the text's words; ``term`` is the word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, _, s in _segments(batch):
                row = np.searchsorted(s.first, s.positions, "right") - 1
                term = np.repeat(np.arange(len(s.terms)), np.diff(s.lists))
                new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])))) if len(row) else row
                place = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array((s.positions - s.first[row]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.terms[term[new]].view(np.int64)), pa.array(np.full(len(new), number)), pa.array(row[new].astype(np.int32)), place],
                    names=["term", "segment", "text", "positions"],
                )

    return stored.mapInArrow(run, "term long, segment long, text int, positions array<int>")
