"""Questions and answers between chunks of a corpus and key ranges, without a row a key.

A chunk is a run of rows of one input partition, at most ``CHUNK_BYTES`` of text or one longer row; it
travels once, as one compressed row, to the partition where all passes over it take place.  No column
decides where rows go, so no id, however common, makes a large chunk.  A chunk asks about keys (64-bit
hashes): it sorts them, combines equal ones, and sends each key range one row that packs the arrays.
The task of a range sees every chunk's keys of that range, and answers each chunk with arrays in the
order of its question.  A key counts at most once a chunk, however many rows hold it, so a hot key makes
no large group.  Ranges number as ``parts`` says, by the input's size.  Rows travel by a column ``to``
whose values Spark's hash partitioning sends to one partition each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _blocks as B
from sparkloom.llm._blocks import U64

#: Text of a chunk, and stored bytes of the input for a key range.
CHUNK_BYTES = 9 << 20
RANGE_BYTES = 16 << 20
_LZ = pa.Codec("zstd", compression_level=1)
MESSAGE = "to int, dest int, chunk int, kind int, body binary"


def parts(df: DataFrame) -> int:
    """Number of key ranges: as many as shuffle partitions, or more where the input asks for it."""
    shuffled = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stored = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(shuffled, -(-stored // RANGE_BYTES)) if stored < 1 << 60 else shuffled  # else unknown


def _murmur3(value: int) -> int:
    """Spark's hash of one int (seed 42)."""
    m = 0xFFFFFFFF
    k = (value & m) * 0xCC9E2D51 & m
    k = ((k << 15 | k >> 17) & m) * 0x1B873593 & m
    h = 42 ^ k
    h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@lru_cache(maxsize=8)
def routes(n: int) -> tuple[int, ...]:
    """For every partition number below n an int that Spark hashes to it."""
    found: dict[int, int] = {}
    value = 0
    while len(found) < n:
        found.setdefault(_murmur3(value) % n, value)
        value += 1
    return tuple(found[i] for i in range(n))


class Chunk(NamedTuple):
    """A chunk's address, and its number in reading order."""

    to: int
    number: int


@lru_cache(maxsize=256)
def _address(n: int, partition: int, k: int) -> int:
    """The address of a partition's k-th chunk: chunks of one number spread evenly over n partitions,
    and no two share an address."""
    wanted, skip = (partition + 7919 * k) % n, (partition // n << 10) + k
    value = -1
    while skip >= 0:
        value += 1
        skip -= _murmur3(value) % n == wanted
    return value


def chunked(df: DataFrame, n: int, **columns) -> DataFrame:
    """(to, number, body): the rows in chunks; ``columns`` must have one named text."""
    inner = df.select(*[c.alias(name) for name, c in columns.items()])
    at = list(columns).index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> pa.RecordBatch:
            nonlocal k
            columns = [pa.array([_address(n, partition, k)], pa.int32()), pa.array([partition << 20 | k]), pa.array([_stored(held)], pa.binary())]
            k += 1
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["to", "number", "body"])

        for batch in batches:
            for block in B.blocks(batch.column(at), CHUNK_BYTES):
                own = int(block.offsets[-1])
                if held and size + own > CHUNK_BYTES:
                    yield made()
                    size = 0
                held.append(batch.slice(block.lo, block.n))
                size += own
        if held:
            yield made()

    return inner.mapInArrow(run, "to int, number long, body binary").repartition(n, "to")


def _stored(batches: list[pa.RecordBatch]) -> bytes:
    """Batches as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=_LZ)) as out:
        for part in batches:
            out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _opened(rows: pa.Table) -> tuple[Chunk, pa.Table]:
    """The chunk that a group of one row holds."""
    with pa.ipc.open_stream(rows["body"][0].as_buffer()) as stream:
        return Chunk(rows["to"][0].as_py(), rows["number"][0].as_py()), stream.read_all().combine_chunks()


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as bytes; those of narrow types are compressed where that makes them smaller."""
    head, body = [], []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        small = _LZ.compress(raw, asbytes=True) if a.dtype.itemsize <= 2 and len(raw) > 64 else raw
        if len(small) > 0.9 * len(raw):
            small = raw
        head.append(f"{a.dtype.str},{len(a)},{len(small)}")
        body.append(small)
    first = ";".join(head).encode()
    return len(first).to_bytes(4, "little") + first + b"".join(body)


def unpack(body: bytes | pa.Scalar) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    view = memoryview(body.as_buffer() if isinstance(body, pa.Scalar) else body)
    size = int.from_bytes(view[:4], "little")
    at, out = 4 + size, []
    for part in bytes(view[4:at]).decode().split(";"):
        kind, n, length = part.split(",")
        raw = view[at : at + int(length)]
        whole = int(n) * np.dtype(kind).itemsize
        if int(length) < whole:
            raw = _LZ.decompress(bytes(raw), whole, asbytes=True)
        out.append(np.frombuffer(bytes(raw), kind))
        at += int(length)
    return out


def thin(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted 64-bit keys as (first key, low and high part of the steps between them): six bytes a key.

    Where a step takes more than 48 bits the keys themselves stand in the first array.
    """
    step = np.diff(keys)
    if len(step) and int(step.max()) >> 48:
        return [keys, np.zeros(0, np.uint32), np.zeros(0, np.uint16)]
    return [keys[:1], step.astype(np.uint32), (step >> U64(32)).astype(np.uint16)]


def thick(first: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The keys of ``thin``."""
    if len(first) != 1:
        return first
    out = np.empty(len(low) + 1, U64)
    out[0] = first[0]
    out[1:] = (high.astype(U64) << U64(32)) | low
    return np.cumsum(out, dtype=U64)


def slices(keys: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of the key ranges in sorted 64-bit keys: range i has the keys from i / n on."""
    edges = np.array([(i << 64) // n for i in range(n)], U64)
    return np.append(np.searchsorted(keys, edges), len(keys))


Rows = list[tuple[int, int, int, bytes]]


def messages(rows: Rows, n: int, back: bool = False) -> pa.Table:
    """Rows of (range, chunk, kind, body) as a table, addressed to the range or back to the chunk."""
    way = routes(n)
    full = [(r[1] if back else way[r[0]], *r) for r in rows]
    cols = list(zip(*full)) if full else [[], [], [], [], []]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["to", "dest", "chunk", "kind", "body"])


def ask(chunks: DataFrame, n: int, question: Callable[[Chunk, pa.Table], Rows]) -> DataFrame:
    """The messages of all chunks."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return messages(question(*_opened(rows)), n)

    return chunks.groupBy("to").applyInArrow(run, MESSAGE)


def answer(asked: DataFrame, n: int, respond: Callable[[list[list[np.ndarray]]], list[tuple]], kind: int = 0) -> DataFrame:
    """Every range's answers, at the chunks that asked: ``respond`` gets the arrays of each message of
    kind 0 and returns as many tuples of arrays, which travel as ``kind``.  Messages of another kind pass
    through to the chunk that sent them."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dest = table["dest"][0].as_py()
        kinds, chunk = table["kind"].to_pylist(), table["chunk"].to_pylist()
        bodies = table["body"].combine_chunks()
        if isinstance(bodies, pa.ChunkedArray):
            bodies = bodies.chunk(0)
        own = [i for i, k in enumerate(kinds) if k == 0]
        got = respond([unpack(bodies[i]) for i in own]) if own else []
        rows = [(dest, chunk[i], kind, pack(*a)) for i, a in zip(own, got)]
        rows += [(dest, chunk[i], k, bodies[i].as_py()) for i, k in enumerate(kinds) if k != 0]
        return messages(rows, n, back=True)

    return asked.groupBy("to").applyInArrow(run, MESSAGE).repartition(n, "to")


def collect(table: pa.Table, kind: int = 0) -> list[list[np.ndarray]]:
    """Arrays of a chunk's messages of one kind, by range."""
    rows = sorted((d, i) for i, (d, k) in enumerate(zip(table["dest"].to_pylist(), table["kind"].to_pylist())) if k == kind)
    return [unpack(table["body"][i].as_py()) for _, i in rows]


def finish(chunks: DataFrame, answers: DataFrame, final: Callable[[Chunk, pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """Every chunk with its answers."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return final(*_opened(left), right)

    return chunks.groupBy("to").cogroup(answers.groupBy("to")).applyInArrow(run, schema)


def ask_again(chunks: DataFrame, answers: DataFrame, n: int, question: Callable[[Chunk, pa.Table, pa.Table], Rows]) -> DataFrame:
    """The messages of all chunks, given the answers to earlier questions."""
    return finish(chunks, answers, lambda chunk, left, right: messages(question(chunk, left, right), n), MESSAGE)
