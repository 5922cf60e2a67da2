"""Decoding: ids to bytes to text, with U+FFFD for bytes that are no UTF-8."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.operators.encode import Encoder, Tables, rows_of

TOP = 1 << 32
#: Ids that are decoded together, unless one row has more.
BLOCK_IDS = 1 << 17


def decode_rows(t: Tables, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """Texts of rows of ids; ids without a token are skipped, negative or oversized ones raise."""
    if len(ids) and (ids.min() < 0 or ids.max() >= TOP):
        raise ValueError("token ids must lie between 0 and 2 ** 32 - 1")
    known = ids < len(t.lengths)
    at = np.where(known, ids, 0)
    count = np.where(known, t.lengths[at], 0) if len(t.lengths) else np.zeros(len(ids), np.int64)
    ends = np.concatenate(([0], np.cumsum(count)))
    place = np.repeat(t.arena_first[at] - ends[:-1], count) + np.arange(ends[-1])
    raw = t.arena[place].tobytes()
    out = []
    for a, b in zip(ends[first[:-1]].tolist(), ends[first[1:]].tolist()):
        own = raw[a:b]
        if t.strip and own.startswith(b" "):
            own = own[1:]
        out.append(own.decode("utf-8", "replace"))
    return out


def decode_lists(t: Tables, lists: pa.Array) -> pa.Array:
    """Texts of an array of lists of ids, some rows at a time."""
    values, first = rows_of(lists)
    if not pa.types.is_integer(values.type):
        values = values.cast(pa.int64(), safe=False)
    values = values.to_numpy(zero_copy_only=False)
    out, lo, n = [], 0, len(lists)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + BLOCK_IDS, "right")) - 1)
        out.append(pa.array(decode_rows(t, values[first[lo] : first[hi]].astype(np.int64), first[lo : hi + 1] - first[lo]), pa.string()))
        lo = hi
    texts = pa.concat_arrays(out) if out else pa.array([], pa.string())
    return pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string())) if lists.null_count else texts


def decode(encoder: Encoder, ids: Column, skip_special: bool = False) -> Column:
    """Text of an array of ids; null for null."""
    shared = encoder.shared
    if skip_special and encoder.spec.special_ids:
        special = F.array(*[F.lit(i) for i in encoder.spec.special_ids])
        ids = F.filter(ids, lambda x: ~F.array_contains(special, x.cast("int")))

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        return decode_lists(shared.value, lists)

    return run(ids)  # without a cast in between, so that encoding and decoding are one step in one worker


def decode_packed(encoder: Encoder, packed: Column) -> Column:
    """Text of ids packed as little-endian 32-bit integers."""
    shared = encoder.shared

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for raw in values.to_pylist():
            if raw is None:
                out.append(None)
                continue
            if len(raw) % 4:
                raise ValueError("packed ids must be a multiple of four bytes")
            ids = np.frombuffer(raw, "<u4").astype(np.int64)
            out += decode_rows(shared.value, ids, np.array([0, len(ids)]))
        return pa.array(out, pa.string())

    return run(packed)
