"""Row-wise operators as Arrow maps: no shuffle, whole rows in, whole rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import _blocks as B

Measure = Callable[[B.Block], dict]


def as_array(values, kind: pa.DataType) -> pa.Array:
    """A numpy array, list or Arrow array as an Arrow array of the given type."""
    if isinstance(values, pa.Array):
        return values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values).cast(kind)
    return pa.array(values, kind)


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type in which Spark expects a column of this type back."""
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.FloatType: pa.float32()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return simple[type(kind)]


def measured(df: DataFrame, id_col: str, text_col: str, schema: str, measure: Measure, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, *also, measured columns) of every row.

    ``measure`` gets blocks of the text column and returns one value a row for every column of
    ``schema`` (a DDL string).  The id and the columns in ``also`` pass through with their types.
    """
    kept = [id_col, *also]
    inner = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = T._parse_datatype_string(schema).fields
    out = T.StructType([*[T.StructField(c, df.schema[c].dataType, True) for c in kept], *fields])
    kinds = [arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column(n_kept)):
                got = measure(block)
                columns = [batch.column(i).slice(block.lo, block.n) for i in range(n_kept)]
                columns += [as_array(got[c], k) for c, k in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return inner.mapInArrow(run, out)


def filtered(df: DataFrame, text_col: str, keep: Callable[[B.Block], np.ndarray]) -> DataFrame:
    """The rows for whose text ``keep`` is true, all columns unchanged."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column(at)):
                yield batch.slice(block.lo, block.n).filter(pa.array(keep(block)))

    return df.mapInArrow(run, df.schema)
