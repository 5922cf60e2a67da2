"""Rows as training sequences: places by cumulative token count, and padded rows as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order column into which a running sum is divided.
RANGES = 64


def running_sum(df: DataFrame, value: str, order: str, out: str) -> DataFrame:
    """The frame with the sum of ``value`` over all rows before each one, in a numeric order without ties.

    The order is cut into ranges at quantiles: sums run within each range, and the ranges' totals, at most
    ``RANGES`` + 1 rows, are joined back, so no task orders all rows.
    """
    cuts = df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [k / RANGES for k in range(1, RANGES)], 1 / (4 * RANGES))
    edges = sorted(set(cuts))
    at = F.size(F.filter(F.lit(edges), lambda e: e <= F.col(order).cast("double"))) if edges else F.lit(0)
    ranged = df.withColumn("_range", at)
    inner = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    joined = ranged.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0))).join(F.broadcast(totals), "_range")
    return joined.withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")


def packed(df: DataFrame, count: str, order: str, size: int) -> DataFrame:
    """The frame with (first_sequence, offset, last_sequence): rows follow each other in sequences of
    ``size`` ids, and one that doesn't fit goes on in the next.  An empty row has no last sequence."""
    out = running_sum(df, count, order, "_start")
    end = F.col("_start") + F.col(count) - 1
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.floor(F.col("_start") / size).cast("long").alias("first_sequence"),
        (F.col("_start") % size).cast("long").alias("offset"),
        F.when(F.col(count) > 0, F.floor(end / size)).cast("long").alias("last_sequence"),
    )


def matrices(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(rows, width, *columns): each batch of equally long arrays as one matrix of little-endian longs."""
    kind = ", ".join(["rows int", "width int", *[f"`{c}` binary" for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            flat = [c.flatten().to_numpy(zero_copy_only=False).astype("<i8") for c in batch.columns]
            if any(len(x) % n or len(set(np.diff(c.offsets).tolist())) > 1 for x, c in zip(flat, batch.columns)):
                raise ValueError("tensors need rows of one length; pad them")
            values = [pa.array([n], pa.int32()), pa.array([len(flat[0]) // n], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in flat]]
            yield pa.RecordBatch.from_arrays(values, names=["rows", "width", *columns])

    return df.select(*columns).mapInArrow(run, kind)


def tensors(df: DataFrame, columns: tuple[str, ...], kind: str = "np") -> Iterator[dict]:
    """The matrices one after the other, as numpy arrays or torch tensors."""
    if kind not in ("np", "pt"):
        raise ValueError(f"unknown kind of tensors: {kind!r}")
    if kind == "pt":
        try:
            import torch
        except ImportError as error:
            raise ValueError("torch isn't installed; ask for numpy arrays") from error
    for r in matrices(df, columns).toLocalIterator():
        out = {c: np.frombuffer(bytes(r[c]), "<i8").reshape(r["rows"], r["width"]) for c in columns}
        yield {c: torch.from_numpy(x.copy()) for c, x in out.items()} if kind == "pt" else out
