"""Connected components of a graph given as a table of edges (a, b) of 64-bit numbers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many edges (16 bytes each) one task joins them; beyond, the tables below do.
ONE_TASK_EDGES = 4_000_000


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """The cluster's folder from spark.checkpoint.dir; one of our own only where it is unset and all runs
    on one machine (elsewhere it has to be set)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component), by repeated label minima and shortcuts."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if parts:
            node, root = roots(*(np.concatenate(p) for p in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def _in_rounds(edges: DataFrame) -> DataFrame:
    """Alternating large and small stars: each round links neighbours to the smallest of them, until
    every component is a star around its smallest node.  Minima are aggregated before they are joined
    back, so a node with many neighbours makes no large group."""
    ensure_checkpoint_dir(edges)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        then = small.where("a <> b").distinct().checkpoint()
        same = then.count() == now.count() and then.exceptAll(now).isEmpty()
        now = then
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component."""
    ensure_checkpoint_dir(edges)
    edges = edges.select("a", "b").distinct().checkpoint()
    return _in_one_task(edges) if edges.count() <= one_task_edges else _in_rounds(edges)
