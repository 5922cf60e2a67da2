"""Inputs with fewer splits than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The frame over all cores: a scan with fewer partitions (a file of few row groups) is dealt out
    anew, any other one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
