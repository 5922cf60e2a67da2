"""Tokenization of streams: stateless a row, so every column expression works as it is; token counts
in event-time windows use a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.api import SparkTokenizer


def read_texts(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder; a path of one file streams that file."""
    reader = spark.readStream.schema(schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        reader = reader.option("pathGlobFilter", place.getName())
        folder = place.getParent().toString()
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def encode_stream(stream: DataFrame, tokenizer: SparkTokenizer, text: str = "text", out: str = "ids") -> DataFrame:
    """The stream with the ids of its texts."""
    return stream.withColumn(out, tokenizer.encode(text))


def tokens_per_window(stream: DataFrame, tokenizer: SparkTokenizer, time: str, text: str, width: str = "5 minutes", late: str = "10 minutes", by: str | None = None) -> DataFrame:
    """(window, by, n_tokens) of a stream; rows that come later than ``late`` don't count."""
    keys = [F.window(time, width)] + ([F.col(by)] if by else [])
    counted = stream.withColumn("_n", tokenizer.count(text)).withWatermark(time, late)
    return counted.groupBy(*keys).agg(F.sum("_n").alias("n_tokens"))


def write_parquet(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Starts writing a stream to Parquet; exactly once by its checkpoint folder."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
