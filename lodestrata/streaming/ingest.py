"""An extension: the batch operators over a stream of arriving records, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Repeated rows of a key within `late` of each other count once; the state of older keys is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, time: str, width: str, by: list[str], late: str = "7 days") -> DataFrame:
    """Rows by window of time and columns; a window is final when `late` has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    """Hands every micro-batch to `each` (batch, number); with available_now it ends when all that is there has been read."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
