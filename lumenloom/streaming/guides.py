"""Guides as streams: an extension, since listings are usually batches.

Slots that arrive as files are merged batch by batch; late corrections replace nothing, since the
first of a slot wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slot_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_of_slot(slots: DataFrame, late: str = "2 days") -> DataFrame:
    """The first of each channel and start of a stream of ``slots(channel, start_at, ..)``; state is dropped after the watermark."""
    return slots.withWatermark("start_at", late).dropDuplicatesWithinWatermark(["channel", "start_at"])


def starts_per_window(slots: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    w = F.window("start_at", width)
    return slots.withWatermark("start_at", late).groupBy(w, "channel").agg(F.count("*").alias("starts")).select(F.col("window.start").alias("from"), "channel", "starts")
