"""Streams: windowed event totals with late data bounded by a watermark, and a log that is fed batch by batch.

The batch library needs no stream; these are an extension for tables that grow all the time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder)


def windowed_totals(events: DataFrame, length: str = "7 days", late: str = "1 day") -> DataFrame:
    """Events, sum and mean of values by window and type; a window closes once the watermark passes it."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")).select("w.start", "w.end", "event_type", "n", "total", "mean")


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Writes each micro-batch below path, in a folder of its number: a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
