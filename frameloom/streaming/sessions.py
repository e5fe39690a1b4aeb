"""Streams of events: sessions by gap and bucketed counts, with watermarks.

An addition: evidence at rest is the rule, but custody and device logs arrive as JSON lines.
A session closes when no event came for the gap; an event exactly one gap later still belongs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([T.StructField("channel", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType())])


def json_lines(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """Events of new JSON-lines files in a folder, as a stream."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_each).json(folder)


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of a channel's events separated by more than the gap; events later than ``late`` are dropped."""
    out = events.withWatermark("ts", late).groupBy("channel", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.max("value").alias("peak"))
    return out.select("channel", F.col("w.start").alias("start_ts"), "last_ts", "n", "peak")


def buckets(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events by channel and time bucket."""
    return events.withWatermark("ts", late).groupBy("channel", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select("channel", F.col("w.start").alias("start_ts"), "n")


def written(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Append closed groups to Parquet; ``once`` takes what is there and stops."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
