"""Tables of the engine: raw tables, and the frame, recording and log views over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

H = 3_600_000_000  # an hour in microseconds

#: Columns of a frame index, as files of any age are read.
FRAME_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("frame_id", T.StringType()), ("image_id", T.StringType()), ("channel", T.IntegerType()), ("stream", T.StringType()), ("codec", T.StringType()), ("frame_type", T.StringType()))]
    + [T.StructField(n, T.LongType()) for n in ("header_offset", "payload_offset", "payload_len", "ts_header_us", "ts_index_us")]
    + [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("recording_id", T.StringType()), T.StructField("deleted", T.BooleanType()), T.StructField("payload_sha256", T.StringType())]
    + [T.StructField("ts_osd_us", T.LongType()), T.StructField("ts_norm_us", T.LongType()), T.StructField("norm_confidence", T.DoubleType()), T.StructField("motion_score", T.DoubleType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: channel, ts_us (null for every 11th), off, kind, value, props, deleted, source, recording_id, payload_len."""
    e = table(spark, sf_dir, "events")
    off, user = F.col("event_id"), F.col("user_id")
    return e.select(
        user.alias("channel"),
        F.when(off % 11 != 0, micros(F.col("ts"))).alias("ts_us"),
        off.alias("off"),
        F.col("event_type").alias("kind"),
        "value",
        "props",
        (off % 5 == 0).alias("deleted"),
        F.when(off % 3 == 0, "index").when(off % 3 == 1, "carved").otherwise("inferred").alias("source"),
        F.concat(F.lit("rec_"), user.cast("string"), F.lit("_"), F.expr("event_id div 500").cast("string")).alias("recording_id"),
        F.floor("value").cast("long").alias("payload_len"),
    )


def recordings(fr: DataFrame) -> DataFrame:
    """Per recording: channel, span, frames, deleted if most of its frames are; null spans stay null."""
    return fr.groupBy("recording_id").agg(F.min("channel").alias("channel"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n_frames"), (F.count_if("deleted") * 4 > F.count("*")).alias("deleted"), F.min("off").alias("first_off"))


def write_frames(rows: DataFrame, path: str) -> None:
    """Frame index by image, sorted within files by channel, time and place, nulls first; images written anew replace only themselves."""
    order = [F.col(c).asc_nulls_first() for c in ("channel", "ts_header_us", "payload_offset")]
    rows.repartition("image_id").sortWithinPartitions("image_id", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image_id").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame index of all images, files of any age united by name."""
    from frameloom.operators.lookup import tolerant

    return tolerant(spark.read.option("mergeSchema", "true").parquet(path), FRAME_SCHEMA)


def updated(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``rows`` with the non-null values of ``updates`` by key."""
    cols = [c for c in updates.columns if c != key]
    u = updates.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_u_{c}") for c in cols))
    out = rows.join(u, rows[key] == u["_k"], "left")
    return out.select(*(F.coalesce(f"_u_{c}", c).alias(c) if c in cols else F.col(c) for c in rows.columns))


#: The same views as DuckDB SQL.
FR = (
    "fr AS (SELECT user_id AS channel, CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) END AS ts_us, event_id AS off, event_type AS kind, value, props,"
    " event_id % 5 = 0 AS deleted, CASE event_id % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'carved' ELSE 'inferred' END AS source,"
    " 'rec_' || user_id || '_' || (event_id // 500) AS recording_id, CAST(floor(value) AS BIGINT) AS payload_len FROM events)"
)
REC = FR + (
    ", rec AS (SELECT recording_id, min(channel) AS channel, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_frames,"
    " count(*) FILTER (deleted) * 4 > count(*) AS deleted, min(off) AS first_off FROM fr GROUP BY 1)"
)
