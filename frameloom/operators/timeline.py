"""A channel's timeline as rows: what is recorded, deleted, moving, and how far its clock is trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.intervals import dealt_join


def items(recordings: DataFrame, deletions: DataFrame, motion: DataFrame, clocks: DataFrame, image: str, channel: str) -> DataFrame:
    """image, channel, kind (coverage, deleted, motion, clock), start_us, end_us, ref, score: a row for each item.

    Channels are those of the recordings. Live recordings are coverage, null times as 0. A deletion whose
    channel is null stands on every channel of its image. A channel without a clock model has a clock row of score 0.

    ``recordings``: recording_id, deleted, start_us, end_us, source. ``deletions``: finding_id, start_us, end_us.
    ``motion``: start_us, peak. ``clocks``: method, confidence, at most one a channel.
    """
    keys = [image, channel]
    channels = recordings.select(*keys).distinct()

    def rows(source: DataFrame, kind: str, start: Column, end: Column, ref: Column, score: Column) -> DataFrame:
        return source.select(*keys, F.lit(kind).alias("kind"), start.cast("long").alias("start_us"), end.cast("long").alias("end_us"), ref.cast("string").alias("ref"), score.cast("double").alias("score"))

    none, zero = F.lit(None), F.lit(0)
    on_all = deletions.where(F.col(channel).isNull()).drop(channel).withColumnRenamed(image, "_image")
    of_all = dealt_join(on_all, channels, [("_image", image)])  # few images of many channels and deletions
    of_one = deletions.where(F.col(channel).isNotNull()).join(channels, keys, "left_semi")
    clock = channels.join(clocks, keys, "left")
    out = rows(recordings.where("NOT deleted"), "coverage", F.coalesce("start_us", zero), F.coalesce("end_us", zero), F.col("source"), none)
    out = out.union(rows(of_all.select(of_one.columns).union(of_one), "deleted", F.col("start_us"), F.col("end_us"), F.col("finding_id"), none))
    out = out.union(rows(motion.join(channels, keys, "left_semi"), "motion", F.col("start_us"), none, none, F.col("peak")))
    return out.union(rows(clock, "clock", none, none, F.coalesce("method", F.lit("no clock model")), F.coalesce("confidence", F.lit(0.0))))
