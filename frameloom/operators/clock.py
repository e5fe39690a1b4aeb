"""Clock models: segments from clock changes, lookup, normalised time and its confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROLLBACK_US = 5_000_000


def segments(changes: DataFrame, keys: list[str], seizure_offset: Column) -> DataFrame:
    """Piecewise-constant offsets from clock changes (old_us, new_us), folded back from the seizure.

    The offset before a change is the one after it less the jump: a reverse running
    sum. Segments reach from the new time of one change to the old time of the
    next; the first and last are open.
    """
    w = Window.partitionBy(*keys).orderBy("old_us")
    after = F.sum(F.col("new_us") - F.col("old_us")).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = changes.select(*keys, F.lag("new_us").over(w).alias("from_us"), F.col("old_us").alias("to_us"), (seizure_offset - after).cast("long").alias("offset_us"), F.row_number().over(w).alias("i"), F.lead("old_us").over(w).isNull().alias("_last"), F.col("new_us").alias("_new"), seizure_offset.cast("long").alias("_s"))
    tail = rows.where("_last").select(*keys, F.col("_new").alias("from_us"), F.lit(None).cast("long").alias("to_us"), F.col("_s").alias("offset_us"), (F.col("i") + 1).alias("i"))
    return rows.drop("_last", "_new", "_s").unionByName(tail).withColumn("i", (F.col("i") - 1).cast("long"))


def segment_of(ts: Column, segs: Column) -> Column:
    """Index in ``segs`` (array of from_us, to_us) of a device time.

    One match: that. Several: the one whose finite bound is nearest. None: the first if before
    the first bounded start, else the last.
    """
    inside = lambda s: (s["from_us"].isNull() | (s["from_us"] <= ts)) & (s["to_us"].isNull() | (ts < s["to_us"]))
    far = F.lit(9_000_000_000_000_000_000)
    near = lambda s: F.least(F.coalesce(F.abs(ts - s["from_us"]), far), F.coalesce(F.abs(ts - s["to_us"]), far))
    ranked = F.filter(F.transform(segs, lambda s, i: F.struct(near(s).alias("d"), i.alias("i"), inside(s).alias("in"))), lambda x: x["in"])
    starts = F.filter(F.transform(segs, lambda s: s["from_us"]), lambda x: x.isNotNull())
    none = F.when(ts < F.array_min(starts), 0).otherwise(F.size(segs) - 1)
    return F.when(ts.isNotNull(), F.when(F.size(ranked) > 0, F.array_min(ranked)["i"]).otherwise(none))


def chronological(rows: DataFrame, keys: list[str], ts: str, place: str, n_segments: Column, name: str = "segment") -> DataFrame:
    """Segment number in order of place: one on with every time under the highest so far by more than 5 s, the last at most."""
    w = Window.partitionBy(*keys).orderBy(place)
    high = F.max(ts).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("_b", F.coalesce(F.col(ts) < high - ROLLBACK_US, F.lit(False)).cast("int"))
    return out.withColumn(name, F.least(n_segments - 1, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_b")


def normalised(header: Column, index: Column, osd: Column, offset: Column, osd_offset: Column, confidence: Column) -> tuple[Column, Column]:
    """(normalised time, its confidence): header, else index at 0.9, else overlay at 0.7, else null at 0."""
    time = F.when(offset.isNull(), None).when(header.isNotNull(), header - offset).when(index.isNotNull(), index - offset).when(osd.isNotNull(), osd - osd_offset)
    trust = F.when(offset.isNull(), 0.0).when(header.isNotNull(), confidence).when(index.isNotNull(), 0.9 * confidence).when(osd.isNotNull(), 0.7 * confidence).otherwise(0.0)
    return time, F.round(trust, 6)


def interpolated(rows: DataFrame, keys: list[str], place: str, ts: str, confidence: str) -> DataFrame:
    """Missing times between known ones by place, linearly (0.3); at the edges carried (0.15); none known: null (0)."""
    w = Window.partitionBy(*keys).orderBy(place)
    known = F.when(F.col(ts).isNotNull(), F.struct(F.col(place).alias("p"), F.col(ts).alias("t")))
    out = rows.withColumn("_k", known)
    out = out.withColumn("_a", F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_z", F.first("_k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    a, z = F.col("_a"), F.col("_z")
    between = a["t"] + (F.col(place) - a["p"]) / (z["p"] - a["p"]) * (z["t"] - a["t"])
    time = F.when(F.col(ts).isNotNull(), F.col(ts)).when(a.isNotNull() & z.isNotNull(), F.bround(between, 0).cast("long")).otherwise(F.coalesce(a["t"], z["t"]))
    trust = F.when(F.col(ts).isNotNull(), F.col(confidence)).when(a.isNotNull() & z.isNotNull(), 0.3).when(a.isNotNull() | z.isNotNull(), 0.15).otherwise(0.0)
    return out.withColumn("_t", time).withColumn("_c", trust).drop(ts, confidence, "_k", "_a", "_z").withColumnsRenamed({"_t": ts, "_c": confidence})


def model_confidence(has_seizure: Column, has_logs: Column, agrees: Column, jumps: Column) -> Column:
    """0.5 with a seizure reading, else 0.2; 0.2 more for logs and for agreement; 0.2 less a jump; within 0 and 1."""
    raw = F.when(has_seizure, 0.5).otherwise(0.2) + F.when(has_logs, 0.2).otherwise(0.0) + F.when(agrees, 0.2).otherwise(0.0) - 0.2 * jumps
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6)


def with_model(frames: DataFrame, models: DataFrame, channel: str, cols: list[str]) -> DataFrame:
    """Each frame with the model of its channel, else that of no channel."""
    own = models.where(F.col(channel).isNotNull()).select(F.col(channel).alias("_c"), *(F.col(c).alias(f"_own_{c}") for c in cols), F.lit(True).alias("_has"))
    least = models.where(F.col(channel).isNull()).agg(F.min(F.struct(*cols)).alias("m"))  # one row; the least if there are several
    rest = least.select(*(F.col("m").getField(c).alias(f"_all_{c}") for c in cols))
    out = frames.join(own, frames[channel] == own["_c"], "left").join(rest, F.lit(True), "left")
    return out.select(*frames.columns, *(F.when(F.col("_has"), F.col(f"_own_{c}")).otherwise(F.col(f"_all_{c}")).alias(c) for c in cols))
