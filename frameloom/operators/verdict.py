"""Why recordings vanished: runs of deleted frames, what the logs say, wrap-around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.intervals import asof, nearest_within
from frameloom.operators.islands import gap_runs


def deleted_runs(runs: DataFrame, channel: str, ts: str, place: str, length: str) -> DataFrame:
    """One row a run: start, end, frames, bytes."""
    return runs.groupBy(channel, "run").agg(F.min(ts).alias("start_us"), F.max(ts).alias("end_us"), F.count("*").alias("n_frames"), F.sum(length).alias("n_bytes"), F.min(place).alias("first_place"))


def verdicts(spans: DataFrame, live: DataFrame, logs: DataFrame, channel: str, reach: int, caution: int, expiry_gap: int) -> DataFrame:
    """Method, actor evidence and confidence for each deleted span.

    The log nearest to the middle of the span within ``reach`` decides if it records
    formatting (0.7). Else the gap from the span's end to the earliest live start of its channel: up to
    ``expiry_gap`` is expiry (0.5, 0.1 more if the log is a logout), also where
    negative; the rest is format (0.5). A clock change within ``caution`` costs 0.1.
    Format findings of one action time on two or more channels share the earliest start.

    ``logs``: log_id, log_ts, log_kind. ``live``: channel, live_start.
    """
    ids = spans.withColumn("span_id", F.concat_ws("-", F.col(channel).cast("string"), F.col("run").cast("string"))).withColumn("mid_us", F.floor((F.col("start_us") + F.col("end_us")) / 2).cast("long"))
    keys = ids.select("span_id", "mid_us")
    nearest = nearest_within(keys, logs, "span_id", "mid_us", "log_ts", ["log_ts", "log_id"], reach).select("span_id", "log_id", "log_ts", "log_kind")
    change = nearest_within(keys, logs.where("log_kind = 'time_change'"), "span_id", "mid_us", "log_ts", ["log_ts", "log_id"], caution).select("span_id", F.lit(True).alias("cautious"))
    first = live.groupBy(channel).agg(F.min("live_start").alias("live_us"))
    out = ids.join(nearest, "span_id", "left").join(change, "span_id", "left").join(first, channel, "left")
    gap = F.col("live_us") - F.col("end_us")
    formatted = F.coalesce(F.col("log_kind") == "hdd_format", F.lit(False))
    expired = ~formatted & F.coalesce(gap <= expiry_gap, F.lit(False))
    score = F.when(formatted, 0.7).when(expired & (F.col("log_kind") == "logout"), 0.6).otherwise(0.5) - F.when(F.col("cautious"), 0.1).otherwise(0.0)
    out = out.select(
        channel,
        "span_id",
        "start_us",
        "end_us",
        "n_frames",
        "n_bytes",
        F.when(expired, "expiry").otherwise("format").alias("method"),
        F.when(formatted, F.col("log_ts")).alias("action_us"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)), 2).alias("confidence"),
    )
    return shared_start(out, channel)


def shared_start(findings: DataFrame, channel: str, keys: list[str] | None = None) -> DataFrame:
    """Format findings of one action on two or more channels begin at the earliest of their starts, within ``keys``."""
    keys = keys or []
    counted = findings.where((F.col("method") == "format") & F.col("action_us").isNotNull())
    actions = counted.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col("action_us").alias("_action")).agg(F.min("start_us").alias("_first"), F.min(channel).alias("_c0"), F.max(channel).alias("_c1")).where("_c0 <> _c1")
    same = (F.col("method") == "format") & (F.col("action_us") == F.col("_action"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    out = findings.join(actions, same, "left")
    return out.withColumn("start_us", F.coalesce("_first", "start_us")).select(*findings.columns)


def wraparound(recordings: DataFrame, keys: list[str], id_: str, start: str, end: str, place: str) -> DataFrame:
    """Channels of two or more live recordings whose lowest on disk is not their earliest: the disk has wrapped.

    lost_from_us estimates the overwritten start: the earliest start less the length of
    the recording that now lies lowest (its start is ``lowest_us``), if that is known.
    """
    rec, low = F.struct(F.col(start), F.col(id_)), F.struct(F.col(place), F.col(start), F.col(id_))
    out = recordings.where(F.col(start).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_live"),
        F.min_by(F.struct(F.col(id_).alias("id"), F.col(start).alias("at"), (F.col(end) - F.col(start)).alias("len")), low).alias("_low"),
        F.min_by(id_, rec).alias("earliest_id"),
        F.min(start).alias("earliest_us"),
    )
    wrapped = out.where((F.col("n_live") >= 2) & (F.col("_low.id") != F.col("earliest_id")))
    lost = F.col("earliest_us") - F.coalesce("_low.len", F.lit(0))
    return wrapped.select(*keys, "n_live", F.col("_low.id").alias("lowest_id"), F.col("_low.at").alias("lowest_us"), "earliest_id", "earliest_us", lost.alias("lost_from_us"), F.lit(0.4).alias("confidence"))


def _beside(rows: DataFrame, logs: DataFrame, image: str, at: Column, low: Column, high: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the log (log_ts, log_id, user) nearest to ``at`` among those in [low, high]; ties go to the earlier one.

    Logs on either side of ``at`` come by one as-of pass each, so any length of span costs the same.
    """
    once = logs.groupBy(image, "log_ts").agg(F.min(F.struct("log_id", "user")).alias("_l"))
    hit = F.struct("log_ts", "_l.log_id", "_l.user")
    cols = rows.columns
    before = asof(rows.withColumn("_at", at), once.withColumn("_at", F.col("log_ts")), [image], "_at", hit, "_b")
    both = asof(before.withColumn("_at", -at), once.withColumn("_at", -F.col("log_ts")), [image], "_at", hit, "_n")
    b, n = (F.when(F.col(f"{c}.log_ts").between(low, high), F.col(c)) for c in ("_b", "_n"))
    nearer = F.when(n.isNull() | (at - b["log_ts"] <= n["log_ts"] - at), F.coalesce(b, n)).otherwise(n)
    return both.select(*cols, nearer.alias(name))


def findings(frames: DataFrame, recordings: DataFrame, logs: DataFrame, image: str, channel: str, gap: int, expiry_gap: int, reach: int, caution: int) -> DataFrame:
    """One finding for each channel of an image that has recordings, with the reasons for it.

    Direct evidence is all deleted frames of a channel that have a time. A formatting log within
    ``reach`` of the stretch from their end to the channel's earliest live start decides (0.7, the log's user);
    else up to ``expiry_gap`` to that start, also where negative, is expiry (0.5; 0.6 and the user of a logout within
    ``reach`` of the end), the rest format (0.5). A clock change within ``caution`` of the frames costs 0.1. Format findings of
    one action of an image start together. Channels without direct evidence are looked at for wrap-around.

    ``frames``: deleted, ts_us, off, payload_len. ``recordings``: recording_id, deleted, start_us, end_us, place.
    ``logs``: log_id, log_ts, log_kind, user. ``evidence`` lists the frames and recordings behind each finding.
    """
    keys = [image, channel]
    runs = gap_runs(frames.where("deleted AND ts_us IS NOT NULL"), keys, "ts_us", "off", gap)
    spans = runs.groupBy(*keys).agg(
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        F.count("*").alias("n_frames"),
        F.sum("payload_len").alias("n_bytes"),
        (F.max("run") - F.min("run") + 1).alias("_runs"),
        F.min(F.struct("ts_us", "off")).getField("off").alias("_off0"),
        F.max(F.struct("ts_us", "off")).getField("off").alias("_off1"),
    )
    live = recordings.where("NOT deleted")
    spans = spans.join(recordings.select(image).distinct(), image, "left_semi").join(live.groupBy(*keys).agg(F.min("start_us").alias("_live")), keys, "left")
    logs = logs.where(F.col("log_ts").isNotNull())
    end, until = F.col("end_us"), F.coalesce("_live", "end_us")
    middle = F.floor((end + until) / 2).cast("long")
    out = _beside(spans, logs.where("log_kind = 'hdd_format'"), image, middle, end - reach, until + reach, "_format")
    out = _beside(out, logs.where("log_kind = 'logout'"), image, end, end - reach, end + reach, "_logout")
    out = _beside(out, logs.where("log_kind = 'time_change'"), image, end, F.col("start_us") - caution, end + caution, "_change")
    formatted, wait = F.col("_format").isNotNull(), F.col("_live") - end
    expired = ~formatted & F.coalesce(wait <= expiry_gap, F.lit(False))
    out = out.withColumn("method", F.when(expired, "expiry").otherwise("format"))
    score = F.when(formatted, 0.7).when(expired & F.col("_logout").isNotNull(), 0.6).otherwise(0.5) - F.when(F.col("_change").isNotNull(), 0.1).otherwise(0.0)
    reasons = F.array(
        F.format_string("%d deleted frames in %d runs between offsets %d and %d", "n_frames", "_runs", "_off0", "_off1"),
        F.when(formatted, F.format_string("formatting logged at %d (log %s)", "_format.log_ts", F.col("_format.log_id").cast("string")))
        .when(expired, F.format_string("live recording resumes %d us after the last deleted frame, no formatting logged", wait))
        .when(wait.isNull(), F.lit("no live recording is left, nobody logged"))
        .otherwise(F.format_string("live recording resumes only after %d us, nobody logged", wait)),
        F.when(expired & F.col("_logout").isNotNull(), F.format_string("logout at %d (log %s) is weak evidence of an actor", "_logout.log_ts", F.col("_logout.log_id").cast("string"))),
        F.when(F.col("_change").isNotNull(), F.format_string("clock changed at %d (log %s)", "_change.log_ts", F.col("_change.log_id").cast("string"))),
    )
    direct = out.select(
        *keys,
        "start_us",
        "end_us",
        "method",
        F.when(formatted, F.col("_format.user")).when(expired, F.col("_logout.user")).alias("actor"),
        F.when(formatted, F.col("_format.log_ts")).when(expired, F.col("_live")).alias("action_us"),
        "n_frames",
        "n_bytes",
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)), 2).alias("confidence"),
        F.array_compact(reasons).alias("reasons"),
        F.col("start_us").alias("_own"),
    )
    direct = shared_start(direct, channel, [image])
    aligned = F.when(F.col("start_us") < F.col("_own"), F.array(F.lit("start taken from another channel of the same formatting"))).otherwise(F.array().cast("array<string>"))
    direct = direct.withColumn("reasons", F.concat("reasons", aligned)).drop("_own")
    wrapped = wraparound(live, keys, "recording_id", "start_us", "end_us", "place").join(spans.select(*keys), keys, "left_anti")
    why = F.array(F.format_string("recording %s lies lowest though %s is the earliest", F.col("lowest_id").cast("string"), F.col("earliest_id").cast("string")), F.lit("start and end are estimated: nothing of what was overwritten is left"))
    zero = F.lit(0).cast("long")
    return direct.unionByName(wrapped.select(*keys, F.col("lost_from_us").alias("start_us"), F.col("earliest_us").alias("end_us"), F.lit("overwrite").alias("method"), F.lit(None).cast("string").alias("actor"), F.col("lowest_us").alias("action_us"), zero.alias("n_frames"), zero.alias("n_bytes"), "confidence", why.alias("reasons")))


def evidence(found: DataFrame, frames: DataFrame, recordings: DataFrame, image: str, channel: str) -> DataFrame:
    """A row for each deleted frame, or live recording of a wrap-around, behind a finding: image, channel, kind, ref."""
    keys = [image, channel]
    kinds = found.select(*keys, "method")
    of_frames = frames.where("deleted AND ts_us IS NOT NULL").join(kinds.where("method <> 'overwrite'"), keys, "left_semi")
    of_recordings = recordings.where("NOT deleted AND start_us IS NOT NULL").join(kinds.where("method = 'overwrite'"), keys, "left_semi")
    return of_frames.select(*keys, F.lit("frame").alias("kind"), F.col("off").cast("string").alias("ref")).union(of_recordings.select(*keys, F.lit("recording"), F.col("recording_id").cast("string")))


def flags(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))
