"""Filters, pages, lookups and searches over frames, recordings and logs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PAGE_DEFAULT, PAGE_MOST, SEARCH_MOST = 50, 500, 50
DAY_US = 86_400_000_000


def frame_filter(frames: DataFrame, ts: str = "ts_us", from_us: int | None = None, to_us: int | None = None, **equal) -> DataFrame:
    """All given equalities and an inclusive time range; a range leaves out frames without time."""
    conds = [F.col(c) == v for c, v in equal.items() if v is not None]
    if from_us is not None:
        conds.append(F.col(ts) >= from_us)
    if to_us is not None:
        conds.append(F.col(ts) <= to_us)
    return frames.where(reduce(Column.__and__, conds)) if conds else frames


def page(rows: DataFrame, order: list[str], limit: int = PAGE_DEFAULT, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """A page in ascending order, nulls last, and the cursor of the next (None at the end). Raises ValueError on a bad cursor."""
    if cursor is not None and not (cursor.isascii() and cursor.isdigit()):
        raise ValueError("bad cursor")
    at, size = int(cursor or 0), max(1, min(limit, PAGE_MOST))
    ordered = rows.orderBy(*(F.col(c).asc_nulls_last() for c in order))
    more = ordered.offset(at + size).limit(1).count() > 0
    return ordered.offset(at).limit(size), str(at + size) if more else None


def overlapping(rows: DataFrame, start: str, end: str, from_us: int, to_us: int) -> DataFrame:
    """Rows that touch [from, to]; an unknown end or start does not exclude."""
    return rows.where((F.col(end).isNull() | (F.col(end) >= from_us)) & (F.col(start).isNull() | (F.col(start) <= to_us)))


def tolerant(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``; those that rows lack are typed nulls."""
    return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def evidence_search(recordings: DataFrame, logs: DataFrame, detections: DataFrame, motion: DataFrame, channels: list[int] | None = None, from_us: int | None = None, to_us: int | None = None, log_kind: str | None = None, text: str | None = None, detection: str | None = None, motion_min: float | None = None) -> DataFrame:
    """Union of the branches that a filter opens, as (kind, ref, channel).

    Logs with a kind or text, detections with a label, motion with a least score, and
    recordings unless one of log kind, label or score is given. Times bound recordings only; text is looked for
    in the log's kind; given channels leave out rows without one.
    """
    pick = lambda df: df.where(F.col("channel").isin(channels)) if channels else df
    shape = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("ref").cast("string"), F.col("channel").cast("long"))
    out = []
    if log_kind or text:
        rows = logs.where(F.col("log_kind") == log_kind) if log_kind else logs
        out.append(shape(pick(rows.where(F.lower("log_kind").contains(text.lower())) if text else rows), "log"))
    if detection:
        out.append(shape(pick(detections.where(F.col("label") == detection)), "detection"))
    if motion_min is not None:
        out.append(shape(pick(motion.where(F.col("peak_score") >= motion_min)), "motion"))
    if not (log_kind or detection or motion_min is not None):
        rows = recordings
        if from_us is not None:
            rows = rows.where(F.col("end_us") >= from_us)
        if to_us is not None:
            rows = rows.where(F.col("start_us") <= to_us)
        out.append(shape(pick(rows), "recording"))
    return reduce(DataFrame.unionByName, out)


def time_of_day(frames: DataFrame, ts: str, second: int, slack: int = 1) -> DataFrame:
    """Frames whose UTC time of day is within ``slack`` seconds of ``second``; no wrap at midnight."""
    at = F.pmod(F.col(ts), F.lit(DAY_US))
    return frames.where(F.abs(at - second * 1_000_000) <= slack * 1_000_000)


def parsed_datetime(text: Column) -> Column:
    """Epoch microseconds of the first date and time in a text that is on the calendar: year first, day first with hyphens, month first with slashes.

    Each with 24 hours, or 12 and AM or PM; weekdays about it do not matter.
    """
    clock = r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:\s*(AM|PM|am|pm))?"
    shapes = [  # pattern, and the places of year, month and day in it
        (r"([0-9]{4})-([0-9]{2})-([0-9]{2})[ T]" + clock, (1, 2, 3)),
        (r"([0-9]{2})-([0-9]{2})-([0-9]{4})(?:T|\s+)" + clock, (3, 2, 1)),
        (r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\s+" + clock, (3, 1, 2)),
    ]
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")

    def micros(pattern: str, places: tuple[int, int, int]) -> Column:
        g = lambda i: F.regexp_extract(text, pattern, i)
        half, hour = F.upper(g(7)), F.try_to_number(F.lpad(g(4), 2, "0"), F.lit("00")).cast("int")
        hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "PM", 12).otherwise(0))
        year, month, day = (F.lpad(g(i), n, "0") for i, n in zip(places, (4, 2, 2), strict=True))
        stamp = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), g(5), F.lit(":"), g(6))
        return F.when(F.length(g(0)) > 0, F.timestamp_diff("MICROSECOND", epoch, F.try_to_timestamp(stamp).cast("timestamp_ntz")))

    return F.coalesce(*(micros(*shape) for shape in shapes))


def export_selection(frames: DataFrame, recordings: DataFrame, recording_id: str | None = None, channel: int | None = None, from_us: int | None = None, to_us: int | None = None, ts: str = "ts_us") -> DataFrame:
    """The frames of a recording, or of a channel in an inclusive time range.

    KeyError if the recording is not there; ValueError if neither is asked for, or no frame of the channel fits.
    """
    if recording_id is not None:
        if recordings.where(F.col("recording_id") == recording_id).isEmpty():
            raise KeyError(recording_id)
        return frames.where(F.col("recording_id") == recording_id)
    if channel is None:
        raise ValueError("ask for a recording, or for a channel with or without a time range")
    out = frame_filter(frames, ts, from_us, to_us, channel=channel)
    if out.isEmpty():
        raise ValueError("no frames of this channel in this range")
    return out


def judged_sentences(sentences: DataFrame, facts: DataFrame) -> DataFrame:
    """``sentences`` (id, text, evidence_ids) with ``reasons`` why each may not stand, none if it may.

    Without evidence nothing else is checked. Ids that no fact (id, text) has are named; numbers, thousands' commas left out,
    must all stand in the facts that are cited. Sentences meet their facts by id, so neither side is gathered.
    """
    numbers = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))
    cited = sentences.select(F.col("id").alias("_s"), F.explode(F.array_distinct("evidence_ids")).alias("_e"))
    known = facts.select(F.col("id").alias("_f"), numbers(F.col("text")).alias("_n"))
    met = cited.join(known, F.col("_e") == F.col("_f"), "left").groupBy("_s").agg(
        F.sort_array(F.collect_list(F.when(F.col("_f").isNull(), F.col("_e")))).alias("_unknown"), F.flatten(F.collect_list("_n")).alias("_told")
    )  # a sentence cites few
    rows = sentences.join(met, F.col("id") == F.col("_s"), "left")
    bare = F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0
    left = F.sort_array(F.array_except(numbers(F.coalesce("text", F.lit(""))), F.coalesce("_told", F.array().cast("array<string>"))))
    reasons = F.array_compact(
        F.array(
            F.when(bare, "cites nothing"),
            F.when(~bare & (F.size("_unknown") > 0), F.concat(F.lit("cites what is not known: "), F.array_join("_unknown", ", "))),
            F.when(~bare & (F.size(left) > 0), F.concat(F.lit("numbers that no cited fact has: "), F.array_join(left, ", "))),
        )
    )
    return rows.select(*sentences.columns, reasons.alias("reasons"))


def unsupported_numbers(sentence: Column, facts: Column) -> Column:
    """Numbers of a sentence that its facts do not hold."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.array_except(numbers(sentence), numbers(facts))


def payload_refused(payload: Column, most: int) -> Column:
    """Whether a payload is too long or holds what looks like encoded bytes: 64 or more hex or 120 or more base64 characters."""
    return (F.octet_length(payload) > most) | payload.rlike("[0-9a-fA-F]{64,}") | payload.rlike("[A-Za-z0-9+/]{120,}={0,2}")


# Words that no key of a payload may hold.
FORBIDDEN_KEYS = ["frame", "thumb", "image", "img", "pixel", "jpeg", "jpg", "png", "bitmap", "bmp", "video", "rawbytes", "diskbytes", "payloadbytes", "clipbytes"]
#: A string of JSON text, quotes included.
JSON_STRING = r'"(?:[^"\\]|\\.)*"'


def refusal(payload: Column, most_string: int, most_bytes: int) -> Column:
    """Why a JSON payload may not be sent: ``key`` (a forbidden word in a key), ``string`` (a long one of nothing but hex or base64), ``size``; else null.

    Keys are read without case, blanks, hyphens and underscores.
    """
    keys = F.regexp_extract_all(payload, F.lit(f"({JSON_STRING})\\s*:"), F.lit(1))
    strings = F.regexp_extract_all(payload, F.lit(f"({JSON_STRING})"), F.lit(1))
    forbidden = F.exists(keys, lambda k: F.regexp_replace(F.lower(k), r"[_\-\s]", "").rlike("|".join(FORBIDDEN_KEYS)))
    encoded = F.exists(strings, lambda x: (F.char_length(x) > most_string + 2) & x.rlike(r'^"\s*[A-Za-z0-9+/]+={0,2}\s*"$'))
    return F.when(forbidden, "key").when(encoded, "string").when(F.octet_length(payload) > most_bytes, "size")


def over_budget(calls: DataFrame, asked: DataFrame, case: str, cap_total: int, cap_case: int) -> DataFrame:
    """``asked`` (case, estimated) with spent_case and ``refused``: total or case, whichever cap the estimate passes first, or null.

    ``calls``: case, cost. Costs are whole units of currency, say millionths, so that sums are exact.
    """
    by_case = calls.groupBy(case).agg(F.sum("cost").alias("spent_case"))
    total = calls.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("_total"))  # one row
    out = asked.join(by_case, case, "left").withColumn("spent_case", F.coalesce("spent_case", F.lit(0))).join(F.broadcast(total))
    refused = F.when(F.col("_total") + F.col("estimated") > cap_total, "total").when(F.col("spent_case") + F.col("estimated") > cap_case, "case")
    return out.withColumn("refused", refused).drop("_total")


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1)))


def gram_index(rows: DataFrame, ref: str, text: str) -> DataFrame:
    """Postings gram, ref of a text column; write them by gram to search them often."""
    return rows.select(F.explode(grams(F.col(text))).alias("gram"), F.col(ref).alias("ref")).distinct()


def containing(rows: DataFrame, ref: str, text: str, sought: str, index: DataFrame | None = None) -> DataFrame:
    """``rows`` whose text contains ``sought``, without case.

    With an index the postings of all grams of the sought text are intersected, and only rows that hold all of them are
    read; shorter texts than three characters are compared with every row.
    """
    holds = F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(sought.lower()))
    low = sought.lower()
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if index is None or not wanted:
        return rows.where(holds)
    all_of = index.where(F.col("gram").isin(wanted)).groupBy("ref").agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(wanted))
    return rows.join(all_of.select(F.col("ref").alias("_ref")), rows[ref].eqNullSafe(F.col("_ref")), "left_semi").where(holds)


#: Frames at a sought time that each case gives at most.
FRAMES_A_CASE = 5
KINDS = ("case", "evidence", "recording", "finding", "frame")


def global_search(sought: str, cases: DataFrame, evidence: DataFrame, recordings: DataFrame, findings: DataFrame, frames: DataFrame, most: int = SEARCH_MOST) -> DataFrame:
    """kind, id, case_id, label, detail: the first ``most`` hits by case, kind and id.

    cases: case_id, number, title. evidence: id, case_id, path, sha256. recordings: id, case_id, channel, source. findings: id,
    case_id, method, reasons (array). frames: id, case_id, channel, payload_offset, ts_us. A text is looked for without case in
    numbers and titles, paths and ids, recording ids, methods and each reason; a time hh:mm:ss finds frames within a
    second of it on any day, ``FRAMES_A_CASE`` of each case at most.
    """
    low = sought.strip().lower()
    shape = lambda kind, rows, label, detail: rows.select(F.lit(KINDS.index(kind)).alias("_k"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col("case_id").cast("string").alias("case_id"), label.cast("string").alias("label"), detail.cast("string").alias("detail"))
    has = lambda c: F.coalesce(F.contains(F.lower((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(low)), F.lit(False))
    out = shape("case", cases.where(has("number") | has("title")).withColumn("id", F.col("case_id")), F.col("title"), F.col("number"))
    out = out.unionByName(shape("evidence", evidence.where(has("path") | has("id")), F.col("path"), F.concat(F.lit("sha256="), F.substring("sha256", 1, 12), F.lit("…"))))
    out = out.unionByName(shape("recording", recordings.where(has("id")), F.concat(F.lit("channel "), F.col("channel").cast("string")), F.col("source")))
    told = findings.where(has("method") | F.coalesce(F.exists("reasons", has), F.lit(False)))
    out = out.unionByName(shape("finding", told, F.col("method"), F.substring(F.array_join("reasons", "; "), 1, 200)))
    clock = re.fullmatch(r"(\d{1,2}):(\d{2}):(\d{2})", low, re.ASCII)
    if clock:
        h, m, s = map(int, clock.groups())
        near = time_of_day(frames, "ts_us", 3600 * h + 60 * m + s, 1)
        first = Window.partitionBy("case_id").orderBy("channel", "ts_us", "payload_offset")
        near = near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= FRAMES_A_CASE)  # Spark keeps so many a case in each task
        out = out.unionByName(shape("frame", near, F.concat(F.lit("channel "), F.col("channel").cast("string"), F.lit(f" @ {low}")), F.concat(F.lit("payload_offset="), F.col("payload_offset").cast("string"))))
    if not low:
        out = out.where("false")
    return out.orderBy("case_id", "_k", "id").limit(most).drop("_k")
