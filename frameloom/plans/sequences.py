"""Runs, intervals, clocks, motion, verdicts and scans over the tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.operators import clock, custody, islands, motion, segments, stats, timeline, verdict
from frameloom.operators.intervals import complement, nearest_within
from frameloom.plans.registry import query
from frameloom.sources.scratch import stored
from frameloom.sources.tables import FR, REC, H, frames, recordings, table, updated

GAP = 6 * H
_RUN = "CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY channel ORDER BY ts_us, off) > {g} THEN 1 ELSE 0 END".format(g=GAP)
_STRICT = FR + f", f1 AS (SELECT *, {_RUN} AS b FROM fr WHERE ts_us IS NOT NULL), runs AS (SELECT *, sum(b) OVER (PARTITION BY channel ORDER BY ts_us, off) AS run FROM f1)"


@query("gap_runs_strict", f"WITH {_STRICT} SELECT channel, CAST(run AS BIGINT) AS run, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n, CAST(sum(payload_len) AS BIGINT) AS bytes FROM runs GROUP BY channel, run")
def gap_runs_strict(spark, sf):
    runs = islands.gap_runs(frames(spark, sf), ["channel"], "ts_us", "off", GAP)
    return runs.groupBy("channel", "run").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n"), F.sum("payload_len").alias("bytes"))


def _nullsafe(fill: int) -> str:
    o = f"PARTITION BY channel ORDER BY coalesce(ts_us, {fill}), off"
    return FR + f", f1 AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER ({o}) > {GAP} THEN 1 ELSE 0 END AS b FROM fr), runs AS (SELECT *, CAST(sum(b) OVER ({o}) AS BIGINT) AS run FROM f1)"


@query("gap_runs_nullsafe", f"WITH {_nullsafe(-1)} SELECT channel, run, count(*) AS n, count(ts_us) AS n_timed, min(off) AS first_off FROM runs GROUP BY channel, run")
def gap_runs_nullsafe(spark, sf):
    runs = islands.gap_runs(frames(spark, sf), ["channel"], "ts_us", "off", GAP, nulls="keep")
    return runs.groupBy("channel", "run").agg(F.count("*").alias("n"), F.count("ts_us").alias("n_timed"), F.min("off").alias("first_off"))


@query("run_live_vs_deleted", f"WITH {_nullsafe(0)}, g AS (SELECT channel, run, min(ts_us) AS start_us, count(*) AS n FROM runs GROUP BY 1, 2) SELECT *, run <> max(run) OVER (PARTITION BY channel) AS deleted FROM g")
def run_live_vs_deleted(spark, sf):
    runs = islands.gap_runs(frames(spark, sf), ["channel"], "ts_us", "off", GAP, nulls="keep", fill=0)
    out = runs.groupBy("channel", "run").agg(F.min("ts_us").alias("start_us"), F.count("*").alias("n"))
    return out.withColumn("deleted", F.col("run") != F.max("run").over(Window.partitionBy("channel")))


_CARVED = FR + (
    f", c AS (SELECT channel, off, kind, CASE WHEN off % 17 = 0 THEN ts_us - 30 * {H} ELSE ts_us END AS ts_us FROM fr WHERE source = 'carved'), k AS (SELECT *, last_value(ts_us IGNORE NULLS) OVER (PARTITION BY channel ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c),"
    f" r AS (SELECT *, CAST(sum(CASE WHEN abs(ts_us - p) > {4 * GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY off) AS BIGINT) AS run FROM k),"
    " s AS (SELECT *, max(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY channel, run ORDER BY off) AS s FROM r)"
)


@query("carved_runs", f"WITH {_CARVED} SELECT channel, run, min(off) AS first_off, count(*) AS n FROM s WHERE s = 1 GROUP BY 1, 2")
def carved_runs(spark, sf):
    """Runs by jumps either way in place order; what precedes the first key frame of a run is dropped."""
    rows = frames(spark, sf).where("source = 'carved'").withColumn("ts_us", F.when(F.col("off") % 17 == 0, F.col("ts_us") - 30 * H).otherwise(F.col("ts_us")))
    runs = islands.jump_runs(rows, ["channel"], "ts_us", "off", 4 * GAP)
    kept = islands.from_first(runs, ["channel", "run"], "off", F.col("kind") == "view")
    return kept.groupBy("channel", "run").agg(F.min("off").alias("first_off"), F.count("*").alias("n"))


@query("decode_groups", f"WITH {_CARVED} SELECT channel, CASE WHEN off % 2 = 0 THEN 'rec' ELSE 'carved-' || run END AS grp, count(*) AS n FROM r GROUP BY 1, 2")
def decode_groups(spark, sf):
    rows = frames(spark, sf).where("source = 'carved'").withColumn("ts_us", F.when(F.col("off") % 17 == 0, F.col("ts_us") - 30 * H).otherwise(F.col("ts_us")))
    runs = islands.jump_runs(rows, ["channel"], "ts_us", "off", 4 * GAP)
    name = F.when(F.col("off") % 2 == 0, "rec").otherwise(F.concat(F.lit("carved-"), F.col("run").cast("string")))
    return runs.groupBy("channel", name.alias("grp")).agg(F.count("*").alias("n"))


_COVER = f"sp AS (SELECT channel, ts_us AS s, ts_us + (off % 9) * {H} AS e FROM fr WHERE ts_us IS NOT NULL AND source = 'index')"


def _cover(spark, sf):
    return frames(spark, sf).where("ts_us IS NOT NULL AND source = 'index'").select("channel", F.col("ts_us").alias("s"), (F.col("ts_us") + F.col("off") % 9 * H).alias("e"))


@query(
    "interval_complement",
    f"WITH {FR}, {_COVER}, b AS (SELECT min(s) - {H} AS lo, max(e) + {H} AS hi FROM sp), m AS (SELECT channel, s, e, greatest(lo, coalesce(max(e) OVER (PARTITION BY channel ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS p, hi FROM sp, b)"
    " SELECT channel, p AS gap_start, s AS gap_end FROM m WHERE s > p UNION ALL SELECT channel, max(e), any_value(hi) FROM m GROUP BY channel HAVING max(e) < any_value(hi)",
)
def interval_complement(spark, sf):
    spans = _cover(spark, sf)
    lo, hi = spans.agg(F.min("s") - H, F.max("e") + H).first()
    return complement(spans, ["channel"], "s", "e", F.lit(lo), F.lit(hi))


@query(
    "coverage_merge",
    f"WITH {FR}, {_COVER}, p AS (SELECT *, max(e) OVER (PARTITION BY channel ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sp), g AS (SELECT *, sum(CASE WHEN s - r >= {2 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY s, e) AS g FROM p)"
    " SELECT channel, min(s) AS s, max(e) AS e, count(*) AS n_merged FROM g GROUP BY channel, g",
)
def coverage_merge(spark, sf):
    return islands.merge_close(_cover(spark, sf), ["channel"], "s", "e", 2 * H)


@query("bbox_ranges", "WITH i AS (SELECT user_id AS channel, event_id AS i FROM events WHERE value > 20), g AS (SELECT *, sum(b) OVER (PARTITION BY channel ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY channel ORDER BY i) > 150 THEN 1 ELSE 0 END AS b FROM i)) SELECT channel, min(i) AS first_i, max(i) AS last_i FROM g GROUP BY channel, g")
def bbox_ranges(spark, sf):
    rows = table(spark, sf, "events").where("value > 20").select(F.col("user_id").alias("channel"), F.col("event_id").alias("i"))
    runs = islands.gap_runs(rows.withColumn("t", F.col("i")), ["channel"], "t", "i", 150)
    return runs.groupBy("channel", "run").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i")).drop("run")


@query(
    "nearest_log_correlation",
    f"WITH {FR}, l AS (SELECT off AS log_id, ts_us AS log_ts, kind AS log_kind FROM fr WHERE ts_us IS NOT NULL AND kind IN ('signup', 'error')), q AS (SELECT off AS qid, ts_us + 7 AS mid FROM fr WHERE ts_us IS NOT NULL AND kind = 'purchase'),"
    f" m AS (SELECT qid, log_id, log_kind, row_number() OVER (PARTITION BY qid ORDER BY abs(log_ts - mid), log_ts, log_id) AS r FROM q JOIN l ON log_ts BETWEEN mid - {H} AND mid + {H}) SELECT qid, log_id, log_kind FROM m WHERE r = 1",
)
def nearest_log_correlation(spark, sf):
    fr = frames(spark, sf).where("ts_us IS NOT NULL")
    logs = fr.where("kind IN ('signup', 'error')").select(F.col("off").alias("log_id"), F.col("ts_us").alias("log_ts"), F.col("kind").alias("log_kind"))
    asks = fr.where("kind = 'purchase'").select(F.col("off").alias("qid"), (F.col("ts_us") + 7).alias("at"))
    return nearest_within(asks, logs, "qid", "at", "log_ts", ["log_ts", "log_id"], H).select("qid", "log_id", "log_kind")


_CH = "ch AS (SELECT channel, off, ts_us + (off % 7) * {h} AS old_us, ts_us + (off % 7) * {h} + CASE WHEN off % 2 = 0 THEN -{h} ELSE {h} // 2 END AS new_us FROM fr WHERE kind = 'signup' AND ts_us IS NOT NULL)".format(h=H)


def _changes(spark, sf):
    old = F.col("ts_us") + F.col("off") % 7 * H
    fr = frames(spark, sf).where("kind = 'signup' AND ts_us IS NOT NULL")
    return fr.select("channel", old.alias("old_us"), (old + F.when(F.col("off") % 2 == 0, -H).otherwise(H // 2)).alias("new_us"))


_SEG = _CH + (
    ", w AS (SELECT channel, old_us, new_us, lag(new_us) OVER x AS from_us, 312000000 - sum(new_us - old_us) OVER (PARTITION BY channel ORDER BY old_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS o, row_number() OVER x AS i, count(*) OVER (PARTITION BY channel) AS n FROM ch WINDOW x AS (PARTITION BY channel ORDER BY old_us)),"
    " seg AS (SELECT channel, from_us, old_us AS to_us, CAST(o AS BIGINT) AS offset_us, i - 1 AS i FROM w UNION ALL SELECT channel, new_us, NULL, 312000000, i FROM w WHERE i = n)"
)


@query("clock_segments", f"WITH {FR}, {_SEG} SELECT * FROM seg")
def clock_segments(spark, sf):
    return clock.segments(_changes(spark, sf), ["channel"], F.lit(312_000_000)).select("channel", "from_us", "to_us", "offset_us", "i")


@query(
    "segment_lookup",
    f"WITH {FR}, {_SEG}, q AS (SELECT channel, off, ts_us FROM fr WHERE ts_us IS NOT NULL), b AS (SELECT channel, min(from_us) AS s0, count(*) AS n FROM seg GROUP BY 1),"
    " hit AS (SELECT q.channel, q.off, arg_min(seg.i, {'d': least(coalesce(abs(q.ts_us - from_us), 9000000000000000000), coalesce(abs(q.ts_us - to_us), 9000000000000000000)), 'i': seg.i}) AS i FROM q JOIN seg ON q.channel = seg.channel AND (from_us IS NULL OR from_us <= q.ts_us) AND (to_us IS NULL OR q.ts_us < to_us) GROUP BY 1, 2)"
    " SELECT q.channel, q.off, CAST(coalesce(hit.i, CASE WHEN q.ts_us < s0 THEN 0 ELSE n - 1 END) AS BIGINT) AS segment FROM q LEFT JOIN b ON q.channel = b.channel LEFT JOIN hit ON q.off = hit.off",
)
def segment_lookup(spark, sf):
    segs = clock.segments(_changes(spark, sf), ["channel"], F.lit(312_000_000))
    models = segs.groupBy("channel").agg(F.sort_array(F.collect_list(F.struct("i", "from_us", "to_us"))).alias("segs"))
    fr = frames(spark, sf).where("ts_us IS NOT NULL")
    return fr.join(models, "channel", "left").select("channel", "off", clock.segment_of(F.col("ts_us"), F.col("segs")).cast("long").alias("segment"))


@query(
    "chrono_segment",
    f"WITH {FR}, j AS (SELECT channel, off, CASE WHEN off > 600 THEN ts_us - 400 * {H} ELSE ts_us END AS ts_us FROM fr WHERE ts_us IS NOT NULL), h AS (SELECT *, max(ts_us) OVER (PARTITION BY channel ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hw FROM j)"
    " SELECT channel, off, least(1, CAST(sum(CASE WHEN ts_us < hw - 5000000 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY off) AS BIGINT)) AS segment FROM h",
)
def chrono_segment(spark, sf):
    fr = frames(spark, sf).where("ts_us IS NOT NULL").withColumn("ts_us", F.when(F.col("off") > 600, F.col("ts_us") - 400 * H).otherwise(F.col("ts_us")))
    return clock.chronological(fr, ["channel"], "ts_us", "off", F.lit(2)).select("channel", "off", F.col("segment").cast("long").alias("segment"))


_TIER = (
    "t AS (SELECT channel, off, ts_us AS h, CASE WHEN off % 4 <> 0 THEN epoch END AS x, CASE WHEN off % 3 <> 0 THEN epoch + 37000000 END AS o, CASE WHEN channel % 10 <> 0 THEN 1000000 * (channel % 5) END AS off_us, 0.9 - 0.1 * (channel % 3) AS conf FROM (SELECT fr.*, epoch_us(e.ts) AS epoch FROM fr JOIN events e ON e.event_id = fr.off)),"
    " nz AS (SELECT channel, off, CASE WHEN off_us IS NULL THEN NULL WHEN h IS NOT NULL THEN h - off_us WHEN x IS NOT NULL THEN x - off_us WHEN o IS NOT NULL THEN o - 37000000 END AS ts_norm_us, CASE WHEN off_us IS NULL THEN 0.0 WHEN h IS NOT NULL THEN conf WHEN x IS NOT NULL THEN 0.9 * conf WHEN o IS NOT NULL THEN 0.7 * conf ELSE 0.0 END AS c FROM t)"
)


def _tiers(spark, sf):
    from frameloom.sources.tables import micros

    e = table(spark, sf, "events").select(F.col("user_id").alias("channel"), F.col("event_id").alias("off"), micros(F.col("ts")).alias("epoch"))
    off, ch = F.col("off"), F.col("channel")
    offset = F.when(ch % 10 != 0, 1_000_000 * (ch % 5))
    time, trust = clock.normalised(F.when(off % 11 != 0, F.col("epoch")), F.when(off % 4 != 0, F.col("epoch")), F.when(off % 3 != 0, F.col("epoch") + 37_000_000), offset, F.lit(37_000_000), 0.9 - 0.1 * (ch % 3))
    return e.select("channel", "off", time.alias("ts_norm_us"), trust.alias("norm_confidence"))


@query("normalise_tiers", f"WITH {FR}, {_TIER} SELECT channel, off, ts_norm_us, CAST(round(c, 6) AS DOUBLE) AS norm_confidence FROM nz")
def normalise_tiers(spark, sf):
    return _tiers(spark, sf)


@query(
    "interpolate_missing",
    f"WITH {FR}, g AS (SELECT channel, off, CASE WHEN channel % 9 <> 0 OR off % 2 = 0 THEN ts_us END AS t FROM fr), k AS (SELECT *, max(CASE WHEN t IS NOT NULL THEN off END) OVER (PARTITION BY channel ORDER BY off) AS a, min(CASE WHEN t IS NOT NULL THEN off END) OVER (PARTITION BY channel ORDER BY off ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM g)"
    " SELECT k.channel, k.off, CASE WHEN k.t IS NOT NULL THEN k.t WHEN pa.t IS NOT NULL AND pz.t IS NOT NULL THEN CAST(round_even(pa.t + (k.off - a) / (z - a) * (pz.t - pa.t), 0) AS BIGINT) ELSE coalesce(pa.t, pz.t) END AS ts_us,"
    " CASE WHEN k.t IS NOT NULL THEN 0.9 WHEN pa.t IS NOT NULL AND pz.t IS NOT NULL THEN 0.3 WHEN pa.t IS NOT NULL OR pz.t IS NOT NULL THEN 0.15 ELSE 0.0 END::DOUBLE AS conf FROM k LEFT JOIN g pa ON pa.off = k.a LEFT JOIN g pz ON pz.off = k.z",
)
def interpolate_missing(spark, sf):
    rows = frames(spark, sf).select("channel", "off", F.expr("CASE WHEN channel % 9 <> 0 OR off % 2 = 0 THEN ts_us END").alias("ts_us"), F.lit(0.9).alias("conf"))
    return clock.interpolated(rows, ["channel"], "off", "ts_us", "conf").select("channel", "off", "ts_us", "conf")


@query("model_fallback", f"WITH {FR}, m AS (SELECT c AS channel, CAST(c * 1000 AS BIGINT) AS offset_us FROM range(1, 51) r(c)) SELECT fr.channel, count(*) AS n, max(coalesce(m.offset_us, 77)) AS offset_us FROM fr LEFT JOIN m ON fr.channel = m.channel GROUP BY 1")
def model_fallback(spark, sf):
    models = spark.range(1, 51).select(F.col("id").alias("channel"), (F.col("id") * 1000).alias("offset_us")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS channel, 77L AS offset_us"))
    out = clock.with_model(frames(spark, sf).select("channel", "off"), models, "channel", ["offset_us"])
    return out.groupBy("channel").agg(F.count("*").alias("n"), F.max("offset_us").alias("offset_us"))


@query("clock_confidence", "SELECT c AS channel, round(greatest(0, least(1, CASE WHEN c % 2 = 0 THEN 0.5 ELSE 0.2 END + CASE WHEN c % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN c % 5 = 0 THEN 0.2 ELSE 0 END - 0.2 * (c % 4))), 6)::DOUBLE AS confidence FROM (SELECT DISTINCT user_id AS c FROM events)")
def clock_confidence(spark, sf):
    c = F.col("user_id")
    return table(spark, sf, "events").select("user_id").distinct().select(c.alias("channel"), clock.model_confidence(c % 2 == 0, c % 3 == 0, c % 5 == 0, c % 4).alias("confidence"))


@query("frame_update", f"WITH {FR} SELECT off, coalesce(CASE WHEN off % 6 = 0 THEN off * 2 END, payload_len) AS payload_len FROM fr")
def frame_update(spark, sf):
    fr = frames(spark, sf).select("off", "payload_len")
    return updated(fr, fr.where("off % 6 = 0").select("off", (F.col("off") * 2).alias("payload_len")), "off")


@query("sample_thinning", f"WITH RECURSIVE {FR}, t AS (SELECT channel, ts_us, row_number() OVER (PARTITION BY channel ORDER BY ts_us) AS i FROM fr WHERE ts_us IS NOT NULL), r AS (SELECT channel, i, ts_us, ts_us AS last, true AS keep FROM t WHERE i = 1 UNION ALL SELECT t.channel, t.i, t.ts_us, CASE WHEN t.ts_us - r.last >= {36 * H} THEN t.ts_us ELSE r.last END, t.ts_us - r.last >= {36 * H} FROM r JOIN t ON t.channel = r.channel AND t.i = r.i + 1), k AS (SELECT channel, ts_us, row_number() OVER (PARTITION BY channel ORDER BY ts_us) - 1 AS p, count(*) OVER (PARTITION BY channel) AS n FROM r WHERE keep) SELECT channel, ts_us FROM k WHERE n <= 20 OR p IN (SELECT (i * n) // 20 FROM range(20) s(i))")
def sample_thinning(spark, sf):
    return islands.thinned(frames(spark, sf), ["channel"], "ts_us", 36 * H, 20)


@query("frame_difference", f"WITH {FR} SELECT channel, off, round(coalesce(abs(value - lag(value) OVER w), abs(lead(value) OVER w - value), 0), 6) AS diff FROM fr WINDOW w AS (PARTITION BY channel ORDER BY off)")
def frame_difference(spark, sf):
    w = Window.partitionBy("channel").orderBy("off")
    v = F.col("value")
    return frames(spark, sf).select("channel", "off", F.round(F.coalesce(F.abs(v - F.lag("value").over(w)), F.abs(F.lead("value").over(w) - v), F.lit(0.0)), 6).alias("diff"))


_Z = FR + (
    ", zz AS (SELECT channel, off, ts_us, value, median(value) OVER w AS m, list(value) OVER w AS l, avg(value) OVER c AS a, stddev_pop(value) OVER c AS s FROM fr WINDOW w AS (PARTITION BY channel ORDER BY off ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), c AS (PARTITION BY channel)),"
    " z2 AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - m)), 'median') AS mad FROM zz), z AS (SELECT channel, off, ts_us, value, CASE WHEN mad > 0 THEN (value - m) / (1.4826 * mad) WHEN s > 0 THEN (value - a) / s ELSE 0 END AS z FROM z2)"
)


@query("rolling_robust_z", f"WITH {_Z} SELECT channel, off, round(z, 6) AS z FROM z")
def rolling_robust_z(spark, sf):
    return stats.rolling_robust_z(frames(spark, sf), ["channel"], "off", "value", 5).select("channel", "off", F.round("z", 6).alias("z"))


_MOT = _Z + (
    ", f AS (SELECT *, z > 0.5 AND value >= 10 AS f, row_number() OVER (PARTITION BY channel ORDER BY off) AS i FROM z), g AS (SELECT *, sum(CASE WHEN f IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY off) AS g FROM (SELECT *, lag(f) OVER (PARTITION BY channel ORDER BY off) AS p FROM f)),"
    " r AS (SELECT channel, g, min(off) AS o0, max(off) AS o1, min(i) AS i0, max(i) AS i1 FROM g WHERE f GROUP BY 1, 2),"
    " r2 AS (SELECT r.channel, a.ts_us AS s, b.ts_us AS e, i0, i1 FROM r JOIN g a ON a.off = r.o0 JOIN g b ON b.off = r.o1 WHERE a.ts_us IS NOT NULL AND b.ts_us IS NOT NULL),"
    f" m AS (SELECT *, sum(CASE WHEN s - pe < {12 * H} THEN 0 ELSE 1 END) OVER (PARTITION BY channel ORDER BY i0) AS mg FROM (SELECT *, lag(e) OVER (PARTITION BY channel ORDER BY i0) AS pe FROM r2)),"
    f" sp AS (SELECT channel, mg, arg_min(s, i0) AS start_us, arg_max(e, i0) AS end_us, min(i0) AS i0, max(i1) AS i1 FROM m GROUP BY 1, 2 HAVING arg_max(e, i0) - arg_min(s, i0) >= {H}),"
    " mo AS (SELECT sp.channel, start_us, end_us, max(g.z) AS peak, i1 - i0 + 1 AS n_rows FROM sp JOIN g ON g.channel = sp.channel AND g.i BETWEEN sp.i0 AND sp.i1 GROUP BY sp.channel, start_us, end_us, i0, i1)"
)


def _motion(spark, sf):
    z = stats.rolling_robust_z(frames(spark, sf), ["channel"], "off", "value", 5)
    return motion.motion_segments(z, ["channel"], "off", "ts_us", "z", "value", 0.5, 10, 12 * H, H)


@query("motion_segments", f"WITH {_MOT} SELECT channel, start_us, end_us, round(peak, 6) AS peak, n_rows FROM mo")
def motion_segments(spark, sf):
    return _motion(spark, sf).withColumn("peak", F.round("peak", 6))


@query("comotion_pairs", f"WITH {_MOT} SELECT a.channel AS a, b.channel AS b, least(a.start_us, b.start_us) AS start_us, greatest(a.end_us, b.end_us) AS end_us FROM mo a JOIN mo b ON a.channel < b.channel AND b.start_us <= a.end_us + 2000000 AND b.end_us >= a.start_us - 2000000")
def comotion_pairs(spark, sf):
    return motion.comotion(_motion(spark, sf), "channel", "start_us", "end_us", 2_000_000, 24 * H)


_DEL = FR + (
    f", dl AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY channel ORDER BY ts_us, off) > {8 * GAP} THEN 1 ELSE 0 END AS b FROM fr WHERE deleted AND ts_us IS NOT NULL),"
    " dr AS (SELECT *, CAST(sum(b) OVER (PARTITION BY channel ORDER BY ts_us, off) AS BIGINT) AS run FROM dl),"
    " sp AS (SELECT channel, channel || '-' || run AS span_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_frames, CAST(sum(payload_len) AS BIGINT) AS n_bytes FROM dr GROUP BY channel, run),"
    " q AS (SELECT *, (start_us + end_us) // 2 AS mid FROM sp), lg AS (SELECT off AS log_id, ts_us AS log_ts, CASE kind WHEN 'signup' THEN 'hdd_format' WHEN 'error' THEN 'time_change' ELSE 'logout' END AS log_kind FROM fr WHERE ts_us IS NOT NULL AND kind IN ('signup', 'error', 'purchase')),"
    f" nl AS (SELECT span_id, log_ts, log_kind FROM (SELECT span_id, log_ts, log_kind, row_number() OVER (PARTITION BY span_id ORDER BY abs(log_ts - mid), log_ts, log_id) AS r FROM q JOIN lg ON abs(log_ts - mid) <= {3 * H}) WHERE r = 1),"
    f" tc AS (SELECT DISTINCT span_id FROM q JOIN lg ON abs(log_ts - mid) <= {H} AND log_kind = 'time_change'),"
    " lv AS (SELECT channel, min(ts_us) AS live_us FROM fr WHERE NOT deleted AND ts_us IS NOT NULL GROUP BY 1),"
    f" v AS (SELECT q.channel, q.span_id, start_us, end_us, n_frames, n_bytes, CASE WHEN coalesce(log_kind = 'hdd_format', false) THEN 'format' WHEN live_us - end_us <= {300 * H} THEN 'expiry' ELSE 'format' END AS method, CASE WHEN log_kind = 'hdd_format' THEN log_ts END AS action_us,"
    f" round(greatest(0, least(0.99, CASE WHEN coalesce(log_kind = 'hdd_format', false) THEN 0.7 WHEN live_us - end_us <= {300 * H} AND log_kind = 'logout' THEN 0.6 ELSE 0.5 END - CASE WHEN tc.span_id IS NOT NULL THEN 0.1 ELSE 0 END)), 2)::DOUBLE AS confidence"
    " FROM q LEFT JOIN nl ON q.span_id = nl.span_id LEFT JOIN tc ON q.span_id = tc.span_id LEFT JOIN lv ON q.channel = lv.channel),"
    " sh AS (SELECT method, action_us, min(start_us) AS s, count(DISTINCT channel) AS n FROM v GROUP BY 1, 2)"
)


@query("deletion_verdict", f"WITH {_DEL} SELECT v.channel, span_id, CASE WHEN v.method = 'format' AND v.action_us IS NOT NULL AND n >= 2 THEN s ELSE start_us END AS start_us, end_us, n_frames, n_bytes, v.method, v.action_us, confidence FROM v JOIN sh ON v.method = sh.method AND v.action_us IS NOT DISTINCT FROM sh.action_us")
def deletion_verdict(spark, sf):
    fr = frames(spark, sf)
    runs = islands.gap_runs(fr.where("deleted"), ["channel"], "ts_us", "off", 8 * GAP)
    spans = verdict.deleted_runs(runs, "channel", "ts_us", "off", "payload_len")
    kind = F.when(F.col("kind") == "signup", "hdd_format").when(F.col("kind") == "error", "time_change").otherwise("logout")
    logs = fr.where("ts_us IS NOT NULL AND kind IN ('signup', 'error', 'purchase')").select(F.col("off").alias("log_id"), F.col("ts_us").alias("log_ts"), kind.alias("log_kind"))
    live = fr.where("NOT deleted AND ts_us IS NOT NULL").select("channel", F.col("ts_us").alias("live_start"))
    return verdict.verdicts(spans, live, logs, "channel", 3 * H, H, 300 * H)


@query("shared_min_alignment", "WITH f AS (SELECT event_id AS id, user_id AS channel, epoch_us(ts) AS start_us, CASE WHEN event_id % 2 = 0 THEN 'format' ELSE 'expiry' END AS method, CASE WHEN event_id % 3 <> 0 THEN event_id // 40 END AS action_us FROM events), g AS (SELECT method, action_us, min(start_us) AS s, count(DISTINCT channel) AS n FROM f GROUP BY 1, 2) SELECT id, CASE WHEN f.method = 'format' AND f.action_us IS NOT NULL AND n >= 2 THEN s ELSE start_us END AS start_us FROM f JOIN g ON f.method = g.method AND f.action_us IS NOT DISTINCT FROM g.action_us")
def shared_min_alignment(spark, sf):
    from frameloom.sources.tables import micros

    i = F.col("event_id")
    f = table(spark, sf, "events").select(i.alias("id"), F.col("user_id").alias("channel"), micros(F.col("ts")).alias("start_us"), F.when(i % 2 == 0, "format").otherwise("expiry").alias("method"), F.when(i % 3 != 0, F.expr("event_id div 40")).alias("action_us"))
    return verdict.shared_start(f, "channel").select("id", "start_us")


@query("wraparound", f"WITH {REC}, p AS (SELECT *, (first_off * 7919) % 1009 AS place FROM rec WHERE NOT deleted AND start_us IS NOT NULL), w AS (SELECT channel, count(*) AS n_live, arg_min(recording_id, {{'p': place, 's': start_us, 'r': recording_id}}) AS lowest_id, arg_min(recording_id, {{'p': start_us, 'r': recording_id}}) AS earliest_id, min(start_us) AS e0, arg_min(end_us - start_us, {{'p': place, 's': start_us, 'r': recording_id}}) AS len FROM p GROUP BY 1) SELECT channel, n_live, lowest_id, earliest_id, e0 - len AS lost_from_us, 0.4::DOUBLE AS confidence FROM w WHERE n_live >= 2 AND lowest_id <> earliest_id")
def wraparound(spark, sf):
    rec = recordings(frames(spark, sf)).where("NOT deleted").withColumn("place", F.col("first_off") * 7919 % 1009)
    return verdict.wraparound(rec, ["channel"], "recording_id", "start_us", "end_us", "place").drop("lowest_us", "earliest_us")


_FIND = (
    FR
    + ", fd AS (SELECT channel % 8 AS image_id, * REPLACE (deleted AND channel % 3 <> 0 AS deleted) FROM fr),"
    + " rc AS (SELECT channel % 8 AS image_id, recording_id, channel, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) FILTER (deleted) * 4 > count(*) AS deleted, (min(off) * 7919) % 1009 AS place FROM fd GROUP BY 1, 2, 3),"
    + " lg AS (SELECT image_id, off AS log_id, ts_us AS log_ts, CASE kind WHEN 'signup' THEN 'hdd_format' WHEN 'error' THEN 'time_change' ELSE 'logout' END AS log_kind, 'u' || channel AS usr FROM fd WHERE ts_us IS NOT NULL AND kind IN ('signup', 'error', 'purchase')),"
    + f" g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY channel ORDER BY ts_us, off) > {8 * GAP} THEN 1 ELSE 0 END AS b FROM fd WHERE deleted AND ts_us IS NOT NULL),"
    + " lv AS (SELECT channel, min(start_us) AS live_us FROM rc WHERE NOT deleted GROUP BY 1),"
    + " q AS (SELECT image_id, g.channel, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_frames, CAST(sum(payload_len) AS BIGINT) AS n_bytes, 1 + sum(b) AS n_runs, any_value(live_us) AS live_us FROM g LEFT JOIN lv ON g.channel = lv.channel GROUP BY 1, 2),"
    + " q2 AS (SELECT *, coalesce(live_us, end_us) AS until, (end_us + coalesce(live_us, end_us)) // 2 AS mid FROM q),"
    + f" fm AS (SELECT channel, arg_min({{'ts': log_ts, 'usr': usr}}, {{'d': abs(log_ts - mid), 't': log_ts, 'i': log_id}}) AS f FROM q2 JOIN lg ON q2.image_id = lg.image_id AND log_kind = 'hdd_format' AND log_ts BETWEEN end_us - {H} AND until + {H} GROUP BY 1),"
    + f" lo AS (SELECT channel, arg_min(usr, {{'d': abs(log_ts - end_us), 't': log_ts, 'i': log_id}}) AS u FROM q2 JOIN lg ON q2.image_id = lg.image_id AND log_kind = 'logout' AND log_ts BETWEEN end_us - {H} AND end_us + {H} GROUP BY 1),"
    + f" tc AS (SELECT DISTINCT channel FROM q2 JOIN lg ON q2.image_id = lg.image_id AND log_kind = 'time_change' AND log_ts BETWEEN start_us - {H // 3} AND end_us + {H // 3}),"
    + f" v AS (SELECT q2.*, f, u, tc.channel IS NOT NULL AS cautious, f IS NULL AND coalesce(live_us - end_us <= {-400 * H}, false) AS expired FROM q2 LEFT JOIN fm ON q2.channel = fm.channel LEFT JOIN lo ON q2.channel = lo.channel LEFT JOIN tc ON q2.channel = tc.channel),"
    + " sh AS (SELECT image_id, f.ts AS ts, min(start_us) AS s FROM v WHERE f IS NOT NULL GROUP BY 1, 2),"
    + " dir AS (SELECT v.image_id, channel, coalesce(s, start_us) AS start_us, end_us, CASE WHEN expired THEN 'expiry' ELSE 'format' END AS method, CASE WHEN f IS NOT NULL THEN f.usr WHEN expired THEN u END AS actor, CASE WHEN f IS NOT NULL THEN f.ts WHEN expired THEN live_us END AS action_us, n_frames, n_bytes,"
    + " round(CASE WHEN f IS NOT NULL THEN 0.7 WHEN expired AND u IS NOT NULL THEN 0.6 ELSE 0.5 END - CASE WHEN cautious THEN 0.1 ELSE 0 END, 2)::DOUBLE AS confidence, 2 + (expired AND u IS NOT NULL)::BIGINT + cautious::BIGINT + (coalesce(s, start_us) < start_us)::BIGINT AS n_reasons FROM v LEFT JOIN sh ON v.image_id = sh.image_id AND v.f.ts = sh.ts),"
    + " w AS (SELECT image_id, channel, count(*) AS n, arg_min({'r': recording_id, 's': start_us, 'l': end_us - start_us}, {'p': place, 's': start_us, 'r': recording_id}) AS low, arg_min(recording_id, {'s': start_us, 'r': recording_id}) AS first, min(start_us) AS e0 FROM rc WHERE NOT deleted AND start_us IS NOT NULL GROUP BY 1, 2)"
)


@query("deletion_findings", f"WITH {_FIND} SELECT * FROM dir UNION ALL SELECT image_id, channel, e0 - coalesce(low.l, 0), e0, 'overwrite', NULL, low.s, 0, 0, 0.4::DOUBLE, 2 FROM w WHERE n >= 2 AND low.r <> first AND channel NOT IN (SELECT channel FROM dir)")
def deletion_findings(spark, sf):
    fr = frames(spark, sf).withColumn("image_id", F.col("channel") % 8).withColumn("deleted", F.col("deleted") & (F.col("channel") % 3 != 0))
    rec = recordings(fr).withColumn("image_id", F.col("channel") % 8).withColumn("place", F.col("first_off") * 7919 % 1009)
    kind = F.when(F.col("kind") == "signup", "hdd_format").when(F.col("kind") == "error", "time_change").otherwise("logout")
    logs = fr.where("kind IN ('signup', 'error', 'purchase')").select("image_id", F.col("off").alias("log_id"), F.col("ts_us").alias("log_ts"), kind.alias("log_kind"), F.concat(F.lit("u"), F.col("channel").cast("string")).alias("user"))
    found = verdict.findings(fr, rec, logs, "image_id", "channel", 8 * GAP, -400 * H, H, H // 3)
    return found.withColumn("n_reasons", F.size("reasons").cast("long")).drop("reasons")


@query("timeline_assembly", f"WITH {_STRICT}, r AS (SELECT channel, count(DISTINCT run) AS n_runs, min(ts_us) AS first_us, max(ts_us) AS last_us FROM runs GROUP BY 1), d AS (SELECT channel, count(*) AS n_deleted FROM fr WHERE deleted GROUP BY 1), m AS (SELECT channel, round(max(value), 6) AS peak FROM fr GROUP BY 1) SELECT m.channel, n_runs, first_us, last_us, coalesce(n_deleted, 0) AS n_deleted, peak FROM m LEFT JOIN r ON m.channel = r.channel LEFT JOIN d ON m.channel = d.channel")
def timeline_assembly(spark, sf):
    fr = frames(spark, sf)
    runs = islands.gap_runs(fr, ["channel"], "ts_us", "off", GAP).groupBy("channel").agg(F.countDistinct("run").alias("n_runs"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    rest = fr.groupBy("channel").agg(F.count_if("deleted").alias("n_deleted"), F.round(F.max("value"), 6).alias("peak"))
    return rest.join(runs, "channel", "left").select("channel", "n_runs", "first_us", "last_us", "n_deleted", "peak")


@query(
    "timeline_items",
    f"WITH {REC}, r AS (SELECT channel % 8 AS image_id, * FROM rec), ch AS (SELECT DISTINCT image_id, channel FROM r),"
    " d AS (SELECT image_id, CASE WHEN first_off % 50 <> 0 THEN channel END AS channel, recording_id AS ref, start_us, end_us FROM r WHERE deleted),"
    " i AS (SELECT image_id, channel, 'coverage' AS kind, coalesce(start_us, 0) AS start_us, coalesce(end_us, 0) AS end_us, 'index' AS ref, NULL::DOUBLE AS score FROM r WHERE NOT deleted"
    " UNION ALL SELECT ch.image_id, ch.channel, 'deleted', start_us, end_us, ref, NULL FROM ch JOIN d ON ch.image_id = d.image_id AND (d.channel IS NULL OR d.channel = ch.channel)"
    " UNION ALL SELECT image_id, channel, 'motion', start_us, NULL, NULL, n_frames / 100 FROM r WHERE n_frames > 2"
    " UNION ALL SELECT image_id, channel, 'clock', NULL, NULL, CASE WHEN channel % 3 = 0 THEN 'osd' ELSE 'no clock model' END, CASE WHEN channel % 3 = 0 THEN 0.5 ELSE 0 END FROM ch)"
    " SELECT image_id, channel, kind, start_us, end_us, ref, round(score, 6) AS score FROM i",
)
def timeline_items(spark, sf):
    rec = stored(recordings(frames(spark, sf)).withColumn("image_id", F.col("channel") % 8).withColumn("source", F.lit("index")), "recordings")
    gone = rec.where("deleted").select("image_id", F.when(F.col("first_off") % 50 != 0, F.col("channel")).alias("channel"), F.col("recording_id").alias("finding_id"), "start_us", "end_us")
    moving = rec.where("n_frames > 2").select("image_id", "channel", "start_us", (F.col("n_frames") / 100).alias("peak"))
    clocks = rec.where("channel % 3 = 0").select("image_id", "channel").distinct().withColumn("method", F.lit("osd")).withColumn("confidence", F.lit(0.5))
    return timeline.items(rec, gone, moving, clocks, "image_id", "channel").withColumn("score", F.round("score", 6))


@query("timeline_bucket", f"WITH {FR} SELECT channel, ts_us // {24 * H} AS day, count(*) AS n, count(*) FILTER (deleted) AS n_deleted, round(max(value), 6) AS peak FROM fr WHERE ts_us IS NOT NULL GROUP BY 1, 2")
def timeline_bucket(spark, sf):
    return frames(spark, sf).where("ts_us IS NOT NULL").groupBy("channel", F.expr(f"ts_us div {24 * H}").alias("day")).agg(F.count("*").alias("n"), F.count_if("deleted").alias("n_deleted"), F.round(F.max("value"), 6).alias("peak"))


@query("chain_verify", "WITH o AS (SELECT o_custkey % 50 AS chain, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS seq, o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders), l AS (SELECT chain, seq, CASE WHEN o_orderkey % 997 = 5 THEN 'x' ELSE h END AS own, h AS expected, coalesce(lag(h) OVER (PARTITION BY chain ORDER BY seq), 'genesis') AS prev FROM o), b AS (SELECT *, prev <> coalesce(lag(own) OVER (PARTITION BY chain ORDER BY seq), 'genesis') OR own <> expected AS bad FROM l) SELECT chain, count(*) AS n_entries, min(seq) FILTER (bad) AS first_bad, CASE WHEN NOT bool_or(bad) THEN arg_max(own, seq) END AS head_hash FROM b GROUP BY 1")
def chain_verify(spark, sf):
    w = Window.partitionBy("chain").orderBy("o_orderkey")
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("chain"), "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("expected"))
    log = o.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("prev", F.coalesce(F.lag("expected").over(w), F.lit("genesis"))).withColumn("own", F.when(F.col("o_orderkey") % 997 == 5, "x").otherwise(F.col("expected")))
    return custody.first_broken(log, ["chain"], "seq", "prev", "own", F.col("expected"), "genesis")


@query("merkle_root", "WITH RECURSIVE l AS (SELECT n_regionkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, sha256(n_name) AS h, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation), t AS (SELECT k, i, h, n FROM l UNION ALL (WITH s AS (SELECT * FROM t WHERE n > 1) SELECT k, i // 2, sha256(unhex(min_by(h, i)) || unhex(max_by(h, i))), (any_value(n) + 1) // 2 FROM s GROUP BY k, i // 2)) SELECT k, h AS root FROM t WHERE n = 1")
def merkle_root(spark, sf):
    leaves = table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), "n_nationkey", F.sha2("n_name", 256).alias("h"))
    return custody.merkle_root(leaves, ["k"], "n_nationkey", "h")


@query("au_grouping", f"WITH {FR}, u AS (SELECT *, coalesce(sum(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM fr) SELECT channel, CAST(unit AS BIGINT) AS unit, min(off) AS first_off, CAST(sum(payload_len) AS BIGINT) AS bytes, arg_min(source, off) AS source, bool_or(deleted) AS key FROM u GROUP BY 1, 2 HAVING bool_or(kind = 'view')")
def au_grouping(spark, sf):
    units = islands.attach_to_next(frames(spark, sf), ["channel"], "off", F.col("kind") == "view")
    return units.groupBy("channel", "unit").agg(F.min("off").alias("first_off"), F.sum("payload_len").alias("bytes"), F.min_by("source", "off").alias("source"), F.bool_or("deleted").alias("key"))


@query("nal_spans", f"WITH {FR} SELECT channel, off, coalesce(lead(off) OVER (PARTITION BY channel ORDER BY off), 1000000000) - off AS span FROM fr")
def nal_spans(spark, sf):
    w = Window.partitionBy("channel").orderBy("off")
    return frames(spark, sf).select("channel", "off", (F.coalesce(F.lead("off").over(w), F.lit(1_000_000_000)) - F.col("off")).alias("span"))


@query("channel_ffill", f"WITH {FR}, s AS (SELECT source, off, CASE WHEN off % 4 = 0 THEN kind END AS key FROM fr), f AS (SELECT source, key, min(off) AS f FROM s WHERE key IS NOT NULL GROUP BY 1, 2), d AS (SELECT source, key, dense_rank() OVER (PARTITION BY source ORDER BY f) AS id FROM f) SELECT s.source, s.off, last_value(d.id IGNORE NULLS) OVER (PARTITION BY s.source ORDER BY s.off) AS guess FROM s LEFT JOIN d ON s.source = d.source AND s.key = d.key")
def channel_ffill(spark, sf):
    """Ids by first appearance of a key, carried forward in order of place; null before the first."""
    s = frames(spark, sf).select("source", "off", F.when(F.col("off") % 4 == 0, F.col("kind")).alias("key"))
    first = s.where("key IS NOT NULL").groupBy("source", "key").agg(F.min("off").alias("f"))
    ids = first.select("source", "key", F.dense_rank().over(Window.partitionBy("source").orderBy("f")).cast("long").alias("id"))
    laid = segments.segmented(s.join(ids, ["source", "key"], "left").select("source", "off", "id"), ["source"], ["off"])
    return segments.scanned(laid, ["source"], ["off"], last={"guess": F.col("id")}).select("source", "off", "guess")


@query("roster_guess", f"WITH {_STRICT} SELECT DISTINCT channel, CAST(run AS BIGINT) AS run, [11, 12, 14, 19][CAST(run % 4 AS BIGINT) + 1]::BIGINT AS guess FROM runs")
def roster_guess(spark, sf):
    runs = islands.gap_runs(frames(spark, sf), ["channel"], "ts_us", "off", GAP).select("channel", "run").distinct()
    roster = F.array(*(F.lit(x).cast("long") for x in (11, 12, 14, 19)))
    return runs.withColumn("guess", F.get(roster, (F.col("run") % F.size(roster)).cast("int")))


@query("index_state", f"WITH {FR} SELECT source, count(*) FILTER (NOT deleted) AS n_live, count(*) FILTER (deleted) AS n_free FROM fr GROUP BY 1")
def index_state(spark, sf):
    return frames(spark, sf).groupBy("source").agg(F.count_if(~F.col("deleted")).alias("n_live"), F.count_if("deleted").alias("n_free"))


@query("log_mapping", f"WITH {FR} SELECT off, CASE WHEN channel % 10 = 0 THEN NULL ELSE channel END AS channel, CASE kind WHEN 'signup' THEN 'time_change' WHEN 'purchase' THEN 'export' WHEN 'click' THEN 'playback' ELSE kind END AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM fr")
def log_mapping(spark, sf):
    kind = F.col("kind")
    mapped = F.when(kind == "signup", "time_change").when(kind == "purchase", "export").when(kind == "click", "playback").otherwise(kind)
    return frames(spark, sf).select("off", F.nullif(F.when(F.col("channel") % 10 == 0, F.lit(0)).otherwise(F.col("channel")), F.lit(0)).alias("channel"), mapped.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"))


_SIG = ["the", "an", "ion", "er"]


@query("signature_scan", "SELECT doc_id, CAST(len(regexp_extract_all(text, 'the')) AS BIGINT) AS n_the, CAST(len(regexp_extract_all(text, 'ion')) AS BIGINT) AS n_ion, CAST(len(regexp_extract_all(text, 'the|an|ion|er')) AS BIGINT) AS n_any, CAST(strpos(text, 'tion') - 1 AS BIGINT) AS first_tion FROM documents")
def signature_scan(spark, sf):
    hits = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf, "documents").select("doc_id", hits("the").alias("n_the"), hits("ion").alias("n_ion"), hits("|".join(_SIG)).alias("n_any"), (F.instr("text", "tion") - 1).cast("long").alias("first_tion"))


@query("block_entropy", "WITH c AS (SELECT page_id, (i - 1) // 1024 AS block, substr(html, CAST(i AS BIGINT), 1) AS ch FROM (SELECT page_id, html, unnest(range(1, length(html) + 1)) AS i FROM pages)), n AS (SELECT page_id, block, ch, count(*) AS n FROM c GROUP BY 1, 2, 3), s AS (SELECT page_id, block, sum(n) AS t, sum(n * log2(n)) AS x FROM n GROUP BY 1, 2) SELECT page_id, block, CAST(t AS BIGINT) AS n, round(log2(t) - x / t, 6) AS entropy FROM s")
def block_entropy(spark, sf):
    """Entropy of each block of 1024 characters, counted within the block's row: nothing is shuffled."""
    p = table(spark, sf, "pages").where("char_length(html) > 0").select("page_id", "html", F.explode(F.sequence(F.lit(0), F.expr("(char_length(html) - 1) div 1024"))).alias("block"))
    chars = F.sort_array(F.filter(F.split(F.substring(F.col("html"), F.col("block") * 1024 + 1, F.lit(1024)), ""), lambda c: c != ""))
    return p.select("page_id", F.col("block").cast("long").alias("block"), stats.entropy_of(chars).alias("e")).select("page_id", "block", F.col("e.n").alias("n"), F.round("e.entropy", 6).alias("entropy"))


@query("column_entropy_mode", "WITH c AS (SELECT i AS col, substr(text, CAST(i AS BIGINT), 1) AS ch FROM (SELECT text, unnest(range(1, 33)) AS i FROM documents WHERE length(text) >= 32)), n AS (SELECT col, ch, count(*) AS n FROM c GROUP BY 1, 2) SELECT col, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, arg_max(ch, {'n': n, 'c': -unicode(ch)}) AS mode FROM n GROUP BY 1")
def column_entropy_mode(spark, sf):
    d = table(spark, sf, "documents").where("char_length(text) >= 32")
    chars = d.select(F.posexplode(F.split(F.substring("text", 1, 32), "")).alias("col", "ch")).where("ch <> '' AND col < 32").select((F.col("col") + 1).cast("long").alias("col"), "ch")
    return stats.entropy(chars, ["col"], "ch").select("col", F.round("entropy", 6).alias("entropy"), "mode")


@query("fingerprint_rank", "WITH g(family, sig, weight) AS (VALUES ('A', 'tion', 0.5), ('A', 'heer', 0.3), ('A', 'of', 0.4), ('B', 'keit', 0.6), ('B', 'sch', 0.6), ('C', 'qué', 0.9), ('D', 'zzzz', 1.0)), h AS (SELECT doc_id, family, least(1.0, sum(CASE WHEN contains(text, sig) THEN weight ELSE 0 END)) AS conf FROM documents, g GROUP BY 1, 2) SELECT doc_id, family, CAST(round(conf, 6) AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, family) AS place FROM h WHERE conf >= 0.3")
def fingerprint_rank(spark, sf):
    """Families by summed weights of the signatures found, at most 1, at least 0.3. The genome is a constant of the caller."""
    genome = {"A": (("tion", 0.5), ("heer", 0.3), ("of", 0.4)), "B": (("keit", 0.6), ("sch", 0.6)), "C": (("qué", 0.9),), "D": (("zzzz", 1.0),)}
    score = lambda sigs: F.least(F.lit(1.0), F.round(sum((F.when(F.contains("text", F.lit(s)), w).otherwise(0.0) for s, w in sigs), F.lit(0.0)), 6))
    rows = F.array(*(F.struct(F.lit(f).alias("family"), score(sigs).alias("confidence")) for f, sigs in genome.items()))
    d = table(spark, sf, "documents").select("doc_id", F.inline(rows)).where("confidence >= 0.3")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("confidence").desc(), "family")).cast("long"))


@query("best_match", "WITH m AS (SELECT event_id, user_id, event_type AS family, value / 100 AS conf FROM events WHERE value / 100 >= 0.8 AND event_type <> 'error') SELECT user_id, family, conf FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conf DESC, family, event_id) AS r FROM m) WHERE r = 1")
def best_match(spark, sf):
    m = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("family"), (F.col("value") / 100).alias("conf")).where("conf >= 0.8 AND family <> 'error'")
    w = Window.partitionBy("user_id").orderBy(F.col("conf").desc(), "family", "event_id")
    return m.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "family", "conf")


@query("field_scores", f"WITH {FR}, l AS (SELECT channel, off, ts_us, payload_len AS v, lag(ts_us) OVER w AS pt, lag(payload_len) OVER w AS pv, lead(off) OVER w AS nx FROM fr WINDOW w AS (PARTITION BY channel ORDER BY off)) SELECT channel, round(avg(CASE WHEN ts_us >= pt THEN 1.0 ELSE 0.0 END) FILTER (ts_us IS NOT NULL AND pt IS NOT NULL), 6) AS monotonic, round(avg(CASE WHEN v - pv = 1 THEN 1.0 ELSE 0.0 END) FILTER (pv IS NOT NULL), 6) AS sequence, round(avg(CASE WHEN nx - off = v THEN 1.0 ELSE 0.0 END) FILTER (nx IS NOT NULL), 6) AS length, greatest(round(avg(CASE WHEN (v % 2 = 1) = deleted_ THEN 1.0 ELSE 0.0 END), 6), round(1 - avg(CASE WHEN (v % 2 = 1) = deleted_ THEN 1.0 ELSE 0.0 END), 6)) AS flags, count(DISTINCT v) AS n_distinct FROM (SELECT l.*, off % 5 = 0 AS deleted_ FROM l) GROUP BY 1")
def field_scores(spark, sf):
    """How far a column behaves as a timestamp, sequence, length or flag field."""
    w = Window.partitionBy("channel").orderBy("off")
    v = F.col("payload_len")
    rows = frames(spark, sf).select("channel", "deleted", v.alias("v"), (F.col("ts_us") >= F.lag("ts_us").over(w)).alias("m"), (v - F.lag("payload_len").over(w) == 1).alias("s"), (F.lead("off").over(w) - F.col("off") == v).alias("l"))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    agree = F.avg(((F.col("v") % 2 == 1) == F.col("deleted")).cast("int"))
    return rows.groupBy("channel").agg(share("m").alias("monotonic"), share("s").alias("sequence"), share("l").alias("length"), F.greatest(F.round(agree, 6), F.round(1 - agree, 6)).alias("flags"), F.countDistinct("v").alias("n_distinct"))
