"""Filters, lookups, joins, aggregates and SQL over the tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from frameloom.operators import custody, lookup, stats
from frameloom.operators.intervals import asof, overlap_join
from frameloom.plans.registry import query
from frameloom.sources.tables import FR, REC, H, frames, micros, recordings, table

@query("frame_filter", f"WITH {FR} SELECT channel, ts_us, off FROM fr WHERE source = 'carved' AND NOT deleted AND kind = 'view' AND ts_us >= (SELECT min(ts_us) + 24 * {H} FROM fr) AND ts_us <= (SELECT max(ts_us) - 24 * {H} FROM fr)")
def frame_filter(spark, sf):
    fr = frames(spark, sf)
    low, high = fr.agg(F.min("ts_us") + 24 * H, F.max("ts_us") - 24 * H).first()
    return lookup.frame_filter(fr, from_us=low, to_us=high, source="carved", deleted=False, kind="view").select("channel", "ts_us", "off")


@query("frame_page", f"WITH {FR} SELECT channel, ts_us, off FROM fr ORDER BY channel NULLS LAST, ts_us NULLS LAST, off LIMIT 100 OFFSET 200")
def frame_page(spark, sf):
    return lookup.page(frames(spark, sf), ["channel", "ts_us", "off"], 100, "200")[0].select("channel", "ts_us", "off")


@query("frame_count", f"WITH {FR} SELECT count(*) AS n FROM fr WHERE source = 'index' AND deleted")
def frame_count(spark, sf):
    return lookup.frame_filter(frames(spark, sf), source="index", deleted=True).agg(F.count("*").alias("n"))


@query("point_lookup", f"WITH {REC} SELECT recording_id, channel, start_us, n_frames FROM rec WHERE recording_id = (SELECT min(recording_id) FROM rec)")
def point_lookup(spark, sf):
    rec = recordings(frames(spark, sf))
    return rec.orderBy("recording_id").limit(1).select("recording_id", "channel", "start_us", "n_frames")


@query("recording_overlap_filter", f"WITH {REC} SELECT recording_id, channel, start_us, end_us FROM rec WHERE (end_us IS NULL OR end_us >= (SELECT min(ts_us) + 48 * {H} FROM fr)) AND (start_us IS NULL OR start_us <= (SELECT min(ts_us) + 72 * {H} FROM fr))")
def recording_overlap_filter(spark, sf):
    fr = frames(spark, sf)
    base = fr.agg(F.min("ts_us")).first()[0]
    return lookup.overlapping(recordings(fr), "start_us", "end_us", base + 48 * H, base + 72 * H).select("recording_id", "channel", "start_us", "end_us")


@query("semi_scope", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_scope(spark, sf):
    scope = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf, "orders").join(scope, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("anti_new_only", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_new_only(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("schema_tolerant_projection", "SELECT event_id, user_id, CAST(NULL AS VARCHAR) AS payload_sha256, CAST(NULL AS BIGINT) AS ts_norm_us FROM events")
def schema_tolerant_projection(spark, sf):
    kinds = (("event_id", T.LongType()), ("user_id", T.LongType()), ("payload_sha256", T.StringType()), ("ts_norm_us", T.LongType()))
    return lookup.tolerant(table(spark, sf, "events"), T.StructType([T.StructField(*k) for k in kinds]))


@query(
    "evidence_search_union",
    f"WITH {REC} SELECT 'log' AS kind, CAST(off AS VARCHAR) AS ref, channel FROM fr WHERE contains(lower(kind), 'pur') AND channel IN (1, 2, 3, 4, 5, 6, 7, 8)"
    " UNION ALL SELECT 'recording', recording_id, channel FROM rec WHERE channel IN (1, 2, 3, 4, 5, 6, 7, 8)",
)
def evidence_search_union(spark, sf):
    fr = frames(spark, sf)
    logs = fr.select(F.col("off").alias("ref"), "channel", F.col("kind").alias("log_kind"))
    nothing = fr.select(F.col("off").alias("ref"), "channel", F.col("kind").alias("label"), F.col("value").alias("peak_score")).where("false")
    rec = recordings(fr).select(F.col("recording_id").alias("ref"), "channel", "start_us", "end_us")
    return lookup.evidence_search(rec, logs, nothing, nothing, channels=list(range(1, 9)), text="PUR")


@query(
    "evidence_search_motion",
    f"WITH {FR} SELECT 'detection' AS kind, CAST(off AS VARCHAR) AS ref, channel FROM fr WHERE kind = 'error' UNION ALL SELECT 'motion', CAST(off AS VARCHAR), channel FROM fr WHERE value >= 90",
)
def evidence_search_motion(spark, sf):
    fr = frames(spark, sf)
    rows = fr.select(F.col("off").alias("ref"), "channel", F.col("kind").alias("label"), F.col("kind").alias("log_kind"), F.col("value").alias("peak_score"))
    return lookup.evidence_search(recordings(fr), rows, rows, rows, detection="error", motion_min=90)


@query(
    "global_search",
    "WITH hits AS (SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS ref FROM customer WHERE contains(lower(c_name), '00001')"
    " UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE contains(lower(p_name), '00001')"
    " UNION ALL SELECT 'frame', CAST(event_id AS VARCHAR) FROM events WHERE abs((epoch_us(ts) % 86400000000) - 43200000000) <= 60000000)"
    " SELECT kind, ref FROM hits ORDER BY kind, ref LIMIT 50",
)
def global_search(spark, sf):
    named = lambda t, k, c, kind: table(spark, sf, t).where(F.lower(c).contains("00001")).select(F.lit(kind).alias("kind"), F.col(k).cast("string").alias("ref"))
    events = table(spark, sf, "events").select("event_id", micros(F.col("ts")).alias("ts_us"))
    noon = lookup.time_of_day(events, "ts_us", 43_200, 60).select(F.lit("frame").alias("kind"), F.col("event_id").cast("string").alias("ref"))
    return named("customer", "c_custkey", "c_name", "customer").unionByName(named("part", "p_partkey", "p_name", "part")).unionByName(noon).orderBy("kind", "ref").limit(lookup.SEARCH_MOST)


_SEARCHED = (
    REC
    + ", ca AS (SELECT n_nationkey AS case_id, 'CASE-' || n_nationkey AS number, n_name AS title FROM nation), im AS (SELECT 'img_' || s_suppkey AS id, s_nationkey AS case_id, s_name AS path, sha256(s_name) AS sha FROM supplier),"
    " rs AS (SELECT recording_id AS id, channel % 25 AS case_id, channel, n_frames, deleted, 'first at ' || first_off AS r1, n_frames || ' frames' AS r2 FROM rec)"
)


def _search_sql(sought: str, second: int | None = None) -> str:
    has = lambda c: f"contains(lower({c}), '{sought}')"
    parts = [
        f"SELECT 0 AS k, 'case' AS kind, CAST(case_id AS VARCHAR) AS id, CAST(case_id AS VARCHAR) AS case_id, title AS label, number AS detail FROM ca WHERE {has('number')} OR {has('title')}",
        f"SELECT 1, 'evidence', id, CAST(case_id AS VARCHAR), path, 'sha256=' || substr(sha, 1, 12) || '…' FROM im WHERE {has('path')} OR {has('id')}",
        f"SELECT 2, 'recording', id, CAST(case_id AS VARCHAR), 'channel ' || channel, 'index' FROM rs WHERE {has('id')}",
        f"SELECT 3, 'finding', id, CAST(case_id AS VARCHAR), 'deleted', r1 || '; ' || r2 FROM rs WHERE deleted AND ({has("'deleted'")} OR {has('r1')} OR {has('r2')})",
    ]
    if second is not None:
        near = f"abs(ts_us % 86400000000 - {second} * 1000000) <= 1000000"
        parts.append(f"SELECT 4, 'frame', CAST(off AS VARCHAR), CAST(channel % 25 AS VARCHAR), 'channel ' || channel || ' @ {sought}', 'payload_offset=' || off FROM (SELECT *, row_number() OVER (PARTITION BY channel % 25 ORDER BY channel, ts_us, off) AS r FROM fr WHERE {near}) WHERE r <= 5")
    return f"WITH {_SEARCHED}, hits AS ({' UNION ALL '.join(parts)}) SELECT kind, id, case_id, label, detail FROM hits ORDER BY case_id, k, id LIMIT 50"


def _searched(spark, sf, sought: str):
    """Nations as cases, suppliers as their images, and the recordings and frames of every 25th channel as theirs."""
    fr = frames(spark, sf)
    case_id = (F.col("channel") % 25).alias("case_id")
    nation, supplier, rec = table(spark, sf, "nation"), table(spark, sf, "supplier"), recordings(fr)
    cases = nation.select(F.col("n_nationkey").alias("case_id"), F.concat(F.lit("CASE-"), F.col("n_nationkey").cast("string")).alias("number"), F.col("n_name").alias("title"))
    evidence = supplier.select(F.concat(F.lit("img_"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("case_id"), F.col("s_name").alias("path"), F.sha2("s_name", 256).alias("sha256"))
    reasons = F.array(F.concat(F.lit("first at "), F.col("first_off").cast("string")), F.concat(F.col("n_frames").cast("string"), F.lit(" frames")))
    found = rec.where("deleted").select(F.col("recording_id").alias("id"), case_id, F.lit("deleted").alias("method"), reasons.alias("reasons"))
    own = fr.select(F.col("off").alias("id"), case_id, "channel", F.col("off").alias("payload_offset"), "ts_us")
    return lookup.global_search(sought, cases, evidence, rec.select(F.col("recording_id").alias("id"), case_id, "channel", F.lit("index").alias("source")), found, own)


@query("case_search_text", _search_sql("12"))
def case_search_text(spark, sf):
    """The first fifty hits of a text in cases, images, recordings and reasons of findings."""
    return _searched(spark, sf, " 12")


@query("case_search_time", _search_sql("00:00:07", 7))
def case_search_time(spark, sf):
    """Frames at a time of day, five a case at most."""
    return _searched(spark, sf, "00:00:07")


@query("gram_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ionea') UNION ALL SELECT doc_id FROM documents WHERE contains(lower(text), 'ß')")
def gram_search(spark, sf):
    """Documents that hold a text: candidates by postings of three characters, then the text itself; a shorter one in every document."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    index = lookup.gram_index(d, "doc_id", "text")
    return lookup.containing(d, "doc_id", "text", "IONEA", index).unionByName(lookup.containing(d, "doc_id", "text", "ß", index)).select("doc_id")


@query("asof_keyframe", f"WITH {FR} SELECT f.channel, f.off, k.off AS key_off FROM (SELECT * FROM fr WHERE kind <> 'view') f ASOF LEFT JOIN (SELECT channel, off FROM fr WHERE kind = 'view') k ON f.channel = k.channel AND f.off >= k.off")
def asof_keyframe(spark, sf):
    fr = frames(spark, sf).select("channel", "off", "kind")
    keys = fr.where("kind = 'view'")
    return asof(fr.where("kind <> 'view'").select("channel", "off"), keys.select("channel", "off"), ["channel"], "off", F.col("off"), "key_off")


@query(
    "nearest_frame",
    f"WITH {FR}, t AS (SELECT channel, (min(ts_us) + max(ts_us)) // 2 AS mid FROM fr GROUP BY 1) SELECT t.channel, arg_min(off, {{'d': abs(ts_us - mid), 'o': off}}) AS off FROM t JOIN fr ON t.channel = fr.channel WHERE ts_us IS NOT NULL GROUP BY 1",
)
def nearest_frame(spark, sf):
    fr = frames(spark, sf).where("ts_us IS NOT NULL")
    at = fr.groupBy("channel").agg(F.expr("(min(ts_us) + max(ts_us)) div 2").alias("at"))
    return fr.join(at, "channel").groupBy("channel").agg(F.min_by("off", F.struct(F.abs(F.col("ts_us") - F.col("at")), F.col("off"))).alias("off"))


@query(
    "datetime_text_parse",
    "WITH t AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN strftime(ts, 'cam %Y-%m-%d %H:%M:%S x') WHEN 1 THEN strftime(ts, '%d-%m-%Y %H:%M:%S') ELSE strftime(ts, '%m/%d/%Y %I:%M:%S %p') END AS s FROM events)"
    " SELECT event_id, s, epoch_us(date_trunc('second', ts)) AS ts_us FROM t",
)
def datetime_text_parse(spark, sf):
    e = table(spark, sf, "events")
    ts = F.col("ts")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "'cam 'yyyy-MM-dd HH:mm:ss' x'")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "dd-MM-yyyy HH:mm:ss")).otherwise(F.date_format(ts, "MM/dd/yyyy hh:mm:ss a"))
    return e.select("event_id", text.alias("s")).withColumn("ts_us", lookup.parsed_datetime(F.col("s")))


@query(
    "number_support",
    "WITH t AS (SELECT event_id, 'seen ' || (event_id % 7) || ' of ' || (event_id % 5) AS s, 'fact ' || (event_id % 7) || ', ' || (event_id % 4) AS f FROM events),"
    " n AS (SELECT event_id, list_distinct(list_filter(regexp_extract_all(s, '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(f, '[0-9]+'), x))) AS u FROM t)"
    " SELECT event_id, CAST(len(u) AS BIGINT) AS n_unsupported FROM n WHERE len(u) > 0",
)
def number_support(spark, sf):
    i = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("seen "), i % 7, F.lit(" of "), i % 5).alias("s"), F.concat(F.lit("fact "), i % 7, F.lit(", "), i % 4).alias("f"))
    return e.select("event_id", F.size(lookup.unsupported_numbers(F.col("s"), F.col("f"))).cast("long").alias("n_unsupported")).where("n_unsupported > 0")


@query(
    "payload_guard",
    "SELECT page_id, strlen(html) > 6000 OR regexp_matches(html, '[0-9a-fA-F]{64,}') OR regexp_matches(html, '[A-Za-z0-9+/]{120,}={0,2}') AS refused FROM pages",
)
def payload_guard(spark, sf):
    return table(spark, sf, "pages").select("page_id", lookup.payload_refused(F.col("html"), 6000).alias("refused"))


@query("export_selection", f"WITH {FR} SELECT off, channel, ts_us FROM fr WHERE channel = 3 AND ts_us >= (SELECT min(ts_us) FROM fr) + 24 * {H} AND ts_us <= (SELECT min(ts_us) FROM fr) + 240 * {H}")
def export_selection(spark, sf):
    fr = frames(spark, sf)
    base = fr.agg(F.min("ts_us")).first()[0]
    return lookup.frame_filter(fr, from_us=base + 24 * H, to_us=base + 240 * H, channel=3).select("off", "channel", "ts_us")


@query("frames_with_recordings", f"WITH {REC} SELECT rec.recording_id, count(*) AS n, CAST(sum(payload_len) AS BIGINT) AS bytes FROM fr JOIN rec ON fr.recording_id = rec.recording_id WHERE NOT rec.deleted GROUP BY 1")
def frames_with_recordings(spark, sf):
    fr = frames(spark, sf)
    live = recordings(fr).where("NOT deleted").select("recording_id")
    return fr.join(live, "recording_id").groupBy("recording_id").agg(F.count("*").alias("n"), F.sum("payload_len").alias("bytes"))


@query(
    "header_index_agreement",
    f"WITH {REC}, i AS (SELECT recording_id, start_us + (first_off % 4) * 1000000 AS istart, CASE WHEN first_off % 7 = 0 THEN NULL ELSE end_us - (first_off % 3) * 1500000 END AS iend, start_us, end_us FROM rec)"
    " SELECT recording_id, coalesce(abs(istart - start_us) <= 2000000, true) AND coalesce(abs(iend - end_us) <= 2000000, true) AS agrees FROM i",
)
def header_index_agreement(spark, sf):
    rec = recordings(frames(spark, sf))
    off = F.col("first_off")
    rec = rec.withColumn("istart", F.col("start_us") + off % 4 * 1_000_000).withColumn("iend", F.when(off % 7 != 0, F.col("end_us") - off % 3 * 1_500_000))
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= 2_000_000, F.lit(True))
    return rec.select("recording_id", (near("istart", "start_us") & near("iend", "end_us")).alias("agrees"))


@query("log_carve_merge", "SELECT event_id AS off, CASE WHEN event_id % 2 = 0 THEN 'area' ELSE 'carved' END AS found FROM events WHERE event_id % 2 = 0 OR NOT (event_id >= 100 AND event_id < 700)")
def log_carve_merge(spark, sf):
    """Declared and carved copies by offset, the declared first; carved ones inside the declared area are dropped."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("off"))
    area = e.where("off % 2 = 0").select("off", F.lit("area").alias("found"), F.lit(0).alias("prio"))
    carved = e.where("NOT (off >= 100 AND off < 700)").select("off", F.lit("carved").alias("found"), F.lit(1).alias("prio"))
    return area.unionByName(carved).groupBy("off").agg(F.min_by("found", "prio").alias("found"))


@query(
    "recording_match",
    f"WITH {REC}, r AS (SELECT recording_id AS r_id, channel, start_us + (first_off % 5) * 400000 AS s, end_us - (first_off % 4) * 400000 AS e FROM rec)"
    " SELECT recording_id FROM rec WHERE EXISTS (SELECT 1 FROM r WHERE r.channel = rec.channel AND abs(r.s - rec.start_us) <= 1000000 AND abs(r.e - rec.end_us) <= 1000000)",
)
def recording_match(spark, sf):
    truth = recordings(frames(spark, sf))
    off = F.col("first_off")
    found = truth.select(F.col("channel").alias("c"), (F.col("start_us") + off % 5 * 400_000).alias("s"), (F.col("end_us") - off % 4 * 400_000).alias("e"))
    # both starts lie within one second, so they share a two-second bucket or its neighbour
    cell = 2_000_000
    near = truth.withColumn("_b", F.explode(F.array(*((F.floor(F.col("start_us") / cell) + d) for d in (-1, 0, 1)))))
    hit = found.withColumn("_fb", F.floor(F.col("s") / cell))
    cond = (F.col("channel") == F.col("c")) & (F.col("_b") == F.col("_fb")) & (F.abs(F.col("s") - F.col("start_us")) <= 1_000_000) & (F.abs(F.col("e") - F.col("end_us")) <= 1_000_000)
    return near.join(hit, cond, "left_semi").select("recording_id").distinct()


@query(
    "score_recall_precision",
    f"WITH {FR}, t AS (SELECT off FROM fr WHERE deleted), r AS (SELECT off FROM fr WHERE deleted AND off % 7 <> 0 OR off % 31 = 0), h AS (SELECT count(*) AS n FROM t WHERE off IN (SELECT off FROM r))"
    " SELECT (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM r) AS n_found, n AS n_hit, round(n / (SELECT count(*) FROM t), 6) AS recall, round(n / (SELECT count(*) FROM r), 6) AS precision FROM h",
)
def score_recall_precision(spark, sf):
    fr = frames(spark, sf)
    truth, found = fr.where("deleted").select("off", F.lit(True).alias("t")), fr.where("deleted AND off % 7 <> 0 OR off % 31 = 0").select("off", F.lit(True).alias("f"))
    both = truth.join(found, "off", "full").agg(F.count("t").alias("n_truth"), F.count("f").alias("n_found"), F.count_if(F.col("t") & F.col("f")).alias("n_hit"))
    return both.withColumn("recall", F.round(F.col("n_hit") / F.col("n_truth"), 6)).withColumn("precision", F.round(F.col("n_hit") / F.col("n_found"), 6))


_SPANS = f"WITH {REC}, a AS (SELECT recording_id AS id, channel, start_us AS s, end_us AS e FROM rec WHERE NOT deleted AND start_us IS NOT NULL), b AS (SELECT recording_id AS id, channel, start_us + 10 * {H} AS s, end_us + 10 * {H} AS e FROM rec WHERE deleted AND start_us IS NOT NULL)"


def _spans(spark, sf):
    rec = recordings(frames(spark, sf)).where("start_us IS NOT NULL")
    a = rec.where("NOT deleted").select(F.col("recording_id").alias("id"), F.col("channel").alias("ch"), F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    b = rec.where("deleted").select(F.col("recording_id").alias("id2"), F.col("channel").alias("ch2"), (F.col("start_us") + 10 * H).alias("s2"), (F.col("end_us") + 10 * H).alias("e2"))
    return a, b


@query(
    "score_f1",
    _SPANS + ", m AS (SELECT a.id AS p, b.id AS t FROM a JOIN b ON a.channel = b.channel AND a.s < b.e AND b.s < a.e), c AS (SELECT (SELECT count(DISTINCT p) FROM m) AS tp, (SELECT count(*) FROM a) - (SELECT count(DISTINCT p) FROM m) AS fp, (SELECT count(*) FROM b) - (SELECT count(DISTINCT t) FROM m) AS fn)"
    " SELECT tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c",
)
def score_f1(spark, sf):
    a, b = _spans(spark, sf)
    m = overlap_join(a, b, [("ch", "ch2")], ("s", "e"), ("s2", "e2"), 0, 240 * H, strict=True).agg(F.countDistinct("id").alias("tp"), F.countDistinct("id2").alias("ht"))
    out = m.crossJoin(a.agg(F.count("*").alias("np"))).crossJoin(b.agg(F.count("*").alias("nt")))
    tp, fp, fn = F.col("tp"), F.col("np") - F.col("tp"), F.col("nt") - F.col("ht")
    return out.select("tp", fp.alias("fp"), fn.alias("fn"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1"))


@query(
    "deletion_match",
    _SPANS + ", o AS (SELECT a.id AS t, min(b.id) AS f FROM a JOIN b ON a.channel = b.channel AND a.s <= b.e AND b.s <= a.e GROUP BY 1), u AS (SELECT x.id AS t, y.id AS f FROM (SELECT channel, min(id) AS id FROM a GROUP BY 1 HAVING count(*) = 1) x JOIN (SELECT channel, min(id) AS id FROM b GROUP BY 1 HAVING count(*) = 1) y ON x.channel = y.channel)"
    " SELECT a.id AS truth_id, coalesce(o.f, u.f) AS found_id FROM a LEFT JOIN o ON a.id = o.t LEFT JOIN u ON a.id = u.t",
)
def deletion_match(spark, sf):
    a, b = _spans(spark, sf)
    over = overlap_join(a, b, [("ch", "ch2")], ("s", "e"), ("s2", "e2"), 0, 240 * H).groupBy("id").agg(F.min("id2").alias("o"))
    one = lambda df, c, i, n: df.groupBy(c).agg(F.count("*").alias("k"), F.min(i).alias(n)).where("k = 1").drop("k")
    alone = one(a, "ch", "id", "id").join(one(b, "ch2", "id2", "u"), F.col("ch") == F.col("ch2")).select("id", "u")
    return a.select("id").join(over, "id", "left").join(alone, "id", "left").select(F.col("id").alias("truth_id"), F.coalesce("o", "u").alias("found_id"))


@query("intake_kind", "SELECT c_custkey, coalesce(max(o_orderpriority), 'registered_existing') AS intake FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def intake_kind(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("p"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("p", F.lit("registered_existing")).alias("intake"))


@query(
    "layout_truth",
    "WITH truth(field, off, width, unit) AS (VALUES ('channel', 12, 2, NULL), ('timestamp', 16, 8, 'ms'), ('length', 24, 4, NULL), ('sequence', 28, 4, NULL), ('flags', 32, 2, NULL)),"
    " found(field, off, width, unit) AS (VALUES ('channel', 12, 2, 'none'), ('timestamp', 16, 8, 'ms'), ('length', 24, 4, NULL), ('sequence', 30, 4, NULL))"
    " SELECT t.field, coalesce(t.off = f.off AND t.width = f.width AND coalesce(t.unit, 'none') = coalesce(f.unit, 'none'), false) AS ok FROM truth t LEFT JOIN found f ON t.field = f.field",
)
def layout_truth(spark, sf):
    cols = "field string, off int, width int, unit string"
    truth = spark.createDataFrame([("channel", 12, 2, None), ("timestamp", 16, 8, "ms"), ("length", 24, 4, None), ("sequence", 28, 4, None), ("flags", 32, 2, None)], cols)
    found = spark.createDataFrame([("channel", 12, 2, "none"), ("timestamp", 16, 8, "ms"), ("length", 24, 4, None), ("sequence", 30, 4, None)], cols)
    t, f = truth.alias("t"), found.alias("f")
    same = (F.col("t.off") == F.col("f.off")) & (F.col("t.width") == F.col("f.width")) & (F.coalesce("t.unit", F.lit("none")) == F.coalesce("f.unit", F.lit("none")))
    return t.join(f, F.col("t.field") == F.col("f.field"), "left").select("t.field", F.coalesce(same, F.lit(False)).alias("ok"))


@query("job_summary", f"WITH {REC} SELECT source, count(DISTINCT fr.recording_id) AS n_recordings, count(*) FILTER (source = 'carved') AS n_carved, count(*) FILTER (deleted) AS n_deleted FROM fr GROUP BY 1")
def job_summary(spark, sf):
    return frames(spark, sf).groupBy("source").agg(F.countDistinct("recording_id").alias("n_recordings"), F.count_if(F.col("source") == "carved").alias("n_carved"), F.count_if("deleted").alias("n_deleted"))


@query("finding_measures", f"WITH {FR} SELECT channel, CAST(sum(payload_len) AS BIGINT) AS bytes, count(*) AS n, min(ts_us) AS start_us, max(ts_us) AS end_us, string_agg(DISTINCT recording_id, ',' ORDER BY recording_id) AS ids FROM fr WHERE deleted GROUP BY 1")
def finding_measures(spark, sf):
    ids = F.array_join(F.sort_array(F.collect_set("recording_id")), ",")
    return frames(spark, sf).where("deleted").groupBy("channel").agg(F.sum("payload_len").alias("bytes"), F.count("*").alias("n"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), ids.alias("ids"))


@query("finding_summary", f"WITH {REC} SELECT count(*) AS n, count(DISTINCT channel) AS n_channels, CAST(round(sum(greatest(0, end_us - start_us)) / 60000000) AS BIGINT) AS minutes FROM rec WHERE deleted")
def finding_summary(spark, sf):
    length = F.sum(F.greatest(F.lit(0), F.col("end_us") - F.col("start_us")))
    return recordings(frames(spark, sf)).where("deleted").agg(F.count("*").alias("n"), F.countDistinct("channel").alias("n_channels"), F.round(length / 60_000_000).cast("long").alias("minutes"))


@query(
    "robust_median_mad",
    "WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), d AS (SELECT e.event_type, value, abs(value - m) AS d FROM events e JOIN m ON e.event_type = m.event_type), a AS (SELECT event_type, median(d) AS mad FROM d GROUP BY 1)"
    " SELECT d.event_type, round(median(value), 6) AS median, round(any_value(mad), 6) AS mad, count(*) AS n_kept FROM d JOIN a ON d.event_type = a.event_type WHERE mad = 0 OR d <= 3.5 * 1.4826 * mad GROUP BY 1",
)
def robust_median_mad(spark, sf):
    out = stats.robust_median(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "n_kept")


@query(
    "osd_drift",
    f"WITH {FR}, o AS (SELECT channel, (off % 13) * 200000 + (channel % 4) * 700000 AS v FROM fr WHERE ts_us IS NOT NULL), m AS (SELECT channel, CAST(round_even(median(v), 0) AS BIGINT) AS offset_us FROM o GROUP BY 1)"
    " SELECT channel, offset_us, CASE WHEN abs(offset_us) > 1000000 THEN 'overlay differs by ' || (offset_us // 1000) || ' ms' END AS note FROM m",
)
def osd_drift(spark, sf):
    rows = frames(spark, sf).where("ts_us IS NOT NULL").select("channel", (F.col("off") % 13 * 200_000 + F.col("channel") % 4 * 700_000).alias("v"))
    med = rows.groupBy("channel").agg(F.bround(F.percentile("v", F.lit(0.5)), 0).cast("long").alias("offset_us"))
    note = F.when(F.abs("offset_us") > 1_000_000, F.concat(F.lit("overlay differs by "), F.expr("offset_us div 1000").cast("string"), F.lit(" ms")))
    return med.withColumn("note", note)


@query("fps_estimate", f"WITH {FR} SELECT recording_id, round(CASE WHEN count(ts_us) > 1 AND max(ts_us) > min(ts_us) THEN (count(ts_us) - 1) * 1000000.0 / (max(ts_us) - min(ts_us)) ELSE 12.5 END, 9) AS fps FROM fr GROUP BY 1")
def fps_estimate(spark, sf):
    n, span = F.count("ts_us"), F.max("ts_us") - F.min("ts_us")
    return frames(spark, sf).groupBy("recording_id").agg(F.round(F.when((n > 1) & (span > 0), (n - 1) * 1_000_000.0 / span).otherwise(12.5), 9).alias("fps"))


@query(
    "median_period_window",
    f"WITH {FR}, d AS (SELECT channel, ts_us - lag(ts_us) OVER (PARTITION BY channel ORDER BY ts_us, off) AS d FROM fr WHERE ts_us IS NOT NULL) SELECT channel, CAST(greatest(3, round_even(100 * {H} / median(d), 0)) AS BIGINT) AS half_rows FROM d WHERE d > 0 GROUP BY 1",
)
def median_period_window(spark, sf):
    w = Window.partitionBy("channel").orderBy("ts_us", "off")
    d = frames(spark, sf).where("ts_us IS NOT NULL").select("channel", (F.col("ts_us") - F.lag("ts_us").over(w)).alias("d")).where("d > 0")
    return d.groupBy("channel").agg(F.greatest(F.lit(3), F.bround(100 * H / F.percentile("d", F.lit(0.5)), 0)).cast("long").alias("half_rows"))


@query(
    "llm_budget",
    "WITH price(model, p_in, p_out) AS (VALUES ('a', 3.0, 15.0), ('b', 0.8, 4.0)), u AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'a' WHEN conv_id % 3 = 1 THEN 'b' ELSE 'unknown' END AS model, CAST(sum(length(text) // 4) FILTER (role <> 'assistant') AS BIGINT) AS t_in, CAST(sum(length(text) // 4) FILTER (role = 'assistant') AS BIGINT) AS t_out FROM conversations GROUP BY 1, 2)"
    " SELECT u.model, count(*) AS n, round(sum(coalesce(t_in, 0) * coalesce(p.p_in, 3.0) + coalesce(t_out, 0) * coalesce(p.p_out, 15.0)) / 1e6, 6) AS cost FROM u LEFT JOIN price p ON u.model = p.model GROUP BY 1",
)
def llm_budget(spark, sf):
    """Cost by model at four characters a token; an unknown model costs as the one with the dearest input."""
    price = spark.createDataFrame([("a", 3.0, 15.0), ("b", 0.8, 4.0)], "model string, p_in double, p_out double")
    dear = price.agg(F.max_by(F.struct("p_in", "p_out"), "p_in").alias("d"))
    n = F.expr("char_length(text) div 4")
    i = F.col("conv_id") % 3
    use = table(spark, sf, "conversations").groupBy("conv_id", F.when(i == 0, "a").when(i == 1, "b").otherwise("unknown").alias("model")).agg(F.sum(F.when(F.col("role") != "assistant", n)).alias("t_in"), F.sum(F.when(F.col("role") == "assistant", n)).alias("t_out"))
    rows = use.join(F.broadcast(price), "model", "left").crossJoin(F.broadcast(dear))
    cost = F.coalesce("t_in", F.lit(0)) * F.coalesce("p_in", "d.p_in") + F.coalesce("t_out", F.lit(0)) * F.coalesce("p_out", "d.p_out")
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum(cost) / 1e6, 6).alias("cost"))


@query(
    "llm_budget_check",
    "WITH u AS (SELECT conv_id % 40 AS case_id, CAST(sum(length(text) // 4 * 3) AS BIGINT) AS spent_case FROM conversations GROUP BY 1), n AS (SELECT o_orderkey, o_orderkey % 50 AS case_id, o_orderkey % 7 * 1000 AS estimated FROM orders), t AS (SELECT sum(spent_case) AS total FROM u)"
    " SELECT o_orderkey, n.case_id, estimated, coalesce(spent_case, 0) AS spent_case, CASE WHEN total + estimated > 10000000000 THEN 'total' WHEN coalesce(spent_case, 0) + estimated > 4000 THEN 'case' END AS refused FROM n LEFT JOIN u ON n.case_id = u.case_id CROSS JOIN t",
)
def llm_budget_check(spark, sf):
    calls = table(spark, sf, "conversations").select((F.col("conv_id") % 40).alias("case_id"), F.expr("char_length(text) div 4 * 3").alias("cost"))
    asked = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 50).alias("case_id"), (F.col("o_orderkey") % 7 * 1000).alias("estimated"))
    return lookup.over_budget(calls, asked, "case_id", 10_000_000_000, 4000)


_PAYLOAD = "concat('{\"', CASE page_id % 4 WHEN 0 THEN 'Key_Fra-mes' WHEN 1 THEN 'note' WHEN 2 THEN 'raw Bytes' ELSE 'kind' END, '\": [{\"x\": \"', CASE WHEN page_id % 3 = 0 THEN repeat('aB', CAST(100 + page_id % 60 AS INT)) ELSE repeat('two words ', CAST(page_id % 40 AS INT)) END, '\"}]}')"


@query(
    "payload_refusal",
    f"WITH p AS (SELECT page_id, {_PAYLOAD} AS payload FROM pages) SELECT page_id, CASE WHEN regexp_matches(payload, 'Key_Fra-mes|raw Bytes') THEN 'key' WHEN regexp_matches(payload, '\"[A-Za-z0-9+/]{{257,}}=?=?\"') THEN 'string' WHEN strlen(payload) > 300 THEN 'size' END AS reason FROM p",
)
def payload_refusal(spark, sf):
    return table(spark, sf, "pages").select("page_id", lookup.refusal(F.expr(_PAYLOAD), 256, 300).alias("reason"))


@query("usage_listing", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def usage_listing(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place"))


@query("export_manifest", f"WITH {FR} SELECT recording_id, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, sha256(string_agg(CAST(off AS VARCHAR), ',' ORDER BY off)) AS frames_sha256 FROM fr GROUP BY 1")
def export_manifest(spark, sf):
    offs = F.array_join(F.transform(F.sort_array(F.collect_list("off")), lambda x: x.cast("string")), ",")
    return frames(spark, sf).groupBy("recording_id").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.sha2(offs, 256).alias("frames_sha256"))


@query("hash_appendix", "SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS ref, sha256(p_name) AS sha256 FROM part UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), sha256(html) FROM pages")
def hash_appendix(spark, sf):
    rows = lambda t, k, c, kind: table(spark, sf, t).select(F.lit(kind).alias("kind"), F.col(k).cast("string").alias("ref"), F.sha2(c, 256).alias("sha256"))
    return rows("part", "p_partkey", "p_name", "part").unionByName(rows("pages", "page_id", "html", "page"))


@query("dual_hash", "SELECT page_id, sha256(html) AS sha256, md5(html) AS md5 FROM pages")
def dual_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.md5(F.col("html").cast("binary")).alias("md5"))


@query("metric_rollup", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, count(value) AS n_available FROM events WHERE value IS NOT NULL GROUP BY 1")
def metric_rollup(spark, sf):
    return table(spark, sf, "events").where("value IS NOT NULL").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.count("value").alias("n_available"))


@query("distinct_channels", f"WITH {FR} SELECT DISTINCT channel FROM fr")
def distinct_channels(spark, sf):
    return frames(spark, sf).select("channel").distinct().orderBy("channel")


@query("identification_score", f"WITH {FR}, b AS (SELECT channel, max(value) / 100 AS conf, arg_max(kind, {{'v': value, 'o': -off}}) AS best FROM fr GROUP BY 1) SELECT channel, best, CASE WHEN channel % 3 = 2 THEN conf < 0.3 ELSE best = CASE WHEN channel % 3 = 0 THEN 'view' ELSE 'click' END END AS correct FROM b")
def identification_score(spark, sf):
    best = frames(spark, sf).groupBy("channel").agg((F.max("value") / 100).alias("conf"), F.max_by("kind", F.struct(F.col("value"), -F.col("off"))).alias("best"))
    third = F.col("channel") % 3
    correct = F.when(third == 2, F.col("conf") < 0.3).otherwise(F.col("best") == F.when(third == 0, "view").otherwise("click"))
    return best.select("channel", "best", correct.alias("correct"))


@query("content_id", "SELECT p_partkey, 'part_' || substr(sha256('{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\",\"note\":null,\"size\":' || p_size || '}'), 1, 16) AS id FROM part")
def content_id(spark, sf):
    text = custody.canonical({"name": (F.col("p_name"), True), "brand": (F.col("p_brand"), True), "size": (F.col("p_size"), False), "note": (F.lit(None).cast("string"), True)})
    return table(spark, sf, "part").select("p_partkey", custody.content_id("part", text).alias("id"))


@query("cross_case_first", "SELECT CAST(p_size AS BIGINT) AS id, min(p_brand) AS case_id FROM part GROUP BY 1")
def cross_case_first(spark, sf):
    """Where an id is held by several cases, the first case by name answers."""
    from frameloom.plans.case import first_case

    return first_case(table(spark, sf, "part").select(F.col("p_size").cast("long").alias("id"), F.col("p_brand").alias("case_id")))


@query("set_equality", f"WITH {FR}, a AS (SELECT channel, off FROM fr), b AS (SELECT channel, CASE WHEN off % 500 = 0 THEN -off ELSE off END AS off FROM fr) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right")
def set_equality(spark, sf):
    """Rows that either of two results has alone, whatever their order: both zero means equal. One aggregation."""
    fr = frames(spark, sf)
    a, b = fr.select("channel", "off", F.lit(1).alias("n")), fr.select("channel", F.expr("CASE WHEN off % 500 = 0 THEN -off ELSE off END").alias("off"), F.lit(-1).alias("n"))
    d = a.unionByName(b).groupBy("channel", "off").agg(F.sum("n").alias("n"))
    return d.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("only_right"))


@query("hash_lookup", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 = 0")
def hash_lookup(spark, sf):
    keys = table(spark, sf, "customer").where("c_custkey % 3 = 0").select("c_custkey", "c_name")
    return table(spark, sf, "orders").join(keys, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("earliest_live", f"WITH {REC} SELECT channel, min(start_us) FILTER (NOT deleted) AS live_us, arg_max(recording_id, {{'s': coalesce(start_us, 0), 'r': recording_id}}) AS newest FROM rec GROUP BY 1")
def earliest_live(spark, sf):
    rec = recordings(frames(spark, sf))
    return rec.groupBy("channel").agg(F.min(F.when(~F.col("deleted"), F.col("start_us"))).alias("live_us"), F.max_by("recording_id", F.struct(F.coalesce("start_us", F.lit(0)), F.col("recording_id"))).alias("newest"))


@query("field_candidates", "SELECT CAST(o AS BIGINT) AS off, CAST(w AS BIGINT) AS width, e AS endian FROM range(0, 32) a(o), (VALUES (2), (4), (8)) b(w), (VALUES ('big'), ('little')) c(e) WHERE o + w <= 32 AND (o >= 8 OR o + w <= 0)")
def field_candidates(spark, sf):
    """Every place, width and byte order of a header of 32 bytes that leaves out an eight-byte magic."""
    shape = F.explode(F.array(*(F.struct(F.lit(w).cast("long").alias("width"), F.lit(e).alias("endian")) for w in (2, 4, 8) for e in ("big", "little"))))
    return spark.range(32).select(F.col("id").alias("off"), shape.alias("s")).select("off", "s.width", "s.endian").where("off + width <= 32 AND off >= 8")


# SQL given by the user over registered views ------------------------------------------------

_SQL = {
    "sql_groupby": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_cube": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "sql_setops": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sql_window_rank": "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders",
    "sql_star_join": "SELECT r_name, c_mktsegment, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment",
    "sql_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "sql_full_join": "SELECT coalesce(c_custkey, o_custkey) AS k, count(o_orderkey) AS n FROM customer FULL JOIN orders ON c_custkey = o_custkey GROUP BY 1",
}


def ad_hoc(spark, sf: str, text: str):
    """Run SQL with the tables it names registered as temporary views."""
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        if name in text:
            table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(text)


def _register(name: str, text: str) -> None:
    query(name, text)(lambda spark, sf: ad_hoc(spark, sf, text))


for _name, _text in _SQL.items():
    _register(_name, _text)
