"""Byte-level queries over images rendered from ``events`` and over the bytes of ``documents``.

Images are decoded as any image is, from bytes alone; the SQL beside a query says from the source columns what there is to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.operators import bytescan, genome, infer, records
from frameloom.plans.registry import query
from frameloom.sources import rendered, synthetic
from frameloom.sources.images import bytes_of
from frameloom.sources.rendered import EV
from frameloom.sources.tables import table


def as_range(spark, image: bytes, base: int = 0, name: str = "img"):
    """One image or range as a row of the shape that scans and walks read."""
    return spark.createDataFrame([(name, base, base + len(image), -1, bytearray(image))], "image string, core_start long, core_end long, before int, data binary")


def images(spark, sf, render):
    return rendered.images_of(table(spark, sf, "events"), render)


def first_image(spark, sf, render):
    """img0 alone; no other image is rendered for it."""
    return rendered.images_of(table(spark, sf, "events").where(F.col("event_id").between(0, rendered.PER_IMAGE - 1)), render)


def _along(length: str, part: str = "image") -> str:
    """The bytes before an event in its image."""
    return f"coalesce(CAST(sum({length}) OVER (PARTITION BY {part} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0)"


_TYPE = "CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 7 WHEN 'purchase' THEN 6 ELSE 1 END"
_HALF = rendered.PER_IMAGE // 2
#: Framed records: 37 bytes beside n, in two runs with 64 bytes between.
_DH = EV + f", dh AS (SELECT *, k // {_HALF} AS run, 37 + n AS size, 4096 + 64 * (k // {_HALF}) + {_along('37 + n')} AS header_offset, user_id % 100 + 1 AS channel FROM ev)"
_FRAME_SQL = "image, header_offset, header_offset + 24 AS payload_offset, 5 + n AS payload_len, channel, CASE WHEN event_type = 'error' THEN 'I' ELSE 'P' END AS kind, us // 1000 * 1000 AS ts_us"
_FRAME = ["image", "header_offset", "payload_offset", "payload_len", "channel", "kind", "ts_us"]


@query("annexb_scan", f"WITH {EV} SELECT image, {_along('n + CASE WHEN event_id % 3 = 0 THEN 4 ELSE 5 END')} AS \"offset\", CASE WHEN event_id % 3 = 0 THEN 3 ELSE 4 END AS sc_len, {_TYPE} AS nal_type FROM ev")
def annexb_scan(spark, sf):
    return bytescan.scan_annexb(images(spark, sf, rendered.stream))


@query("image_signatures", f"WITH {_DH} SELECT image, 0 AS pattern, header_offset AS \"offset\" FROM dh UNION ALL SELECT image, 1, header_offset + 29 + n FROM dh UNION ALL SELECT DISTINCT image, 2, 0 FROM dh")
def image_signatures(spark, sf):
    return bytescan.scan_signatures(images(spark, sf, rendered.indexed), [records.DHAV, records.DHAV_END, records.DH_MAGIC])


@query("image_entropy", "WITH b AS (SELECT doc_id, unnest(l) AS byte, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents)), n AS (SELECT doc_id, i // 4096 * 4096 AS \"offset\", byte, count(*) AS n FROM b GROUP BY 1, 2, 3), s AS (SELECT doc_id, \"offset\", sum(n) AS t, sum(n * log2(n)) AS x FROM n GROUP BY 1, 2) SELECT doc_id, \"offset\", round(log2(t) - x / t, 6) + 0.0 AS entropy FROM s")
def image_entropy(spark, sf):
    """Bits a byte of every 4096 bytes of each text."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    rows = d.select(F.col("doc_id").cast("string").alias("image"), F.lit(0).cast("long").alias("core_start"), F.octet_length("text").cast("long").alias("core_end"), F.lit(-1).alias("before"), F.encode("text", "UTF-8").alias("data"))
    return bytescan.block_entropy(rows, 4096).select(F.col("image").cast("long").alias("doc_id"), "offset", F.round("entropy", 6).alias("entropy"))


@query("dhsim_index", f"WITH {_DH} SELECT image, run AS slot, run = 0 AS live, arg_min(channel, k) AS channel, arg_min(us // 1000000, k) * 1000000 AS start_us, arg_max(us // 1000000, k) * 1000000 AS end_us, min(header_offset) AS \"offset\", CAST(sum(size) AS BIGINT) AS length FROM dh GROUP BY 1, 2")
def dhsim_index(spark, sf):
    return records.indexed(images(spark, sf, rendered.indexed)).select("image", "slot", "live", "channel", "start_us", "end_us", "offset", "length")


@query("dhav_walk", f"WITH {_DH} SELECT {_FRAME_SQL} FROM dh")
def dhav_walk(spark, sf):
    """Frames of every indexed range, one walk a range; a range's bytes are read by its place."""
    whole = images(spark, sf, rendered.indexed)
    spans = records.indexed(whole).select("image", F.col("offset").alias("start"), "length")
    ranges = bytes_of(spans, whole).select("image", F.col("start").alias("core_start"), (F.col("start") + F.col("length")).alias("core_end"), F.lit(-1).alias("before"), "data")
    return records.walked(ranges, "dhsim").select(*_FRAME)


@query("dhav_carve", f"WITH {_DH} SELECT {_FRAME_SQL}, run FROM dh")
def dhav_carve(spark, sf):
    return records.carved(images(spark, sf, rendered.indexed), "dhsim").select(*_FRAME, "run")


_PS = EV + (
    ", ps AS (SELECT *, 14 + 14 + n + CASE WHEN k % 8 = 3 THEN 17 ELSE 0 END AS size, us * 9 // 100 % 8589934592 AS pts, CASE WHEN k % 8 = 3 THEN {'pts': us * 9 // 100 % 8589934592, 'ts': us // 1000 * 1000, 'channel': user_id % 100 + 1} END AS a FROM ev),"
    " an AS (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY image ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, first_value(a IGNORE NULLS) OVER (PARTITION BY image ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM ps)"
)
_AGO = lambda d: f"CAST(round_even((({d}) & 8589934591) * 1000000 / 90000, 0) AS BIGINT)"


@query("ps_anchor", f"WITH {_PS} SELECT image, {_along('size')} AS header_offset, 5 + n AS payload_len, pts, CASE WHEN l IS NOT NULL THEN l.ts + {_AGO('pts - l.pts')} ELSE f.ts - {_AGO('f.pts - pts')} END AS ts_us, coalesce(l.channel, f.channel) AS channel, CASE WHEN event_type = 'error' THEN 'I' ELSE 'P' END AS kind FROM an")
def ps_anchor(spark, sf):
    """Times and channels of all frames of a program stream from the anchors that few of them carry."""
    frames = records.walked(images(spark, sf, rendered.packs), "hiksim")
    return records.anchored(frames, ["image", "run"]).select("image", "header_offset", "payload_len", "pts", "ts_us", "channel", "kind")


_HW = EV + f", hw AS (SELECT *, {_TYPE} AS t, 37 + {_along('25 + n')} AS header_offset FROM ev)"


@query("hwsim_carve", f"WITH {_HW} SELECT image, header_offset, header_offset + 20 AS payload_offset, 5 + n AS payload_len, us AS ts_us, CASE t WHEN 5 THEN 'I' WHEN 7 THEN 'SPS' WHEN 6 THEN 'SEI' ELSE 'P' END AS kind FROM (SELECT *, max(CASE WHEN t IN (1, 5) THEN k END) OVER (PARTITION BY image) AS z FROM hw) WHERE k <= z")
def hwsim_carve(spark, sf):
    """Headed units up to the last slice of their run."""
    return records.carved(images(spark, sf, rendered.headed), "hwsim").select("image", "header_offset", "payload_offset", "payload_len", "ts_us", "kind")


_CODE = "CASE event_type WHEN 'view' THEN 'playback' WHEN 'click' THEN 'login' WHEN 'signup' THEN 'time_change' WHEN 'purchase' THEN 'export' END"


@query("rats_logs", f"WITH {EV} SELECT image, 64 * k AS \"offset\", us // 1000000 * 1000000 AS ts_us, {_CODE} AS kind, 'u' || user_id AS \"user\", nullif(user_id % 7, 0) AS channel, us // 1000000 AS old_s, us // 1000000 - 60 AS new_s, CASE WHEN k < {_HALF} THEN 'area' ELSE 'carved' END AS found FROM ev WHERE event_type <> 'error'")
def rats_logs(spark, sf):
    """Log records: the first half of each image as the declared area, all of it searched for others."""
    whole = images(spark, sf, rendered.logged)
    area = whole.withColumn("data", F.substring("data", 1, 64 * _HALF)).withColumn("core_end", F.least("core_end", F.lit(64 * _HALF).cast("long")))
    return records.logs(area, whole, "rats").select("image", "offset", "ts_us", "kind", "user", "channel", F.col("param1").alias("old_s"), F.col("param2").alias("new_s"), "found")


def layout_of(windows):
    """(samples, layout) of the units of windows."""
    sampled = infer.samples(infer.unit_starts(bytescan.scan_annexb(windows)), windows)
    return sampled, infer.infer(sampled)


@query("infer_layout", "SELECT * FROM (VALUES ('channel', 8, 2, 'little', 'none'), ('length', 12, 4, 'big', 'none'), ('timestamp', 16, 8, 'little', 'ms'), ('sequence', 24, 4, 'little', 'none'), ('flags', 28, 4, 'little', 'none')) AS f(field, \"offset\", width, endian, unit) WHERE EXISTS (SELECT 1 FROM events)")
def infer_layout(spark, sf):
    """The fields of an unknown recorder's header, from the units of its first image."""
    _, layout = layout_of(first_image(spark, sf, rendered.unheard))
    return spark.createDataFrame([(f.name, f.offset, f.width, f.endian, f.unit) for f in layout.fields] if layout else [], "field string, offset int, width int, endian string, unit string")


_UN = EV + f", un AS (SELECT *, CASE WHEN event_type = 'error' THEN 15 + 3 * n ELSE 5 + n END AS size FROM ev), pl AS (SELECT *, {rendered.LEAD} + {_along('32 + size')} AS header_offset FROM un)"


@query("replay_layout", f"WITH {_UN} SELECT image, user_id % 4 + 1 AS channel, header_offset, header_offset + 32 AS payload_offset, size AS payload_len, (CAST({synthetic.EPOCH} AS BIGINT) * 1000 + 40 * event_id) * 1000 AS ts_us, CASE WHEN event_type = 'error' THEN 'I' ELSE 'P' END AS kind FROM pl")
def replay_layout(spark, sf):
    """Every unit of all images read through the layout that the first one shows."""
    whole = images(spark, sf, rendered.unheard)
    _, layout = layout_of(first_image(spark, sf, rendered.unheard))
    return infer.replayed_units(infer.unit_starts(bytescan.scan_annexb(whole), headers=infer.header_ends(whole, layout)), whole, layout)


#: Signatures and their regions are fixed values of the formats.
GENOME = [
    genome.Family("hiksim", (genome.Signature(b"HIKVISION@HANGZHOU", 0.7, 0, 0x10000), genome.Signature(b"HIKBTREE", 0.2, 0, 0x4000000), genome.Signature(b"IMKH", 0.1, 0, genome.ANYWHERE)), tier="A", model_at=(0x300, 32), serial_at=(0x320, 48)),
    genome.Family("dhsim", (genome.Signature(b"DHFS4.1\0", 0.7, 0, 0x10000), genome.Signature(b"DHAV", 0.2, 0, genome.ANYWHERE), genome.Signature(b"DHLG", 0.1, 0, genome.ANYWHERE)), tier="A", model_at=(0x40, 32), serial_at=(0x80, 48)),
    genome.Family("hwsim", (genome.Signature(b"HONEYWELL-NVR-SIM", 0.7, 0, 0x400000), genome.Signature(b"HWSYS", 0.2, 0, 0x40000000)), tier="A"),
    genome.Family("xsim", (genome.Signature(b"XVR-GENERIC-2026", 0.3, 0, 0x1000),), tier="B"),
    genome.Family("gensim"),
]
_FAMILIES = ", ".join(f"({k}, '{f.family}')" for k, f in enumerate(GENOME))


@query(
    "genome_match",
    f"WITH {_DH}, im AS (SELECT image, count(*) AS n, min(event_id) AS e FROM ev GROUP BY 1), k AS (SELECT 'dh-' || image AS image, n, e, true AS dh FROM im UNION ALL SELECT 'un-' || image, n, e, false FROM im),"
    f" s AS (SELECT image, n, e, place, family, CASE WHEN dh AND family = 'dhsim' THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM k, (VALUES {_FAMILIES}) AS g(place, family))"
    " SELECT image, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, place) AS place, family, confidence, CASE WHEN confidence > 0 THEN 2 ELSE 0 END AS n_evidence, CASE WHEN confidence > 0 THEN 'XVR-' || n END AS model, CASE WHEN confidence > 0 THEN 'SN' || lpad(CAST(e AS VARCHAR), 6, '0') END AS serial FROM s",
)
def genome_match(spark, sf):
    """Every family's confidence for known and unknown recorders' images, with model and serial of those that match."""
    kinds = {"dh-": rendered.indexed, "un-": rendered.unheard}
    known, unknown = (images(spark, sf, render).withColumn("image", F.concat(F.lit(name), F.col("image"))) for name, render in kinds.items())
    out = genome.matched(known.union(unknown), GENOME)
    return out.select("image", "place", "family", "confidence", F.size("evidence").alias("n_evidence"), "model", "serial")
