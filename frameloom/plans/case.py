"""A case end to end: staged inputs, custody, carving, deletion, manifests and exports.

The functions here return DataFrames and are what an application calls; steps that
are one file or one row by nature (acquiring an image, a sidecar, a signature) stay on the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from frameloom.operators import bytescan, custody, infer, intervals, records, segments, signatures
from frameloom.sources.images import bytes_of
from frameloom.sources.tables import FRAME_SCHEMA

STAGES = ("index", "carved", "inferred")
CHUNK = 8 << 20


# Sources and sinks ------------------------------------------------------------------------------


def staged(spark: SparkSession, folder: str, stages: Iterable[str] = STAGES) -> DataFrame:
    """Staged JSON of each stage that is there, united in the stages' order, with ``stage``."""
    from frameloom.operators.lookup import tolerant

    out = spark.createDataFrame([], T.StructType([*FRAME_SCHEMA.fields, T.StructField("stage", T.StringType())]))
    for stage in stages:
        path = os.path.join(folder, f"{stage}.json")
        if os.path.exists(path):
            out = out.unionByName(tolerant(spark.read.schema(FRAME_SCHEMA).json(path), FRAME_SCHEMA).withColumn("stage", F.lit(stage)))
    return out


def custody_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a custody mirror, one canonical JSON line each, with the raw line kept."""
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    field = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind).alias(name)
    return raw.select(field("seq", "long"), field("prev_hash", "string"), field("entry_hash", "string"), field("actor", "string"), field("action", "string"), field("signature", "string"), F.col("value").alias("line"))


def custody_verified(log: DataFrame, genesis: str, keys: dict[str, str] | None = None, pieces: int | None = None) -> DataFrame:
    """Entries, the first whose number, link, hash or signature is wrong, and the head's hash if none is.

    The hash is over the line without its own hash and signature. With ``keys`` (hex Ed25519 keys by actor) each entry must be signed by its actor.
    """
    body = F.regexp_replace("line", '"(entry_hash|signature)":"[^"]*",', "")
    body = F.regexp_replace(body, ',"(entry_hash|signature)":"[^"]*"(?=})', "")
    one = log.withColumn("chain", F.lit("log")).withColumn("expected", F.sha2(body, 256))
    holds = None
    if keys is not None:
        known = F.create_map(*(F.lit(x) for pair in keys.items() for x in pair)) if keys else F.create_map().cast("map<string,string>")
        one = signatures.verified(one.withColumn("_key", F.try_element_at(known, F.col("actor"))), "_key", "entry_hash", "signature", "_signed")
        holds = F.col("_signed")
    return custody.first_broken(one, ["chain"], "seq", "prev_hash", "entry_hash", F.col("expected"), genesis, holds, pieces)


def custody_lines(entries: list[dict], genesis: str, start: int = 0, sign: Callable[[str, str], str] | None = None) -> list[str]:
    """Canonical lines that continue a chain; ``sign`` gives an actor's signature of a hash, in base64."""
    prev, out = genesis, []
    for seq, entry in enumerate(entries, start + 1):
        body = json.dumps({**entry, "seq": seq, "prev_hash": prev}, sort_keys=True, separators=(",", ":"))
        prev = hashlib.sha256(body.encode()).hexdigest()
        signed = {"signature": sign(entry["actor"], prev)} if sign else {}
        out.append(json.dumps({**json.loads(body), "entry_hash": prev, **signed}, sort_keys=True, separators=(",", ":")))
    return out


def anchors(log: DataFrame, every: int) -> DataFrame:
    """Merkle root of each block of ``every`` entries, chained: first and last number, root, link."""
    block = log.withColumn("block", F.floor((F.col("seq") - 1) / every).cast("long"))
    roots = custody.merkle_root(block, ["block"], "seq", "entry_hash")
    spans = block.groupBy("block").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    before = roots.select((F.col("block") + 1).alias("block"), F.col("root").alias("prev_root"))
    return roots.join(spans, "block").join(before, "block", "left").orderBy("block")


def first_case(ids: DataFrame) -> DataFrame:
    """The case in which an id is looked up: the first by name of those that hold it."""
    return ids.groupBy("id").agg(F.min("case_id").alias("case_id"))


def allowed(path: str, roots: Iterable[str]) -> bool:
    """Whether a path, links resolved, lies under one of the roots."""
    real = os.path.realpath(path)
    return any(os.path.commonpath([real, base]) == base for base in map(os.path.realpath, roots))


def listing(spark: SparkSession, folder: str, roots: Iterable[str]) -> DataFrame:
    """Entries of an allowed folder by name: size, time, and whether one looks like an image."""
    if not allowed(folder, roots):
        raise PermissionError(folder)
    rows = []
    for e in sorted(os.scandir(folder), key=lambda e: e.name):
        s = e.stat()
        rows.append((e.name, e.is_dir(), s.st_size, int(s.st_mtime), e.name.lower().endswith((".raw", ".dd", ".img", ".e01", ".bin"))))
    return spark.createDataFrame(rows, "name string, is_dir boolean, size long, mtime long, looks_like_image boolean")


def hashes(path: str, seen: Callable[[int], None] | None = None) -> tuple[str, str, int]:
    """(sha256, md5, size) in one pass."""
    a, b, n = hashlib.sha256(), hashlib.md5(), 0
    with open(path, "rb") as f:
        while part := f.read(CHUNK):
            a.update(part)
            b.update(part)
            n += len(part)
            if seen:
                seen(n)
    return a.hexdigest(), b.hexdigest(), n


def acquire(source: str, target: str) -> dict:
    """Copy an image, read the copy again, and leave a canonical sidecar; ValueError if they differ."""
    before = hashes(source)
    with open(source, "rb") as a, open(target, "xb") as b:
        while part := a.read(CHUNK):
            b.write(part)
    after = hashes(target)
    if before != after:
        raise ValueError("the copy differs from its source")
    record = {"source": os.path.basename(source), "sha256": after[0], "md5": after[1], "size_bytes": after[2], "verified": True}
    with open(f"{target}.provenance.json", "w") as f:
        json.dump(record, f, sort_keys=True, separators=(",", ":"))
    return record


# Carving ----------------------------------------------------------------------------------------


def generic_carve(windows: DataFrame, codec: str = "h264", pieces: int | None = None) -> DataFrame:
    """Access units of any image by start codes alone: place, length, kind, size, and a channel guessed by parameter set.

    Units end where the next begins, the last one of a range with the range; what no slice follows in
    its range goes. Width, height and profile of the first parameter set of a unit name its cluster;
    clusters are numbered by first appearance and carried forward; before the first there is none, and
    parameter sets that cannot be read name none (of H.265 none is read). ``codec`` "auto" decides by image, before units are
    grouped. An image is scanned in ``pieces``, whose number changes nothing.
    """
    if codec == "auto":
        told = bytescan.codecs(windows).select("image", "codec")
        marks = [records.scan_units(windows.join(told.where(F.col("codec") == c), "image", "left_semi").select(windows.columns), c) for c in ("h264", "h265")]
        marks = marks[0].unionByName(marks[1])
    else:
        marks = records.scan_units(windows, codec)
    marks = marks.where(F.col("nal_type").isin(-2, -1, 1, 5, 6, 7, 8, 9))
    same = Window.partitionBy("image", "offset")
    marks = marks.withColumn("_m", F.count(F.when(F.col("nal_type") < 0, 1)).over(same)).where("nal_type > 0 OR nal_type = -1 AND _m = 1").drop("_m")
    where = (["image"], ["offset", "nal_type"])
    closes = F.col("nal_type").isin(1, 5)
    laid = segments.segmented(marks, *where, pieces)
    rows = segments.scanned(laid, *where, sums={"range": (F.col("nal_type") == -1).cast("int"), "_upto": closes.cast("int")}, lead={"end": F.col("offset")})
    rows = rows.where("nal_type > 0").withColumn("unit", F.col("_upto") - closes.cast("int"))
    size = F.struct("width", "height", "profile")
    set_ = F.min_by(F.when(F.col("width").isNotNull(), size), F.when(F.col("nal_type") == 7, F.col("offset")))
    out = rows.groupBy("image", "range", "unit").agg(F.min("offset").alias("payload_offset"), F.max("end").alias("end"), F.bool_or(F.col("nal_type") == 5).alias("key"), F.bool_or(closes).alias("_has"), set_.alias("set"))
    where = (["image"], ["payload_offset"])
    units = segments.segmented(out.where("_has").drop("_has"), *where, pieces)
    # clusters by the place where their set is first seen
    first = units.where("set IS NOT NULL").groupBy("image", "set").agg(F.min("payload_offset").alias("_f"))
    ranks = segments.scanned(segments.segmented(first.withColumnRenamed("image", "_i"), ["_i"], ["_f"], pieces), ["_i"], ["_f"], sums={"_rank": F.lit(1)})
    ranks = ranks.select("_i", F.col("set").alias("_s"), F.col("_rank").cast("int").alias("_rank"))
    seen = units.join(ranks, (F.col("image") == F.col("_i")) & (F.col("set") == F.col("_s")), "left")
    named = segments.scanned(seen.drop("_i", "_s"), *where, last={"channel": F.col("_rank")})
    return named.select("image", "payload_offset", (F.col("end") - F.col("payload_offset")).alias("payload_len"), F.when(F.col("key"), "I").otherwise("P").alias("frame_type"), "channel", "set.width", "set.height", F.lit("carved").alias("source"), F.lit(True).alias("deleted"))


def unindexed(index: DataFrame, low: Column, high: Column) -> DataFrame:
    """The parts of the data area that no live entry of the index covers."""
    live = index.where("live").select("image", "offset", (F.col("offset") + F.col("length")).alias("stop"))
    return intervals.complement(live, ["image"], "offset", "stop", low, high)


def identified(windows: DataFrame, genome: dict[str, list[tuple[bytes, float]]], least: float = 0.3) -> DataFrame:
    """Families of an image by summed weights of the signatures found, 1 at most, best first."""
    flat = [(family, sig, weight) for family, sigs in genome.items() for sig, weight in sigs]
    hits = bytescan.scan_signatures(windows, [sig for _, sig, _ in flat]).select("image", "pattern").distinct()
    known = windows.sparkSession.createDataFrame([(i, f, w) for i, (f, _, w) in enumerate(flat)], "pattern int, family string, weight double")
    score = F.least(F.lit(1.0), F.round(F.sum("weight"), 6))
    return hits.join(F.broadcast(known), "pattern").groupBy("image", "family").agg(score.alias("confidence")).where(F.col("confidence") >= least)


def carve_with(windows: DataFrame, family: str | None) -> DataFrame:
    """By the family's own records if it has a walk, else by start codes; layouts are inferred for unknown ones.

    Windows must reach beyond their core by the largest record, and by ``infer.SPAN`` bytes for unknown recorders.
    """
    if family in records.WALKS:
        return records.carved(windows, family)
    nals = bytescan.scan_annexb(windows)
    layout = infer.infer(infer.samples(infer.unit_starts(nals), windows))
    if not layout or not layout.fields:
        return generic_carve(windows)
    return infer.replayed_units(infer.unit_starts(nals, headers=infer.header_ends(windows, layout)), windows, layout)


# Views and exports ------------------------------------------------------------------------------


def hex_view(frames: DataFrame, source: DataFrame | None = None, before: int = 16, after: int = 16) -> DataFrame:
    """Bytes about each frame (image, frame_id, payload_offset, payload_len, payload_sha256), the sector of its start, and whether its payload still has its hash.

    Bytes are read by place where the task is, from the image's path or from windows (``images.bytes_of``).
    """
    lead = F.least(F.lit(before), F.col("payload_offset"))
    spans = frames.select("image", "frame_id", "payload_offset", "payload_len", "payload_sha256", (F.col("payload_offset") - lead).alias("start"), (lead + F.col("payload_len") + after).alias("length"))
    shown = bytes_of(spans, source)
    now = F.sha2(F.substring(F.col("data"), (lead + 1).cast("int"), F.col("payload_len").cast("int")), 256)
    return shown.select("frame_id", F.lower(F.hex("data")).alias("shown"), F.floor(F.col("payload_offset") / 512).cast("long").alias("sector"), now.alias("sha256"), (now == F.col("payload_sha256")).alias("intact"))


def manifest(frames: DataFrame, key: str = "recording_id") -> DataFrame:
    """Per recording: ids and ranges in order, first and last time, and the hash of it all."""
    span = F.struct(F.col("payload_offset").alias("offset"), F.col("payload_len").alias("length"))
    out = frames.groupBy(key).agg(F.sort_array(F.collect_list("frame_id")).alias("frame_ids"), F.sort_array(F.collect_list(span)).alias("ranges"), F.min("ts_header_us").alias("first_us"), F.max("ts_header_us").alias("last_us"))
    shown = F.array_join(F.transform("ranges", lambda x: F.concat_ws("+", x["offset"].cast("string"), x["length"].cast("string"))), ",")
    return out.withColumn("manifest_sha256", F.sha2(F.concat_ws("|", F.array_join("frame_ids", ","), shown), 256))


def listed(rows: DataFrame, buckets: int = 4) -> DataFrame:
    """count and sha256 of a list's rows, whatever their order: rows hash as JSON of their columns by name, nulls written.

    Hashes meet in buckets by their first ``buckets`` digits, each in order, and the buckets' hashes in order make the list's, so no
    task holds more than a bucket's share.
    """
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))), {"ignoreNullFields": "false"})
    hashes = rows.select(F.sha2(whole, 256).alias("h"))
    held = hashes.groupBy(F.substring("h", 1, buckets).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    named = F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])
    return held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.sha2(F.array_join(named, ""), 256).alias("sha256"))


def case_manifest(facts: dict, lists: dict[str, DataFrame], limitations: Iterable[str] = ()) -> tuple[dict, str]:
    """(manifest, its hash) over a case's facts and all of its lists (evidence, matches, recordings, findings, clocks, logs, drafts, anchors), each by count and hash.

    The same rows in any order, and facts in any order, give the same bytes.
    """
    told = {}
    for name in sorted(lists):
        r = listed(lists[name]).first()
        told[name] = {"count": r["count"], "sha256": r["sha256"]}
    whole = {"facts": facts, "lists": told, "limitations": list(limitations)}
    raw = json.dumps(whole, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return json.loads(raw), hashlib.sha256(raw.encode()).hexdigest()


def export_verified(claims: DataFrame, found: DataFrame, key: str = "export_id", keys: dict[str, str] | None = None) -> DataFrame:
    """Whether each export's bytes, manifest and signature match its claim, and why not.

    With ``keys`` (hex Ed25519 keys by examiner) claims also hold ``manifest`` (its text), ``examiner`` and ``signature`` (base64).
    """
    f = found.select(F.col(key).alias("_k"), F.col("video_sha256").alias("_v"), F.col("manifest_sha256").alias("_m"))
    why = [
        F.when(F.col("_k").isNull(), "missing"),
        F.when(F.col("_v") != F.col("video_sha256"), "video hash differs"),
        F.when(F.col("_m") != F.col("manifest_sha256"), "manifest hash differs"),
    ]
    if keys is not None:
        known = F.create_map(*(F.lit(x) for pair in keys.items() for x in pair)) if keys else F.create_map().cast("map<string,string>")
        claims = signatures.verified(claims.withColumn("_key", F.try_element_at(known, F.col("examiner"))), "_key", "manifest", "signature", "_signed")
        why += [
            F.when(F.col("signature").isNull(), "not signed"),
            F.when(F.col("_key").isNull(), F.concat(F.lit("no key of examiner "), F.coalesce("examiner", F.lit("?")))),
            F.when(F.col("signature").isNotNull() & F.col("_key").isNotNull() & ~F.col("_signed"), "signature does not hold"),
        ]
    reasons = F.array_compact(F.array(*why))
    out = claims.join(f, claims[key] == F.col("_k"), "left")
    return out.select(key, (F.size(reasons) == 0).alias("valid"), reasons.alias("reasons"))
