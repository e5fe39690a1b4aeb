"""Case-level functions on small inputs."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import bytescan, lookup, records
from frameloom.plans import case
from frameloom.plans.images import as_range
from frameloom.sources import images, synthetic, tables


def frame(**values):
    return {**{f.name: None for f in tables.FRAME_SCHEMA}, **values}


def test_frame_index_round_trip_and_update(spark, tmp_path):
    rows = [frame(frame_id=f"f{i}", image_id="img" if i % 2 else "other", channel=i % 3, payload_offset=i, ts_header_us=None if i == 2 else i) for i in range(6)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], tables.FRAME_SCHEMA)
    tables.write_frames(df, str(tmp_path / "frames"))
    tables.write_frames(df.where("image_id = 'img' AND payload_offset < 2"), str(tmp_path / "frames"))
    got = tables.read_frames(spark, str(tmp_path / "frames"))
    assert got.schema.names == tables.FRAME_SCHEMA.names
    assert sorted(r.frame_id for r in got.collect()) == ["f0", "f1", "f2", "f4"]
    new = tables.updated(got, spark.createDataFrame([("f1", 9), ("f2", None)], "frame_id string, ts_norm_us long"), "frame_id")
    assert {r.frame_id: r.ts_norm_us for r in new.collect()} == {"f0": None, "f1": 9, "f2": None, "f4": None}


def test_staged_files_unite_in_order(spark, tmp_path):
    for stage in ("carved", "index"):
        (tmp_path / f"{stage}.json").write_text(json.dumps({"frame_id": stage, "payload_offset": 5}))
    assert [(r.stage, r.frame_id) for r in case.staged(spark, str(tmp_path)).collect()] == [("index", "index"), ("carved", "carved")]
    assert case.staged(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("tamper", [None, 1, 3])
def test_custody_chain(spark, tmp_path, tamper):
    lines = case.custody_lines([{"actor": "a", "action": f"x{i}"} for i in range(4)], "genesis")
    if tamper is not None:
        lines[tamper] = lines[tamper].replace('"action":"x', '"action":"y')
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    got = case.custody_verified(case.custody_log(spark, str(tmp_path / "log.jsonl")), "genesis").first()
    assert (got.n_entries, got.first_bad) == (4, None if tamper is None else tamper + 1)


def test_anchor_ledger(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(case.custody_lines([{"action": str(i)} for i in range(5)], "g")))
    got = case.anchors(case.custody_log(spark, str(tmp_path / "log.jsonl")), 2).collect()
    assert [(r.first_seq, r.last_seq) for r in got] == [(1, 2), (3, 4), (5, 5)] and got[1].prev_root == got[0].root


def test_acquire_and_roots(spark, tmp_path):
    source = tmp_path / "a.raw"
    source.write_bytes(b"x" * 1000)
    record = case.acquire(str(source), str(tmp_path / "b.raw"))
    assert record["sha256"] == hashlib.sha256(b"x" * 1000).hexdigest()
    names = [r.name for r in case.listing(spark, str(tmp_path), [str(tmp_path)]).collect()]
    assert names == ["a.raw", "b.raw", "b.raw.provenance.json"]
    with pytest.raises(PermissionError):
        case.listing(spark, "/etc", [str(tmp_path)])


def test_generic_carve_and_identification(spark):
    image = synthetic.dh_image()
    rows = case.generic_carve(as_range(spark, image[0x1000:], 0x1000)).orderBy("payload_offset").collect()
    assert len(rows) == 36 and rows[0].frame_type == "I" and rows[0].channel == 1 and rows[1].frame_type == "P"
    got = case.identified(as_range(spark, image), {"dhsim": [(records.DH_MAGIC, 0.6), (records.DHAV, 0.6)], "hiksim": [(records.HIK_MAGIC, 0.9)]}).collect()
    assert [(r.family, r.confidence) for r in got] == [("dhsim", 1.0)]
    assert case.carve_with(as_range(spark, image), "dhsim").count() == 36
    unknown = synthetic.unknown_image()
    assert case.carve_with(as_range(spark, unknown), None).count() > 100


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_generic_carve_clusters_by_size_and_profile(spark, tmp_path, size):
    rnd = random.Random(3)
    cut = synthetic.access_unit(False, rnd)
    streams = [synthetic.parameter_set(*p) + synthetic.nal(5, rnd) + cut for p in ((704, 576), (352, 576), (704, 576, 77), (704, 576))]
    assert len({len(s) for s in streams}) < 4 and records.sps(synthetic.parameter_set(352, 576)[5:])["width"] == 352
    path = tmp_path / "image.raw"
    path.write_bytes(cut + b"".join(streams) + synthetic.parameter_set())
    rows = case.generic_carve(images.read_windows(spark, str(path), overlap=64, size=size)).orderBy("payload_offset").collect()
    assert [r.channel for r in rows] == [None, 1, 1, 2, 2, 3, 3, 1, 1]
    assert [r.width for r in rows] == [None, 704, None, 352, None, 704, None, 704, None]
    assert rows[-1].payload_len == len(cut) and sum(r.payload_len for r in rows) == len(cut) * 1 + sum(map(len, streams))


def test_generic_carve_keeps_ranges_apart(spark):
    rnd = random.Random(3)
    a, b = synthetic.parameter_set() + synthetic.nal(5, rnd), synthetic.access_unit(False, rnd)
    ranges = as_range(spark, a + synthetic.parameter_set()).union(as_range(spark, b, 5000))
    rows = case.generic_carve(ranges).orderBy("payload_offset").collect()
    assert [(r.payload_offset, r.payload_len) for r in rows] == [(0, len(a)), (5000, len(b))]


def test_unindexed_ranges(spark):
    image = synthetic.dh_image()
    index = records.indexed(as_range(spark, image))
    freed = index.where("NOT live").first()
    gaps = case.unindexed(index, F.lit(0x1000), F.lit(len(image))).orderBy("gap_start").collect()
    assert gaps[0].gap_start < freed.offset and gaps[0].gap_end > freed.offset + freed.length


def test_hex_view_manifest_and_export(spark, tmp_path):
    image = bytes(range(256)) * 8
    sha = hashlib.sha256(image[600:610]).hexdigest()
    rows = [frame(frame_id="a", payload_offset=600, payload_len=10, payload_sha256=sha, recording_id="r", ts_header_us=5), frame(frame_id="b", payload_offset=20, payload_len=4, payload_sha256="0", recording_id="r", ts_header_us=9)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], tables.FRAME_SCHEMA)
    path = tmp_path / "image.raw"
    path.write_bytes(image)
    placed = df.withColumn("image", F.lit(str(path)))
    for source in (None, as_range(spark, image, name=str(path)), images.evidence(spark, str(path), overlap=64, window=500)):
        got = {r.frame_id: r for r in case.hex_view(placed, source, 2, 1).collect()}
        assert got["a"].shown == image[598:611].hex() and got["a"].intact and got["b"].sha256 != "0"
    assert got["a"].intact and got["a"].sector == 1 and got["a"].shown == image[598:611].hex() and not got["b"].intact
    m = case.manifest(df).first()
    assert m.frame_ids == ["a", "b"] and [tuple(x) for x in m.ranges] == [(20, 4), (600, 10)] and (m.first_us, m.last_us) == (5, 9)
    claims = spark.createDataFrame([("e1", "v", "m"), ("e2", "v", "m"), ("e3", "v", "m")], "export_id string, video_sha256 string, manifest_sha256 string")
    found = spark.createDataFrame([("e1", "v", "m"), ("e2", "w", "m")], "export_id string, video_sha256 string, manifest_sha256 string")
    assert {r.export_id: list(r.reasons) for r in case.export_verified(claims, found).collect()} == {"e1": [], "e2": ["video hash differs"], "e3": ["missing"]}


def test_first_case(spark):
    ids = spark.createDataFrame([("x", "case-b"), ("x", "case-a"), ("y", "case-c")], "id string, case_id string")
    assert {r.id: r.case_id for r in case.first_case(ids).collect()} == {"x": "case-a", "y": "case-c"}


def test_codecs_are_told_apart_before_grouping(spark):
    rnd = random.Random(9)
    unit = lambda header, n=20: b"\x00\x00\x00\x01" + header + bytes(rnd.randrange(4, 256) for _ in range(n))
    key, cut = unit(b"\x40\x01") + unit(b"\x42\x01") + unit(b"\x44\x01") + unit(b"\x26\x01"), unit(b"\x02\x01")
    new = key + cut + cut + key + cut
    old = b"".join(synthetic.access_unit(i % 3 == 0, rnd) for i in range(7))
    windows = as_range(spark, new, name="new").union(as_range(spark, old, name="old"))
    told = {r.image: (r.codec, r.h264, r.h265) for r in bytescan.codecs(windows).collect()}
    assert told["new"][0] == "h265" and told["old"][0] == "h264" and told["new"][2] == 6
    rows = case.generic_carve(windows, "auto").orderBy("image", "payload_offset").collect()
    assert [r.frame_type for r in rows if r.image == "new"] == ["I", "P", "P", "I", "P"]
    assert [r.payload_len for r in rows if r.image == "new"] == [len(key), len(cut), len(cut), len(key), len(cut)]
    assert sorted(map(str, (r for r in rows if r.image == "old"))) == sorted(map(str, case.generic_carve(windows.where("image = 'old'")).collect()))
    either = [(r.nal_type, r.codec) for r in bytescan.scan_either(windows.where("image = 'new'")).orderBy("offset").collect()]
    assert either[1:4] == [(33, "h265"), (34, "h265"), (19, "h265")]


def test_case_manifest_does_not_depend_on_order(spark):
    rows = spark.range(500).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("channel"))
    none = rows.limit(0)
    one = case.case_manifest({"number": "C-1", "title": "x"}, {"recordings": rows, "findings": none}, ["synthetic"])
    two = case.case_manifest({"title": "x", "number": "C-1"}, {"findings": none, "recordings": rows.orderBy(F.rand(1)).repartition(7).select("channel", "id")}, ["synthetic"])
    assert one == two and one[0]["lists"]["recordings"]["count"] == 500 and one[0]["lists"]["findings"]["count"] == 0
    other = rows.withColumn("channel", F.when(F.col("id") == "r9", F.lit(1).cast("long")).otherwise(F.col("channel")))
    assert case.case_manifest({"number": "C-1", "title": "x"}, {"recordings": other, "findings": none}, ["synthetic"])[1] != one[1]
    assert case.case_manifest({"number": "C-1", "title": "x"}, {"recordings": rows.union(rows.where("id = 'r1'")), "findings": none}, ["synthetic"])[1] != one[1]


def test_export_selection(spark):
    frames = spark.createDataFrame([("r1", 1, 5), ("r1", 1, None), ("r2", 2, 9)], "recording_id string, channel int, ts_us long")
    recordings = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "recording_id string")
    pick = lambda **k: lookup.export_selection(frames, recordings, **k).count()
    assert pick(recording_id="r1") == 2 and pick(recording_id="r3") == 0 and pick(channel=1) == 2 and pick(channel=1, from_us=5, to_us=5) == 1
    for bad, error in (({"recording_id": "r9"}, KeyError), ({}, ValueError), ({"from_us": 1}, ValueError), ({"channel": 3}, ValueError), ({"channel": 1, "from_us": 6}, ValueError)):
        with pytest.raises(error):
            pick(**bad)
