"""Scans, decoders, layout inference and streams on synthetic images."""

from __future__ import annotations

import json
import random
import struct

import pytest

from frameloom.operators import bytescan, infer, records
from frameloom.plans.images import as_range, layout_of
from frameloom.sources import images, synthetic
from frameloom.streaming import sessions


@pytest.mark.parametrize("size", [16, 64, 100, 1 << 20])
def test_windows_do_not_change_what_is_found(spark, tmp_path, size):
    rnd = random.Random(size)
    data = bytearray(rnd.choice([0, 0, 1, 2, 7, 200]) for _ in range(400))
    for at in (59, 63, 64, 67, 127):
        data[at : at + 4] = b"DHAV"
    path = tmp_path / "image.raw"
    path.write_bytes(data)
    whole = as_range(spark, bytes(data), name=str(path))
    cut = images.read_windows(spark, str(path), overlap=8, size=size)
    for scan in (lambda r: bytescan.scan_signatures(r, [b"DHAV"]), bytescan.scan_annexb):
        assert sorted(map(tuple, scan(cut).collect())) == sorted(map(tuple, scan(whole).collect()))


def test_four_byte_codes_and_types(spark):
    data = b"\x00\x00\x00\x01\x67aaaa\x00\x00\x01\x65bbb"
    assert [(r.offset, r.sc_len, r.nal_type) for r in bytescan.scan_annexb(as_range(spark, data)).collect()] == [(0, 4, 7), (9, 3, 5)]


def test_entropy_of_zeros_and_a_short_last_block(spark):
    got = bytescan.block_entropy(as_range(spark, bytes(16) + bytes(range(8))), 16).collect()
    assert [(r.offset, r.entropy) for r in got] == [(0, 0.0), (16, 3.0)]


def test_containers_are_refused(tmp_path):
    (tmp_path / "x.E01").write_bytes(images.EWF_MAGIC + b"rest")
    with pytest.raises(ValueError):
        images.open_kind(str(tmp_path / "x.E01"))


def test_index_walk_and_carve_agree(spark):
    image = synthetic.dh_image()
    index = records.indexed(as_range(spark, image)).orderBy("slot").collect()
    assert [(r.live, r.channel, r.model, r.serial) for r in index] == [(True, 1, "XVR-5104", "SN0042"), (False, 2, "XVR-5104", "SN0042"), (True, 3, "XVR-5104", "SN0042")]
    carved = records.carved(as_range(spark, image), "dhsim").orderBy("header_offset").collect()
    assert len(carved) == 36 and {r.run for r in carved} == {0, 1, 2}
    assert [r.kind for r in carved[:5]] == ["I", "P", "P", "P", "I"]
    assert carved[0].header_offset == index[0].offset and carved[0].ts_us == synthetic.EPOCH * 1_000_000


def test_damage_ends_a_walk_and_carving_goes_on(spark):
    image = bytearray(synthetic.dh_image())
    whole = records.carved(as_range(spark, bytes(image)), "dhsim").orderBy("header_offset").collect()
    image[whole[4].header_offset + 9] ^= 1
    got = records.carved(as_range(spark, bytes(image)), "dhsim").collect()
    assert sorted(r.header_offset for r in got) == [r.header_offset for i, r in enumerate(whole) if i != 4]


@pytest.mark.parametrize("size", [40, 100, 257, 1024, 4096])
@pytest.mark.parametrize("family", ["dhsim", "hwsim"])
def test_windows_do_not_change_what_is_carved(spark, tmp_path, family, size):
    runs = synthetic.dh_image(per_run=5)[0x1000:] if family == "dhsim" else synthetic.hw_run() + synthetic.hw_run(9)[:-30]
    if family == "dhsim":  # a whole record within the payload of another one
        inner = synthetic.dhav(9, synthetic.EPOCH, 0, False, 0, random.Random(5))
        length = 32 + len(inner)
        head = runs[:12] + struct.pack("<I", length) + runs[16:23]
        runs += head + bytes([sum(head) & 255]) + inner + b"dhav" + struct.pack("<I", length) + inner
    path = tmp_path / "image.raw"
    path.write_bytes(b"\xee" * 37 + runs)
    whole = sorted(map(str, records.carved(as_range(spark, path.read_bytes(), name=str(path)), family).collect()))
    cut = records.carved(images.read_windows(spark, str(path), overlap=512, size=size), family)
    assert sorted(map(str, cut.collect())) == whole and len(whole) == (17 if family == "dhsim" else len(whole)) > 9
    assert sum("channel=9" in x for x in whole) == (1 if family == "dhsim" else 0)


def test_anchors_and_clock_wrap(spark):
    frames = records.anchored(records.walked(as_range(spark, synthetic.ps_stream()), "hiksim"), ["image"]).orderBy("header_offset").collect()
    assert len(frames) == 20 and {r.channel for r in frames} == {7}
    assert [r.ts_us for r in frames] == [synthetic.EPOCH * 1_000_000 + 40_000 * i for i in range(20)]
    bare = records.anchored(records.walked(as_range(spark, synthetic.ps_stream(first_anchor=99)), "hiksim"), ["image"]).collect()
    assert {(r.ts_us, r.channel) for r in bare} == {(None, None)}


def test_headed_units_keep_whole_access_units(spark):
    run = synthetic.hw_run()
    got = records.carved(as_range(spark, b"\xee" * 5 + run + run[:-30]), "hwsim").collect()
    assert {r.run for r in got} == {0, 1} and (got[0].width, got[0].height) == (704, 576)
    assert [r.kind for r in got if r.run == 0][:4] == ["SPS", "PPS", "I", "P"]


def test_logs_prefer_the_declared_area(spark):
    e = synthetic.EPOCH
    area = synthetic.rats(1, e, "admin", 0) + bytes(64) + synthetic.rats(0x41, e + 60, "bob", 2, e + 60, e)
    rest = area[:64] + b"xx" + synthetic.rats(0x40, e, "", 1)
    got = {r.offset: r for r in records.logs(as_range(spark, area), as_range(spark, rest), "rats").collect()}
    assert {k: v.found for k, v in got.items()} == {0: "area", 128: "area", 66: "carved"}
    assert got[0].channel is None and got[66].user is None and json.loads(got[128].details) == {"old_s": e + 60, "new_s": e}


def test_hik_and_hw_indexes():
    image = bytearray(0x2000)
    image[0x210:0x222] = records.HIK_MAGIC
    struct.pack_into("<QQQQ", image, 0x240, 0x600, 0, 0x1000, 0x800)
    image[0x600:0x608] = records.HIK_TREE
    struct.pack_into("<I", image, 0x610, 2)
    struct.pack_into("<QBB6xIIQ", image, 0x660, 0, 3, 1, 100, 200, 0x1000)
    struct.pack_into("<QBB6xIIQ", image, 0x690, 1 << 63, 4, 1, 1, 2, 0x1800)
    assert [(x[1], x[2], x[3], x[6], x[7]) for x in records.hik_index(bytes(image))] == [(0, True, 3, 0x1000, 0x800), (1, False, 4, 0x1800, 0x800)]
    assert list(records.dh_index(bytes(image))) == [] and list(records.hw_index(bytes(image))) == []


def golomb(v: int) -> str:
    s = f"{v + 1:b}"
    return "0" * (len(s) - 1) + s


def test_parameter_sets():
    bits = f"{66:08b}" + "0" * 8 + f"{30:08b}" + golomb(0) + golomb(0) + golomb(0) + golomb(0) + golomb(1) + "0" + golomb(43) + golomb(35) + "1" + "1" + "1" + golomb(0) + golomb(0) + golomb(0) + golomb(4) + "1"
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert records.sps(raw) == {"id": 0, "profile": 66, "level": 30, "width": 704, "height": 568}
    with pytest.raises(ValueError):
        records.sps(raw[:4])


def test_layout_is_found(spark):
    windows = as_range(spark, synthetic.unknown_image())
    _, layout = layout_of(windows)
    got = {f.name: (f.offset, f.width, f.endian, f.unit) for f in layout.fields}
    assert layout.magic == b"XQ7RECV2" and layout.header_len == 32
    assert got["timestamp"] == (16, 8, "little", "ms") and got["length"][:3] == (12, 4, "big")
    assert got["channel"][0] == 8 and got["sequence"][0] == 24 and got["flags"][0] == 28
    frames = infer.replayed_units(infer.unit_starts(bytescan.scan_annexb(windows)), windows, layout).orderBy("payload_offset").collect()
    assert frames[0].payload_offset == frames[0].header_offset + 32 and {f.channel for f in frames} == {1, 2, 3, 4} and len(frames) == 160
    assert "timestamp: 8 bytes at 16, little-endian, in ms" in infer.summary(layout)
    assert infer.infer([]) is None


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_replay_goes_past_the_sample_and_reads_by_place(spark, tmp_path, size):
    """The same frames from one range in memory, from windows of a file, and from the file by path; the layout from half of them."""
    from frameloom.plans import case

    path = tmp_path / "image.raw"
    path.write_bytes(synthetic.unknown_image())
    whole = as_range(spark, path.read_bytes(), name=str(path))
    cut = images.evidence(spark, str(path), overlap=256, window=size)
    want = sorted(map(tuple, case.carve_with(whole, None).collect()))
    assert len(want) == 160 and sorted(map(tuple, case.carve_with(cut, None).collect())) == want
    units = infer.unit_starts(bytescan.scan_annexb(cut))
    few = infer.samples(units, most=80)
    assert len(few) == 80 and sorted(map(tuple, infer.replayed_units(units, None, infer.infer(few)).collect())) == want


def test_evidence_plans_windows_and_takes_conditions(spark, tmp_path):
    data = bytes(range(256)) * 40
    path = tmp_path / "image.raw"
    path.write_bytes(data)
    rows = images.evidence(spark, str(path), overlap=16, window=1000)
    got = rows.orderBy("core_start").collect()
    assert [(r.core_start, r.core_end, r.before) for r in got] == [(a, min(a + 1000, len(data)), data[a - 1] if a else -1) for a in range(0, len(data), 1000)]
    assert all(bytes(r.data) == data[r.core_start : r.core_end + 16] for r in got)
    some = rows.where("core_start < 3000 AND core_end > 1000")
    assert sorted(r.core_start for r in some.collect()) == [1000, 2000] and some.rdd.getNumPartitions() == 2
    assert [r.core_start for r in images.evidence(spark, str(path), window=1000, start=500, end=1600).collect()] == [500, 1500]
    (tmp_path / "x.E01").write_bytes(images.EWF_MAGIC + b"rest")
    with pytest.raises(Exception, match="E01"):
        images.evidence(spark, str(tmp_path / "x.E01")).collect()
    (tmp_path / "none.raw").write_bytes(b"")
    assert images.evidence(spark, str(tmp_path / "none.raw")).count() == 0


def test_bytes_of_spans(spark, tmp_path):
    data = bytes(random.Random(1).randrange(256) for _ in range(3000))
    path = tmp_path / "image.raw"
    path.write_bytes(data)
    spans = [(str(path), a, n) for a, n in ((0, 5), (999, 3), (1000, 1), (2990, 50), (2999, 1), (0, 0))]
    df = spark.createDataFrame(spans, "image string, start long, length int")
    want = sorted((a, n, data[a : a + n]) for _, a, n in spans)
    for source in (None, images.evidence(spark, str(path), overlap=60, window=1000), images.read_windows(spark, str(path), overlap=60, start=0, size=777), as_range(spark, data, name=str(path))):
        assert sorted((r.start, r.length, bytes(r.data)) for r in images.bytes_of(df, source).collect()) == want


def test_sessions_close_after_the_gap(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [(1, f"2024-01-01T00:00:{s:02d}Z") for s in (0, 5, 10, 16)] + [(2, "2024-01-01T00:30:00Z")]
    (folder / "a.json").write_text("\n".join(json.dumps({"channel": c, "ts": t, "kind": "x", "value": 1.0}) for c, t in rows))
    (folder / "b.json").write_text(json.dumps({"channel": 3, "ts": "2024-01-01T02:00:00Z", "kind": "x", "value": 1.0}))
    stream = sessions.sessions(sessions.json_lines(spark, str(folder), 1), "5 seconds", "1 minute")
    sessions.written(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    got = sorted((r.channel, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [(1, 1), (1, 3)] or got[:2] == [(1, 2), (1, 2)] or (1, 3) in got
