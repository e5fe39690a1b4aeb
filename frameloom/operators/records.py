"""Decoders of recorder structures: framed records, log slots, streams and indexes.

Structures are described by ``struct`` layouts and read by small generators that check
themselves: a walk ends at the first record that does not hold, a slot array skips
what does not. Each runs inside one task over one byte range; what relates
records to each other (anchors, gaps, runs) is left to DataFrame windows.
"""

from __future__ import annotations

import calendar
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.operators.bytescan import _mapped, plain_type, start_codes, unit_kind
from frameloom.operators.segments import chained, scanned, segmented

# Fixed values of the formats.
DHAV, DHAV_END = b"DHAV", b"dhav"
DHAV_KINDS = {0xFD: "I", 0xFC: "P", 0xF0: "other"}
RATS, DHLG = b"RATS", b"DHLG"
LOG_KINDS = {0x01: "login", 0x02: "logout", 0x10: "playback", 0x11: "export", 0x40: "hdd_format", 0x41: "time_change", 0x50: "power_on"}
HIK_MAGIC, HIK_MAGIC_AT, HIK_TREE, HIK_BLOCK_HEADER = b"HIKVISION@HANGZHOU", 0x210, b"HIKBTREE", 40
DH_MAGIC = b"DHFS4.1\x00"
GPT_MAGIC, HW_MAGIC, HW_MACHINE_SECTOR, HW_CHANNELS_AT = b"EFI PART", b"HONEYWELL-NVR-SIM\x00", 34, 0x400000
PACK, PRIVATE, VIDEO, ANCHOR = b"\x00\x00\x01\xba", b"\x00\x00\x01\xbd", b"\x00\x00\x01\xe0", b"HKTS"
HW_TYPES, HW_FIXED, START_CODE = (0x82, 0x02), b"\x80\x01\x00", b"\x00\x00\x00\x01"
HW_FRAME_KINDS = {7: "SPS", 8: "PPS", 6: "SEI", 5: "I", 1: "P"}
SECTOR = 512
PTS_MASK = (1 << 33) - 1

# Layouts of a record's head (24 bytes) and of log records (64 and 32 bytes).
_DHAV_HEAD = "<4sBxBxIIIHBB"
_RATS = "<4sIHH16sIQQ16x"
_DHLG = "<4sIHH16sI"


def text(raw: bytes) -> str | None:
    return raw.partition(b"\0")[0].decode("ascii", "replace").strip() or None


@dataclass(frozen=True)
class Frame:
    header_offset: int
    payload_offset: int
    payload_len: int
    end_offset: int
    channel: int | None
    kind: str
    ts_us: int | None
    pts: int | None = None
    width: int | None = None
    height: int | None = None


FRAME_COLUMNS = "image string, run int, header_offset long, payload_offset long, payload_len long, end_offset long, channel int, kind string, ts_us long, pts long, width int, height int"


def packed_time(v: int) -> int | None:
    """Seconds since 1970 of second:6, minute:6, hour:5, day:5, month:4, year since 2000:6 bits; None off the calendar."""
    fields = []
    for width in (6, 6, 5, 5, 4, 6):
        fields.append(v & (1 << width) - 1)
        v >>= width
    second, minute, hour, day, month, year = fields
    if second > 59 or minute > 59 or hour > 23 or not 1 <= month <= 12 or not 1 <= day <= calendar.monthrange(2000 + year, month)[1]:
        return None
    return calendar.timegm((2000 + year, month, day, hour, minute, second))


def dhav_frames(data: bytes, at: int) -> Iterator[Frame]:
    """Framed records from ``at`` on: checksum over the header, trailer with the same length. Offsets are local."""
    while at + 24 <= len(data):
        magic, kind, channel, _, length, packed, ms, _, check = struct.unpack_from(_DHAV_HEAD, data, at)
        end = at + length
        seconds = packed_time(packed)
        holds = magic == DHAV and kind in DHAV_KINDS and sum(data[at : at + 23]) & 255 == check and length >= 32 and end <= len(data)
        if not holds or seconds is None or data[end - 8 : end] != DHAV_END + struct.pack("<I", length):
            return
        yield Frame(at, at + 24, length - 32, end, channel, DHAV_KINDS[kind], seconds * 1_000_000 + ms * 1000)
        at = end


def stream_frames(data: bytes, at: int) -> Iterator[Frame]:
    """Program-stream access units: pack header, optional private packet with an anchor, video packet.

    ts_us and channel are set only where an anchor stands; ``anchored`` fills in the rest.
    """
    while data[at : at + 4] == PACK and at + 14 <= len(data):
        bits = int.from_bytes(data[at + 4 : at + 14], "big")
        clock = ((bits >> 75 & 7) << 30 | (bits >> 59 & 0x7FFF) << 15 | bits >> 43 & 0x7FFF) & PTS_MASK
        here, ts, channel = at + 14, None, None
        if data[here : here + 4] == PRIVATE:
            size = int.from_bytes(data[here + 4 : here + 6], "big")
            body = data[here + 6 : here + 6 + size]
            if len(data) < here + 6 or len(body) != size:
                return
            if size == 11 and body[:4] == ANCHOR:
                seconds, ms, channel = struct.unpack(">IHB", body[4:])
                ts = seconds * 1_000_000 + ms * 1000
            here += 6 + size
        if data[here : here + 4] != VIDEO or here + 9 > len(data):
            return
        size, skip = int.from_bytes(data[here + 4 : here + 6], "big"), data[here + 8]
        start, end = here + 9 + skip, here + 6 + size
        if not size or end < start or end > len(data):
            return
        yield Frame(at, start, end - start, end, channel, unit_kind(data[start:end]), ts, clock)
        at = end


def headed_records(data: bytes, at: int) -> Iterator[Frame]:
    """NAL units behind 20-byte headers, one after the other."""
    while at + 20 <= len(data):
        kind, fixed, width, height, size, ts = struct.unpack_from("<B3sHHIQ", data, at)
        start = at + 20
        if kind not in HW_TYPES or fixed != HW_FIXED or size < 5 or start + size > len(data) or data[start : start + 4] != START_CODE:
            return
        yield Frame(at, start, size, start + size, None, HW_FRAME_KINDS.get(data[start + 4] & 31, "other"), ts, None, width, height)
        at = start + size


def headed_units(data: bytes, at: int) -> Iterator[Frame]:
    """Headed NAL units; only whole access units (up to a slice) are given."""
    waiting: list[Frame] = []
    for unit in headed_records(data, at):
        waiting.append(unit)
        if unit.kind in ("I", "P"):
            yield from waiting
            waiting = []


#: family: (signature, its place within a record, walk)
WALKS: dict[str, tuple[bytes, int, Callable[[bytes, int], Iterator[Frame]]]] = {
    "dhsim": (DHAV, 0, dhav_frames),
    "hiksim": (PACK, 0, stream_frames),
    "hwsim": (HW_FIXED, 1, headed_units),
}


#: Families whose records count only up to one of given kinds: (walk over single records, the kinds).
UNITS: dict[str, tuple[Callable[[bytes, int], Iterator[Frame]], tuple[str, ...]]] = {"hwsim": (headed_records, ("I", "P"))}


def register_walk(family: str, signature: bytes, place: int, walk: Callable[[bytes, int], Iterator[Frame]]) -> None:
    """Add a family to carve and walk; each of its records must start with the signature at ``place``."""
    WALKS[family] = (signature, place, walk)


def _row(image: str, run: int, base: int, f: Frame) -> tuple:
    return image, run, base + f.header_offset, base + f.payload_offset, f.payload_len, base + f.end_offset, f.channel, f.kind, f.ts_us, f.pts, f.width, f.height


def carved(ranges: DataFrame, family: str, segments: int | None = None) -> DataFrame:
    """Frames found in ranges (image, core_start, core_end, before, data) without an index.

    A task gives each record that starts at a signature in its core and holds by itself; data
    must reach beyond the core by the largest record. Of records that overlap, the first
    stays and those within it go, as in one walk over the whole image, so the cut into
    windows does not matter. A run is a chain of records without a byte between them; runs
    are numbered within their image by place. Only frames are shuffled, never bytes, and an image's frames
    are scanned in ``segments``, whose number changes nothing.
    """
    signature, place, walk = WALKS[family]
    records, closing = UNITS.get(family, (walk, ()))

    def of(row: dict):
        data, core = row["data"], row["core_end"] - row["core_start"]
        at = data.find(signature)
        while 0 <= at < core + place:
            frame = next(records(data, at - place), None) if at >= place else None
            if frame:
                yield _row(row["image"], 0, row["core_start"], frame)
            at = data.find(signature, at + 1)

    found = _mapped(ranges, of, FRAME_COLUMNS)
    laid = chained(found, ["image"], "header_offset", "end_offset", segments, laid_out=True)
    where = (["image"], ["header_offset"])
    follows = scanned(laid, *where, lag={"_end": F.col("end_offset")})
    begins = F.coalesce(F.col("_end") != F.col("header_offset"), F.lit(True))
    out = scanned(follows, *where, sums={"_run": begins.cast("int")})
    if closing:
        # of each run what its last closing record ends, and runs without one are not counted
        ends = out.where(F.col("kind").isin(*closing)).groupBy("image", "_run").agg(F.max("header_offset").alias("_last"))
        ends = scanned(segmented(ends, ["image"], ["_run"], segments), ["image"], ["_run"], sums={"_number": F.lit(1)})
        out = out.join(ends.select("image", "_run", "_last", "_number"), ["image", "_run"]).where("header_offset <= _last").withColumn("_run", F.col("_number"))
    return out.withColumn("run", (F.col("_run") - 1).cast("int")).select(*found.columns)


def walked(ranges: DataFrame, family: str, skip: int = 0) -> DataFrame:
    """Frames of indexed ranges, one sequential walk each, ``skip`` bytes in."""
    walk = WALKS[family][2]
    return _mapped(ranges, lambda row: (_row(row["image"], 0, row["core_start"], f) for f in walk(row["data"], skip)), FRAME_COLUMNS)


def anchored(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Time and channel of every stream frame from the last anchor at or before it, else from the first one after.

    Distances are 33-bit differences of the 90 kHz clock, rounded half to even; without
    any anchor both stay null.
    """
    w = Window.partitionBy(*keys).orderBy("header_offset")
    mark = F.when(F.col("ts_us").isNotNull(), F.struct("pts", "ts_us", "channel"))
    out = frames.withColumn("_a", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_z", F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    us = lambda d: F.bround(d.bitwiseAND(F.lit(PTS_MASK)) * 1_000_000 / 90_000, 0).cast("long")
    time = F.when(F.col("_a").isNotNull(), F.col("_a.ts_us") + us(F.col("pts") - F.col("_a.pts"))).otherwise(F.col("_z.ts_us") - us(F.col("_z.pts") - F.col("pts")))
    return out.withColumn("ts_us", time).withColumn("channel", F.coalesce("_a.channel", "_z.channel")).drop("_a", "_z")


def log_slots(areas: DataFrame, kind: str) -> DataFrame:
    """Log records at the fixed stride of an area; slots that do not hold are skipped."""
    return _mapped(areas, lambda row: _log_rows(row, kind, range(0, len(row["data"]), struct.calcsize(_RATS if kind == "rats" else _DHLG))), "image string, offset long, ts_us long, kind string, user string, channel long, param1 long, param2 long")


def _log_rows(row: dict, kind: str, places) -> Iterator[tuple]:
    layout, magic = (_RATS, RATS) if kind == "rats" else (_DHLG, DHLG)
    for at in places:
        if at + struct.calcsize(layout) > len(row["data"]):
            continue
        f = struct.unpack_from(layout, row["data"], at)
        if kind == "rats":
            head, ts, _, code, user, channel, p1, p2 = f
        else:
            head, ts, code, channel, user, p1 = f
            p2 = 0
        if head == magic and code in LOG_KINDS and p1 < 1 << 63 and p2 < 1 << 63:
            yield row["image"], row["core_start"] + at, ts * 1_000_000, LOG_KINDS[code], text(user), channel or None, p1, p2


def logs(areas: DataFrame, rest: DataFrame, kind: str) -> DataFrame:
    """Records of the declared area and of hits outside it; of equal offsets the declared one stays."""
    magic, size = (RATS, 64) if kind == "rats" else (DHLG, 32)

    def hits(row: dict):
        at = row["data"].find(magic)
        while at >= 0:
            found = list(_log_rows(row, kind, [at]))
            yield from found
            at = row["data"].find(magic, at + (size if found else 1))

    shape = "image string, offset long, ts_us long, kind string, user string, channel long, param1 long, param2 long"
    both = log_slots(areas, kind).withColumn("found", F.lit(0)).unionByName(_mapped(rest, hits, shape).withColumn("found", F.lit(1)))
    w = Window.partitionBy("image", "offset").orderBy("found")
    out = both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    times = F.to_json(F.struct(F.col("param1").alias("old_s"), F.col("param2").alias("new_s")))
    return out.withColumn("details", F.when(F.col("kind") == "time_change", times)).withColumn("found", F.when(F.col("found") == 0, "area").otherwise("carved"))


# Indexes ----------------------------------------------------------------------------------------

INDEX_COLUMNS = "image string, family string, slot int, live boolean, channel int, start_us long, end_us long, offset long, length long, model string, serial string"


def hik_index(data: bytes) -> Iterator[tuple]:
    if data[HIK_MAGIC_AT : HIK_MAGIC_AT + len(HIK_MAGIC)] != HIK_MAGIC or len(data) < 0x350:
        return
    tree, _, first, block = struct.unpack_from("<QQQQ", data, 0x240)
    if data[tree : tree + 8] != HIK_TREE:
        return
    (count,) = struct.unpack_from("<I", data, tree + 0x10)
    for slot in range(count):
        state, channel, _, start, end, offset = struct.unpack_from("<QBB6xIIQ", data, tree + 0x60 + 48 * slot)
        yield "hiksim", slot, state == 0, channel, start * 1_000_000, end * 1_000_000, offset, min(block, max(0, len(data) - offset)), text(data[0x300:0x320]), text(data[0x320:0x350])


def dh_index(data: bytes) -> Iterator[tuple]:
    if data[:8] != DH_MAGIC or len(data) < 0xD0:
        return
    at, count = struct.unpack_from("<QI", data, 0x10)
    for slot in range(count):
        state, channel, start, end, offset, length = struct.unpack_from("<BB2xII4xQQ", data, at + 32 * slot)
        yield "dhsim", slot, state == 1, channel, start * 1_000_000, end * 1_000_000, offset, length, text(data[0x40:0x60]), text(data[0x80:0xB0])


def hw_index(data: bytes) -> Iterator[tuple]:
    machine = data[HW_MACHINE_SECTOR * SECTOR : (HW_MACHINE_SECTOR + 1) * SECTOR]
    if data[SECTOR : SECTOR + 8] != GPT_MAGIC or not machine.startswith(HW_MAGIC):
        return
    table, count, size = struct.unpack_from("<QII", data, SECTOR + 72)
    parts = []
    for i in range(count if 56 <= size and count <= 16384 else 0):
        entry = data[table * SECTOR + i * size :][:size]
        if len(entry) >= 56 and (first := struct.unpack_from("<Q", entry, 32)[0]):
            parts.append((entry[56:128].decode("utf-16-le", "replace").partition("\0")[0], first))
    named = [p for p in parts if "VIDEO" in p[0].upper()] or sorted(parts, key=lambda p: p[1])
    if not named:
        return
    base = named[0][1] * SECTOR
    (video,) = struct.unpack_from("<Q", data, base)
    rest = machine[len(HW_MAGIC) :]
    for slot in range(4096):
        entry = data[base + HW_CHANNELS_AT + 16 * slot :][:16]
        if len(entry) < 16 or not any(entry):
            return
        channel, _, start, place, length = struct.unpack("<BB2xIII", entry)
        yield "hwsim", slot, True, channel, start * 1_000_000, None, base + video + place * 4096, length * 4096, text(rest[:32]), text(rest[32:64])


#: Index readers in the order in which they are tried; ``register_index`` adds more.
INDEXES: list[Callable[[bytes], Iterator[tuple]]] = [hik_index, dh_index, hw_index]


def register_index(reader: Callable[[bytes], Iterator[tuple]]) -> None:
    INDEXES.append(reader)


def indexed(images: DataFrame) -> DataFrame:
    """Index entries of each image, live or free, by the first reader that knows it."""

    def of(row: dict):
        for reader in INDEXES:
            if entries := list(reader(row["data"])):
                return [(row["image"], *e) for e in entries]
        return []

    return _mapped(images, of, INDEX_COLUMNS)


# Sequence parameter sets ------------------------------------------------------------------------

_HIGH = {100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135}


class _Bits:
    """A bit string with a position."""

    def __init__(self, data: bytes) -> None:
        self.s, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n: int = 1) -> int:
        if self.at + n > len(self.s):
            raise ValueError("parameter set ends early")
        self.at += n
        return int(self.s[self.at - n : self.at] or "0", 2)

    def golomb(self) -> int:
        one = self.s.find("1", self.at)
        if one < 0 or one - self.at > 32:
            raise ValueError("bad exponential code")
        zeros, self.at = one - self.at, one
        return self.take(zeros + 1) - 1


def sps(rbsp: bytes) -> dict[str, int]:
    """profile, level, id and cropped size of a sequence parameter set (without its NAL header); ValueError if it cannot be read."""
    import re

    b = _Bits(re.sub(rb"\x00\x00\x03(?=[\x00-\x03])", b"\x00\x00", rbsp))
    profile, _, level, ident = b.take(8), b.take(8), b.take(8), b.golomb()
    chroma = 1
    if profile in _HIGH:
        chroma = b.golomb()
        if chroma == 3:
            b.take()
        b.golomb(), b.golomb(), b.take()
        if b.take():
            raise ValueError("scaling matrices are not supported")
    b.golomb()
    order = b.golomb()
    if order == 0:
        b.golomb()
    elif order == 1:
        b.take(), b.golomb(), b.golomb()
        for _ in range(b.golomb()):
            b.golomb()
    b.golomb(), b.take()
    across, down, whole = b.golomb() + 1, b.golomb() + 1, b.take()
    if not whole:
        b.take()
    b.take()
    left, right, top, bottom = (b.golomb(), b.golomb(), b.golomb(), b.golomb()) if b.take() else (0, 0, 0, 0)
    unit_x, unit_y = 1 if chroma == 3 else 2, (1 if chroma in (2, 3) else 2) * (2 - whole)
    return {"id": ident, "profile": profile, "level": level, "width": 16 * across - unit_x * (left + right), "height": 16 * down * (2 - whole) - unit_y * (top + bottom)}


def scan_units(rows: DataFrame, codec: str = "h264") -> DataFrame:
    """Start codes as of ``scan_annexb``, types in terms of H.264, with width, height and profile of parameter sets that can be read, and markers.

    A row of nal_type -1 stands at the end of each window and one of -2 at its start: where both
    meet, windows join; elsewhere a range ends. Data must reach beyond the core by a parameter set.
    """

    def of(row: dict):
        yield row["image"], row["core_start"], 0, -2, None, None, None
        yield row["image"], row["core_end"], 0, -1, None, None, None
        for at, four, kind in start_codes(row, codec):
            read = {}
            if codec == "h264" and kind == 7:
                stop = row["data"].find(b"\x00\x00\x01", at + 3)
                try:
                    read = sps(row["data"][at + 4 : stop if stop >= 0 else None])
                except ValueError:
                    pass
                if not all(0 < read.get(side, 0) < 1 << 16 for side in ("width", "height")):
                    read = {}
            yield row["image"], row["core_start"] + at - four, 3 + four, plain_type(kind, codec), read.get("width"), read.get("height"), read.get("profile")

    return _mapped(rows, of, "image string, offset long, sc_len int, nal_type int, width int, height int, profile int")
