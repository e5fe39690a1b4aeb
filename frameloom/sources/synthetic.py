"""Small synthetic recorder images, made from a seed, for tests and the byte queries."""

from __future__ import annotations

import calendar
import random
import struct

EPOCH = calendar.timegm((2024, 3, 1, 8, 0, 0))


def nal(kind: int, rnd: random.Random, size: int = 24) -> bytes:
    """A start code, a NAL header byte and bytes that hold no start code."""
    return b"\x00\x00\x00\x01" + bytes([0x60 | kind]) + bytes(rnd.randrange(4, 256) for _ in range(size))


def parameter_set(width: int = 704, height: int = 576, profile: int = 66) -> bytes:
    """A start code and a sequence parameter set of whole macroblocks."""
    golomb = lambda v: f"{v + 1:b}".zfill(2 * (v + 1).bit_length() - 1)
    bits = f"{profile:08b}" + "0" * 8 + f"{30:08b}" + "".join(map(golomb, (0, 0, 2, 1))) + "0" + golomb(width // 16 - 1) + golomb(height // 16 - 1) + "1101"
    bits += "1" + "0" * (-(len(bits) + 1) % 8)
    return b"\x00\x00\x00\x01\x67" + int(bits, 2).to_bytes(len(bits) // 8, "big")


def access_unit(key: bool, rnd: random.Random) -> bytes:
    return (parameter_set() + nal(8, rnd, 4) + nal(5, rnd)) if key else nal(1, rnd, rnd.randrange(8, 40))


def dhav_record(channel: int, seconds: int, ms: int, key: bool, seq: int, body: bytes) -> bytes:
    import time

    t = time.gmtime(seconds)
    packed = t.tm_sec | t.tm_min << 6 | t.tm_hour << 12 | t.tm_mday << 17 | t.tm_mon << 22 | (t.tm_year - 2000) << 26
    length = 24 + len(body) + 8
    head = b"DHAV" + bytes([0xFD if key else 0xFC, 0, channel, 0]) + struct.pack("<IIIHB", seq, length, packed, ms, 0)
    return head + bytes([sum(head) & 255]) + body + b"dhav" + struct.pack("<I", length)


def dhav(channel: int, seconds: int, ms: int, key: bool, seq: int, rnd: random.Random) -> bytes:
    return dhav_record(channel, seconds, ms, key, seq, access_unit(key, rnd))


def pack(clock: int, body: bytes, anchor: tuple[int, int, int] | None = None) -> bytes:
    bits = 1 << 78 | (clock >> 30 & 7) << 75 | 1 << 74 | (clock >> 15 & 0x7FFF) << 59 | 1 << 58 | (clock & 0x7FFF) << 43 | 1 << 42
    out = b"\x00\x00\x01\xba" + bits.to_bytes(10, "big")
    if anchor:
        payload = b"HKTS" + struct.pack(">IHB", *anchor)
        out += b"\x00\x00\x01\xbd" + struct.pack(">H", len(payload)) + payload
    return out + b"\x00\x00\x01\xe0" + struct.pack(">H", len(body) + 3) + b"\x80\x00\x00" + body


def rats(code: int, seconds: int, user: str, channel: int, p1: int = 0, p2: int = 0) -> bytes:
    return struct.pack("<4sIHH16sIQQ16x", b"RATS", seconds, 1, code, user.encode(), channel, p1, p2)


def dh_image(seed: int = 1, per_run: int = 12) -> bytes:
    """Superblock, index of three entries (one freed) and their records."""
    rnd = random.Random(seed)
    runs = [b"".join(dhav(c + 1, EPOCH + 3600 * c + i, 40 * i % 1000, i % 4 == 0, i, rnd) for i in range(per_run)) for c in range(3)]
    image = bytearray(0x1000)
    image[:8] = b"DHFS4.1\x00"
    struct.pack_into("<QI", image, 0x10, 0x200, 3)
    image[0x40:0x48], image[0x80:0x86] = b"XVR-5104", b"SN0042"
    at = 0x1000
    for slot, run in enumerate(runs):
        struct.pack_into("<BB2xII4xQQ", image, 0x200 + 32 * slot, int(slot != 1), slot + 1, EPOCH + 3600 * slot, EPOCH + 3600 * slot + per_run - 1, at, len(run))
        at += len(run) + 64
    for run in runs:
        image += run + b"\0" * 64
    return bytes(image)


def ps_stream(seed: int = 2, n: int = 20, first_anchor: int = 3, wrap: bool = True) -> bytes:
    """Packs at 25 a second with an anchor every eighth; the clock wraps midway."""
    rnd = random.Random(seed)
    base = (1 << 33) - 3600 * 10 if wrap else 5000
    out = b""
    for i in range(n):
        anchored = i >= first_anchor and (i - first_anchor) % 8 == 0
        out += pack((base + 3600 * i) % (1 << 33), access_unit(i % 5 == 0, rnd), (EPOCH + i // 25, 40 * (i % 25), 7) if anchored else None)
    return out


def hw_run(seed: int = 3, n: int = 10) -> bytes:
    rnd = random.Random(seed)
    out = b""
    for i in range(n):
        for kind in ((7, 8, 5) if i % 4 == 0 else (1,)):
            body = nal(kind, rnd)
            out += struct.pack("<B3sHHIQ", 0x82 if kind != 1 else 0x02, b"\x80\x01\x00", 704, 576, len(body), (EPOCH + i) * 1_000_000) + body
    return out + b"\0" * 20


def unknown_image(seed: int = 4, n: int = 160) -> bytes:
    """Units behind 32-byte headers of a layout that nobody has told: magic, channel, ms time, length, sequence, flags."""
    rnd = random.Random(seed)
    image, seq = bytes(rnd.randrange(4, 256) for _ in range(256)), [0] * 4
    for i in range(n):
        channel = rnd.randrange(4)
        key = seq[channel] % 6 == 0
        body = access_unit(key, rnd)
        image += b"XQ7RECV2" + struct.pack("<HH", channel + 1, 0) + struct.pack(">I", len(body)) + struct.pack("<Q", (EPOCH * 1000) + 40 * i) + struct.pack("<IHH", seq[channel], int(key), 0) + body
        seq[channel] += 1
    return image
