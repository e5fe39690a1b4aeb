"""Rules of layout inference on generated headers."""

from __future__ import annotations

import random
import struct

import pytest

from frameloom.operators import infer

MAGIC = bytes.fromhex("a17c4e902f6b88d1")
EPOCH = 1_700_000_000


def sampled(header, n=64, seed=1, key=5):
    """Units behind ``header(i, length)`` with noise before it."""
    rnd = random.Random(seed)
    out, at = [], 1000
    for i in range(n):
        size = 40 + i * 3 % 140
        h = header(i, size)
        out.append((at, at + size + len(h), i % key == 0, bytes(rnd.randrange(1, 256) for _ in range(infer.SPAN - len(h))) + h))
        at = out[-1][1]
    return out


def fields(layout):
    return {f.name: (f.offset, f.width, f.endian) for f in layout.fields}


@pytest.mark.parametrize("endian", ["big", "little"])
def test_a_narrow_length_takes_the_zeros_of_its_natural_width(endian):
    sign = ">I" if endian == "big" else "<I"
    layout = infer.infer(sampled(lambda i, n: MAGIC + struct.pack(">I", i % 4) + b"\xff\xfe" + struct.pack(">Q", EPOCH + i // 4 * 4 - i % 4) + b"\xff\xfe" + struct.pack(sign, n) + b"\xfa"))
    got = fields(layout)
    assert layout.header_len == 29 and layout.magic.startswith(MAGIC)
    assert got["length"] == (24, 4, endian) and got["timestamp"] == (14, 8, "big") and got["channel"] == (10, 2, "big")
    (length,) = (f for f in layout.fields if f.name == "length")
    assert length.confidence == 0.97


def test_no_widening_over_bytes_that_vary_or_off_the_natural_place():
    vary = infer.infer(sampled(lambda i, n: MAGIC + bytes([i * 7 % 251 + 1, i * 13 % 251 + 1]) + struct.pack(">H", n) + b"\xfa\xfb", 200))
    assert fields(vary)["length"] == (10, 2, "big")
    off = infer.infer(sampled(lambda i, n: MAGIC + bytes([i * 7 % 251 + 1]) + struct.pack(">I", n) + bytes([i * 5 % 241 + 3]), 200))
    assert fields(off)["length"] == (11, 2, "big")


def test_a_magic_does_not_take_the_high_byte_of_a_small_number():
    layout = infer.infer(sampled(lambda i, n: MAGIC + struct.pack(">H", i % 4) + struct.pack(">I", EPOCH + i // 4 * 4 - i % 4) + struct.pack("<I", n)))
    assert layout.magic == MAGIC and fields(layout)["channel"] == (8, 2, "big") and fields(layout)["timestamp"] == (10, 4, "big")


def test_most_samples_must_share_the_place_of_the_magic():
    header = lambda i, n: MAGIC + struct.pack("<I", n) + (b"" if i % 50 else b"\x77")
    assert infer.infer(sampled(header, 200)) is not None
    assert infer.infer(sampled(lambda i, n: MAGIC + struct.pack("<I", n) + b"\x77" * (i % 3), 200)) is None


def test_equal_times_do_not_go_back_and_rates_have_bounds():
    twice = infer.infer(sampled(lambda i, n: MAGIC + struct.pack("<I", EPOCH + i // 2 * 1) + struct.pack("<I", n), 9))
    assert "timestamp" not in fields(twice) or fields(twice)["timestamp"] == (8, 4, "little")
    thrice = infer.infer(sampled(lambda i, n: MAGIC + struct.pack("<Q", (EPOCH * 1000) + 40 * (i - (i % 4 == 3))) + struct.pack("<I", n), 60))
    assert fields(thrice)["timestamp"] == (8, 8, "little")
    slow = infer.infer(sampled(lambda i, n: MAGIC + struct.pack("<I", EPOCH + 3600 * i) + struct.pack("<I", n)))
    assert "timestamp" not in fields(slow)


def test_sequence_by_channel_and_flags_of_either_sense():
    def header(i, n):
        return MAGIC + struct.pack("<H", i * 7 % 3 + 1) + struct.pack("<Q", EPOCH * 1000 + 40 * i) + struct.pack("<I", 70_000 + i) + struct.pack("<H", 8 if i % 5 == 0 else 9) + struct.pack(">I", n)

    got = fields(infer.infer(sampled(header)))
    assert got["sequence"][0] == 18 and got["flags"][0] in (21, 22) and got["length"][0] + got["length"][1] == 28


def test_nothing_without_a_magic():
    rnd = random.Random(2)
    noise = [(1000 + i, None, False, bytes(rnd.randrange(256) for _ in range(infer.SPAN))) for i in range(50)]
    assert infer.infer(noise) is None and infer.infer(noise[:3]) is None
