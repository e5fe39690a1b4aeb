"""Scans over windows of image bytes: signatures, Annex B start codes, block entropy.

Input rows are those of ``sources.images``: image, core_start, core_end, before, data.
A hit is reported by the window whose core holds its first byte, so nothing is made
distinct afterwards and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

VCL = (1, 5)


def _mapped(rows: DataFrame, of_window, schema: str) -> DataFrame:
    """One output batch for each window; ``of_window`` gives rows of the schema's columns."""
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = list(of_window(row))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return rows.mapInArrow(run, schema)


def scan_signatures(rows: DataFrame, patterns: list[bytes]) -> DataFrame:
    """image, pattern (its place in the list), offset of leftmost hits without overlap within a window; the first listed wins a tie."""
    finder = re.compile(b"|".join(b"(" + re.escape(p) + b")" for p in patterns), re.DOTALL)

    def of(row: dict):
        core = row["core_end"] - row["core_start"]
        for m in finder.finditer(row["data"]):
            if m.start() < core:
                yield row["image"], m.lastindex - 1, row["core_start"] + m.start()

    return _mapped(rows, of, "image string, pattern int, offset long")


def nal_type(first: int, codec: str) -> int:
    return first & 31 if codec == "h264" else first >> 1 & 63


# Types that are likely in streams of either codec, and those that tell them apart (parameter sets and key slices).
PLAUSIBLE = {"h264": (1, 5, 7, 8), "h265": (1, 19, 20, 32, 33, 34)}
TELLING = {"h264": (5, 7, 8), "h265": (19, 20, 33, 34)}


def plain_type(kind: int, codec: str) -> int:
    """A NAL type in terms of H.264: 1 and 5 slices, 6 side information, 7 and 8 parameter sets, 9 delimiters; others as they are."""
    if codec == "h264":
        return kind
    if kind in (19, 20):
        return 5
    if kind < 10 or kind in (16, 17, 18, 21):
        return 1
    return {32: 6, 33: 7, 34: 8, 35: 9, 39: 6, 40: 6}.get(kind, 0)


def start_codes(row: dict, codec: str) -> Iterator[tuple[int, bool, int]]:
    """Place in the window's data, whether a zero stands before it, and the type of each start code in the core; ``codec`` "byte": the byte instead."""
    data, core = row["data"], row["core_end"] - row["core_start"]
    for m in re.finditer(b"\x00\x00\x01", data):
        at = m.start()
        if at < core and m.end() < len(data):
            yield at, (data[at - 1] if at else row["before"]) == 0, data[m.end()] if codec == "byte" else nal_type(data[m.end()], codec)


def scan_annexb(rows: DataFrame, codec: str = "h264") -> DataFrame:
    """image, offset, sc_len, nal_type of each start code.

    A code has four bytes exactly if the byte before its three in the image is zero,
    wherever windows are cut.
    """

    def of(row: dict):
        for at, four, kind in start_codes(row, codec):
            yield row["image"], row["core_start"] + at - four, 3 + four, kind

    return _mapped(rows, of, "image string, offset long, sc_len int, nal_type int")


def scan_either(rows: DataFrame) -> DataFrame:
    """image, offset, sc_len, nal_type, codec of each start code, read as H.264 where its type is likely there, else as H.265 where it is there, else as H.264."""

    def of(row: dict):
        for at, four, first in start_codes(row, "byte"):
            codec = next((c for c in PLAUSIBLE if nal_type(first, c) in PLAUSIBLE[c]), "h264")
            yield row["image"], row["core_start"] + at - four, 3 + four, nal_type(first, codec), codec

    return _mapped(rows, of, "image string, offset long, sc_len int, nal_type int, codec string")


def codecs(rows: DataFrame) -> DataFrame:
    """image, codec, h264, h265: what parameter sets and key slices of each codec an image holds, and the codec that has more; H.264 where equal.

    Every window counts for itself, so what is shuffled is a row a window.
    """
    from pyspark.sql import functions as F

    def of(row: dict):
        seen = [first for _, _, first in start_codes(row, "byte")]
        # the first bit of a header is zero in both
        yield row["image"], *(sum(b < 128 and nal_type(b, c) in TELLING[c] for b in seen) for c in TELLING)

    votes = _mapped(rows, of, "image string, h264 long, h265 long").groupBy("image").agg(F.sum("h264").alias("h264"), F.sum("h265").alias("h265"))
    return votes.withColumn("codec", F.when(F.col("h265") > F.col("h264"), "h265").otherwise("h264"))


def block_entropy(rows: DataFrame, block: int = 1 << 20) -> DataFrame:
    """image, offset, entropy in bits a byte of each block of a window; windows are whole numbers of blocks but the last."""

    def of(row: dict):
        import numpy as np

        data = np.frombuffer(row["data"], dtype=np.uint8)[: row["core_end"] - row["core_start"]]
        for at in range(0, len(data), block):
            p = np.bincount(data[at : at + block], minlength=256)
            p = p[p > 0] / p.sum()
            yield row["image"], row["core_start"] + at, float(-(p * np.log2(p)).sum()) + 0.0

    return _mapped(rows, of, "image string, offset long, entropy double")


def nal_units(payload: bytes) -> list[tuple[int, bytes]]:
    """(type, bytes without start code) of each unit of an access unit."""
    marks = [(m.start() - (m.start() > 0 and payload[m.start() - 1] == 0), m.end()) for m in re.finditer(b"\x00\x00\x01", payload)]
    ends = [m[0] for m in marks[1:]] + [len(payload)]
    return [(payload[a] & 31, payload[a:b]) for (_, a), b in zip(marks, ends, strict=True) if a < len(payload)]


def unit_kind(payload: bytes) -> str:
    """I if any unit is an IDR slice, else P."""
    return "I" if any(t == 5 for t, _ in nal_units(payload)) else "P"
