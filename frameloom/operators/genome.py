"""Identification of recorders by a genome: families of weighted signatures, each within its region of an image.

All signatures of all families are found in one pass over windows by one automaton; a window gives at most one row for each signature, its
first place there, so what is shuffled is small whatever the size of images. Model and serial are then read by place.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.operators.bytescan import _mapped
from frameloom.operators.records import text
from frameloom.sources.images import bytes_of

#: How far signatures without a region are looked for.
ANYWHERE = 64 << 20


@dataclass(frozen=True)
class Signature:
    """Bytes that count where they lie wholly within [start, end)."""

    literal: bytes
    weight: float
    start: int = 0
    end: int | None = None


@dataclass(frozen=True)
class Family:
    """A family; ``model_at`` and ``serial_at`` are (offset, length) of its texts, if it has any."""

    family: str
    signatures: tuple[Signature, ...] = ()
    display_name: str = ""
    platform: str | None = None
    tier: str = "C"
    model_at: tuple[int, int] | None = None
    serial_at: tuple[int, int] | None = field(default=None)


def read_genome(path: str) -> list[Family]:
    """Families in the order of a JSON file: a list of objects with the fields above; a signature has bytes (escapes allowed), weight and where, which is "any" or has start and end."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)
    place = lambda x: (int(x["offset"]), int(x["len"])) if x else None
    out = []
    for e in entries:
        signatures = []
        for s in e.get("signatures", []):
            where = {"end": ANYWHERE} if s["where"] == "any" else s["where"]
            literal = s["bytes"].encode().decode("unicode_escape").encode("latin-1")
            signatures.append(Signature(literal, float(s["weight"]), int(where.get("start", 0)), where.get("end")))
        out.append(Family(e["family"], tuple(signatures), e.get("display_name", ""), e.get("platform"), e.get("tier", "C"), place(e.get("model_at")), place(e.get("serial_at"))))
    return out


def found(windows: DataFrame, signatures: list[Signature]) -> DataFrame:
    """image, sig (place in the list), offset: the first place of each signature within its region. Data must reach beyond the core by the longest."""
    machine: list = []

    def automaton():
        if not machine:
            import ahocorasick

            words = ahocorasick.Automaton()
            for literal in {s.literal for s in signatures}:
                words.add_word(literal.decode("latin-1"), (len(literal), [i for i, s in enumerate(signatures) if s.literal == literal]))
            words.make_automaton()
            machine.append(words)
        return machine[0]

    def of(row: dict):
        first: dict[int, int] = {}
        for last, (n, ids) in automaton().iter(row["data"].decode("latin-1")):
            at = row["core_start"] + last - n + 1
            if at >= row["core_end"]:
                continue
            for i in ids:
                if i not in first and at >= signatures[i].start and (signatures[i].end is None or at + n <= signatures[i].end):
                    first[i] = at
        for i, at in first.items():
            yield row["image"], i, at

    hits = _mapped(windows, of, "image string, sig int, offset long")
    return hits.groupBy("image", "sig").agg(F.min("offset").alias("offset"))


def matched(windows: DataFrame, families: list[Family], source: DataFrame | None = None) -> DataFrame:
    """image, place (1: best), family, display_name, platform, tier, confidence, evidence, model, serial: every family for every image.

    Confidence is the sum of the weights of the signatures found, 1 at most; families of equal confidence stand in the
    order of the genome, and those without any are there with zero. Texts are read from ``source`` (else from the windows),
    for families with some confidence, where the image is long enough.
    """
    spark = windows.sparkSession
    flat = [(k, s) for k, f in enumerate(families) for s in f.signatures]
    told = spark.createDataFrame([(i, k, s.weight, repr(s.literal)[1:]) for i, (k, s) in enumerate(flat)], "sig int, k int, weight double, shown string")
    hits = found(windows, [s for _, s in flat]).join(F.broadcast(told), "sig")  # one row a signature
    shown = F.concat(F.lit("signature "), F.col("shown"), F.lit(" at 0x"), F.lower(F.hex("offset")), F.lit(" (weight "), F.col("weight").cast("string"), F.lit(")"))
    scored = hits.groupBy("image", "k").agg(F.round(F.sum("weight"), 6).alias("_sum"), F.sort_array(F.collect_list(F.struct("sig", shown.alias("e")))).alias("_e"))
    each = "k int, family string, display_name string, platform string, tier string, m0 long, m1 long, s0 long, s1 long"
    rows = [(k, f.family, f.display_name, f.platform, f.tier, *(f.model_at or (None, None)), *(f.serial_at or (None, None))) for k, f in enumerate(families)]
    kinds = F.from_json(F.lit(json.dumps([dict(zip([c.split()[0] for c in each.split(", ")], r, strict=True)) for r in rows])), f"array<struct<{each.replace(' ', ': ').replace(',: ', ', ')}>>")
    images = windows.groupBy("image").agg(F.max("core_end").alias("_size")).select("image", "_size", F.inline(kinds))
    out = images.join(scored, ["image", "k"], "left").withColumn("confidence", F.least(F.lit(1.0), F.coalesce("_sum", F.lit(0.0))))
    order = Window.partitionBy("image").orderBy(F.col("confidence").desc(), "k")  # as many rows as families
    out = out.withColumn("place", F.row_number().over(order)).withColumn("evidence", F.coalesce(F.col("_e.e"), F.array().cast("array<string>")))
    for name in ("model", "serial"):
        a, n = F.col(f"{name[0]}0"), F.col(f"{name[0]}1")
        spans = out.where((F.col("confidence") > 0) & (a + n <= F.col("_size"))).select("image", "k", a.alias("start"), n.alias("length"))
        read = _mapped(bytes_of(spans, windows if source is None else source), lambda r: [(r["image"], r["k"], text(r["data"]))], f"image string, k int, {name} string")
        out = out.join(read, ["image", "k"], "left")
    return out.select("image", "place", "family", "display_name", "platform", "tier", "confidence", "evidence", "model", "serial")
