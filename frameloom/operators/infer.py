"""Layout inference: what the header before each access unit holds, from samples; replay covers every unit.

Access units come from the Annex B scan; of at most ``SAMPLES`` of them the ``SPAN``
bytes before are sampled, which bounds everything after. Columns of little entropy
are the magic; then every place, width and byte order is scored for each role and roles are
given out one after the other to places that are still free.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.operators.bytescan import _mapped
from frameloom.operators.segments import scanned, segmented
from frameloom.sources.images import bytes_of

SAMPLES = 20_000
SPAN = 96
CONSTANT_BITS = 0.2
YEARS_S = (946_684_800, 2_082_758_400)  # 2000 to 2035
FPS = (0.25, 240.0)
RISING, MATCHES, AGREE = 0.98, 0.95, 0.9
#: Numbers of values that a channel may take, and how much of their range they fill.
FEW, DENSE = (2, 64), 0.3
WIDENED = 0.03
UNITS = {"s": 1, "ms": 1_000, "us": 1_000_000}


@dataclass(frozen=True)
class Field:
    name: str
    offset: int
    width: int
    endian: str
    unit: str
    confidence: float


@dataclass(frozen=True)
class Layout:
    header_len: int
    magic: bytes
    fields: tuple[Field, ...]


def unit_starts(nals: DataFrame, segments: int | None = None, headers: DataFrame | None = None) -> DataFrame:
    """image, start, next_start, is_idr of each access unit: parameter sets go with the slice that follows.

    Start codes with other types are chance hits in headers and do not count. Of a known layout ``headers`` (of ``header_ends``) tells
    the other chance hits: those between a header's magic and a start code where the header ends. An image's codes are scanned in segments.
    """
    slices = F.col("nal_type").isin(1, 5)
    counted = nals.where(F.col("nal_type").isin(1, 5, 6, 7, 8))
    if headers is not None:
        counted = counted.join(headers.withColumnsRenamed({"image": "_i", "end": "_end"}), (F.col("image") == F.col("_i")) & (F.col("offset") == F.col("_end")), "left").drop("_i")
    laid = segmented(counted, ["image"], ["offset"], segments)
    if headers is not None:
        known = scanned(laid, ["image"], ["offset"], next_={"_ahead": F.when(F.col("_end").isNotNull(), F.struct("_end", "_len"))})
        inside = F.col("_end").isNull() & (F.col("offset") > F.col("_ahead._end") - F.col("_ahead._len"))
        laid = known.where(~F.coalesce(inside, F.lit(False))).drop("_ahead")
    rows = scanned(laid, ["image"], ["offset"], sums={"_upto": slices.cast("int")}).withColumn("_u", F.col("_upto") - slices.cast("int"))
    units = rows.groupBy("image", "_u").agg(F.min("offset").alias("start"), F.bool_or(slices).alias("_has"), F.bool_or(F.col("nal_type") == 5).alias("is_idr")).where("_has")
    starts = segmented(units.select("image", "start", "is_idr"), ["image"], ["start"], segments)
    return scanned(starts, ["image"], ["start"], lead={"next_start": F.col("start")}).select("image", "start", "next_start", "is_idr")


def heads(units: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``units`` that have a whole span before them, with its bytes (``head``), read as of ``images.bytes_of``."""
    spans = units.where(F.col("start") >= SPAN).withColumn("_a", F.col("start") - SPAN).withColumn("_n", F.lit(SPAN))
    return bytes_of(spans, source, "_a", "_n", "head").drop("_a", "_n")


def samples(units: DataFrame, source: DataFrame | None = None, most: int = SAMPLES) -> list[tuple[int, int | None, bool, bytes]]:
    """(start, next_start, is_idr, bytes before) of the first units that have a whole span before them: ``most`` times ``SPAN`` bytes at most."""
    first = units.where(F.col("start") >= SPAN).orderBy("start").limit(most)
    return [(r.start, r.next_start, r.is_idr, bytes(r.head)) for r in heads(first, source).orderBy("start").collect()]


def _columns(head) -> tuple[list[bool], list[int]]:
    """Which bytes of the span hardly vary, and the most frequent value of each."""
    import numpy as np

    flat, mode = [], []
    for i in range(SPAN):
        count = np.bincount(head[:, i], minlength=256)
        p = count[count > 0] / len(head)
        flat.append(float(-(p * np.log2(p)).sum()) < CONSTANT_BITS)
        mode.append(int(count.argmax()))
    return flat, mode


def _like_a_field(head, at: int) -> bool:
    """Whether this byte and the next, in either order, are a small number of a few values that lie close together, so no part of a magic."""
    import numpy as np

    for big in (True, False):
        values = np.unique(_values(head, at, 2, "big" if big else "little"))
        if FEW[0] <= len(values) <= FEW[1] and values[-1] < 256 and len(values) >= DENSE * (int(values[-1]) - int(values[0]) + 1):
            return True
    return False


def magic_of(head) -> tuple[bytes, int] | None:
    """(magic, its distance to the unit): the first three or more bytes that hardly vary, at the place that nine in ten samples share.

    It grows to both sides over bytes that hardly vary, but not into what looks like a small number with its neighbour.
    """
    flat, mode = _columns(head)
    first = next((i for i in range(SPAN - 2) if all(flat[i : i + 3]) and any(mode[i : i + 3])), None)
    if first is None:
        return None
    last = first + 3
    while last < SPAN and flat[last] and not (last + 1 < SPAN and _like_a_field(head, last)):
        last += 1
    while first and flat[first - 1] and any(mode[first - 1 : first]) and not (first > 1 and _like_a_field(head, first - 2)):
        first -= 1
    magic = bytes(mode[first:last])
    places = Counter(row.tobytes().rfind(magic) for row in head)
    place, votes = max(((k, n) for k, n in places.items() if k >= 0), key=lambda x: x[1], default=(-1, 0))
    return (magic, SPAN - place) if votes >= AGREE * len(head) else None


def _values(head, offset: int, width: int, endian: str):
    import numpy as np

    part = head[:, offset : offset + width].astype(np.uint64)
    order = range(width) if endian == "big" else range(width - 1, -1, -1)
    v = np.zeros(len(head), dtype=np.uint64)
    for i in order:
        v = v << np.uint64(8) | part[:, i]
    return v


def _rising(ts, channel) -> tuple[float, float]:
    """Share of steps within a channel that do not go back, each step counting alike, and the median of these."""
    import numpy as np

    order = np.lexsort((np.arange(len(ts)), channel))
    t, same = ts[order], np.diff(channel[order]) == 0
    onward = (t[1:] >= t[:-1])[same]
    steps = (t[1:] - t[:-1])[same][onward]
    return (float(onward.mean()) if len(onward) else 0.0), float(np.median(steps)) if len(steps) else 0.0


def infer(sampled: list[tuple[int, int | None, bool, bytes]]) -> Layout | None:
    """The layout that the samples agree on; None without a magic of three or more bytes.

    Time and channel are found together: the channel is what makes times rise best, of equal ones the narrowest and densest.
    Length, sequence and flags follow, each at the narrowest place that explains most, which then takes zero bytes beside it up to a
    natural width and place, at a little less confidence.
    """
    import numpy as np

    if len(sampled) < 8:
        return None
    head = np.frombuffer(b"".join(s[3] for s in sampled), dtype=np.uint8).reshape(-1, SPAN)
    found = magic_of(head)
    if found is None:
        return None
    magic, header_len = found
    first = SPAN - header_len
    places = [(o, w, e) for o in range(first + len(magic), SPAN) for w in (8, 4, 2) if o + w <= SPAN for e in ("big", "little")]
    values = {p: _values(head, *p) for p in places}
    start = np.array([s[0] for s in sampled], dtype=np.int64)
    follow = np.array([s[1] if s[1] is not None else -1 for s in sampled], dtype=np.int64)
    idr = np.array([s[2] for s in sampled])
    fields: list[Field] = []

    def free(a: int, b: int) -> bool:
        return a >= first + len(magic) and b <= SPAN and all(b <= f.offset + first or a >= f.offset + first + f.width for f in fields)

    def give(name: str, place: tuple, score: float, unit: str = "none", widen: bool = True) -> None:
        offset, width, endian = place
        grown = False
        while widen and width < 8:
            wide = offset - width if endian == "big" else offset
            pad = (wide, offset) if endian == "big" else (offset + width, offset + 2 * width)
            natural = (wide - first) % (2 * width) == 0 or (wide - first - len(magic)) % (2 * width) == 0
            if not natural or not free(wide, wide + 2 * width) or head[:, pad[0] : pad[1]].any():
                break
            offset, width, grown = wide, 2 * width, True
        fields.append(Field(name, offset - first, width, endian, unit, round(score - WIDENED * grown, 4)))

    none = np.zeros(len(start), dtype=np.uint64)
    channels = [p for p, v in values.items() if p[1] <= 4 and 1 < len(np.unique(v)) <= FEW[1] and v.max() < 256]
    best = None
    for p, unit in ((p, u) for p in places if p[1] >= 4 for u in UNITS):
        v = values[p]
        if not ((v >= YEARS_S[0] * UNITS[unit]) & (v < YEARS_S[1] * UNITS[unit])).all():
            continue
        for c in [*channels, None]:
            if c is not None and not (c[0] + c[1] <= p[0] or p[0] + p[1] <= c[0]):
                continue
            share, step = _rising(v, values[c] if c else none)
            if share < RISING or not step or not FPS[0] <= UNITS[unit] / step <= FPS[1]:
                continue
            few = np.unique(values[c]) if c else none[:1]
            key = (round(share, 3), c is not None, -(c[1] if c else 0), len(few) / (int(few[-1]) - int(few[0]) + 1), p[1], -p[0])
            if best is None or key > best[0]:
                best = (key, p, unit, c, share)
    own = none
    if best:
        _, p, unit, c, share = best
        if c:
            own = values[c]
            give("channel", c, min(0.99, 0.8 + max(0.0, share - _rising(values[p], none)[0])), widen=False)
        give("timestamp", p, share, unit)
    elif channels:
        c = min(channels, key=lambda c: (c[1], len(np.unique(values[c])) / -(int(values[c].max()) - int(values[c].min()) + 1), values[c].max()))
        own = values[c]
        give("channel", c, 0.5, widen=False)

    def pick(name: str, scores: dict[tuple, float], least: float) -> None:
        def rank(p: tuple) -> tuple:
            leading = head[:, p[0] if p[2] == "big" else p[0] + p[1] - 1]
            return scores[p], bool((leading != leading[0]).any()), -p[1], -p[0]

        good = [p for p, s in scores.items() if s >= least and free(p[0], p[0] + p[1])]
        if good:
            top = max(good, key=rank)
            give(name, top, scores[top])

    known = follow >= 0
    size = (follow - header_len - start)[known]
    pick("length", {p: float((v[known].astype(np.int64) == size).mean()) for p, v in values.items() if len(size)}, MATCHES)
    order = np.lexsort((np.arange(len(start)), own))
    same = np.diff(own[order]) == 0

    def counted(v) -> float:
        """Steps of one, over all units or within a channel."""
        along = v[order]
        step = (along[1:] == along[:-1] + np.uint64(1))[same]
        return max(float((v[1:] == v[:-1] + np.uint64(1)).mean()), float(step.mean()) if len(step) else 0.0)

    pick("sequence", {p: counted(v) for p, v in values.items()}, MATCHES)
    agree = {p: float(((v & np.uint64(1)) == idr).mean()) for p, v in values.items() if 1 < len(np.unique(v)) <= 8}
    pick("flags", {p: max(a, 1 - a) for p, a in agree.items()}, 0.9)
    return Layout(header_len, magic, tuple(sorted(fields, key=lambda f: f.offset)))


def header_ends(windows: DataFrame, layout: Layout) -> DataFrame:
    """image, end, _len: where a header ends, for each place of the layout's magic. Data must reach beyond the core by the magic."""

    def of(row: dict):
        at = row["data"].find(layout.magic)
        while 0 <= at < row["core_end"] - row["core_start"]:
            yield row["image"], row["core_start"] + at + layout.header_len, layout.header_len
            at = row["data"].find(layout.magic, at + 1)

    return _mapped(windows, of, "image string, end long, _len int")


_FRAME = "image string, channel long, header_offset long, payload_offset long, payload_len long, ts_us long, kind string"


def _frame(layout: Layout, image: str, start: int, follow: int | None, is_idr: bool, head: bytes) -> tuple:
    """A unit's frame, its header read through the layout."""
    by = {f.name: f for f in layout.fields}
    lead = SPAN - layout.header_len

    def read(name: str, scale: int = 1) -> int | None:
        f = by.get(name)
        value = int.from_bytes(head[lead + f.offset : lead + f.offset + f.width], f.endian) * scale if f else 1 << 63
        return value if value < 1 << 63 else None  # a damaged header may hold more than 64 bits with sign

    scale = 1_000_000 // UNITS[by["timestamp"].unit] if "timestamp" in by else 1
    ts, length = read("timestamp", scale), read("length")
    size = length if length is not None else (follow - layout.header_len - start if follow else None)
    return image, read("channel"), start - layout.header_len, start, size, ts, "I" if is_idr else "P"


def replayed_units(units: DataFrame, source: DataFrame | None, layout: Layout) -> DataFrame:
    """One frame for every unit that has a whole span before it, read through the layout where its bytes are."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_frame(layout, *cells) for cells in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            kinds = (pa.string(), *[pa.int64()] * 5, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _FRAME.split(", ")])

    return heads(units, source).select("image", "start", "next_start", "is_idr", "head").mapInArrow(run, _FRAME)


def summary(layout: Layout) -> str:
    """The layout in words, a line for each field."""
    lines = [f"header of {layout.header_len} bytes, magic {layout.magic.hex()}"]
    lines += [f"{f.name}: {f.width} bytes at {f.offset}, {f.endian}-endian" + (f", in {f.unit}" if f.unit != "none" else "") + f" ({f.confidence:.0%})" for f in layout.fields]
    return "\n".join(lines)
