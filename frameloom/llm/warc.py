"""WARC archives of captures and an external merge of their indexes.

Writing: one record a capture, ``response`` or ``revisit``, as compressed archives
through Spark's own file committer, so that a lost task leaves nothing behind and any
store that Spark writes can hold them. A record is text (headers and an HTML payload
in UTF-8), and records end in two line breaks, which is what the text sink's line
separator writes. Small, large and very large captures go to archives of their own with so many
records each that none holds much more than ``ARCHIVE_BYTES``, which is what a reading task holds.

Reading: archives are walked record by record by Content-Length, never by searching
for a separator, so payloads may hold anything. Each archive gives one capture run,
sorted by URL key, time and id. The runs are stored, dealt by ranges of that whole key
(a URL that owns a third of the captures still spreads), and each task merges
the runs that reach it with a loser tree, spilling merged runs to its own temporary
folder when memory is full (no other task reads it, and a lost task makes it anew).
Partitions in order hold the global capture history.

Defined cases: a null payload is an empty one; a null URL gives no Target-URI and an
empty URL key; line breaks in URLs are percent-encoded; rows that repeat
an id with an equal payload get the same verdict; other columns are not read, whatever they are called; a null id never keeps a payload that
a row with an id also holds.
"""

from __future__ import annotations

import hashlib
import io
import pickle
import tempfile
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import arrow_bounds, bounded, scratch_path, stored

#: Payloads under this many bytes are always written in full.
REVISIT_BYTES = 1000
#: Index entries a merging task holds before it spills a merged run.
SPILL_ENTRIES = 100_000
#: Bytes of payload in one archive, and the size classes of captures: each up to so many bytes.
ARCHIVE_BYTES = 128 << 20
SIZES = (32 << 10, 4 << 20, ARCHIVE_BYTES)
EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z

INDEX_SCHEMA = "url_key string, captured_at string, record_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, intact boolean, archive string, offset long"


def marked(captures: DataFrame, record_id: str, payload: str, least: int = REVISIT_BYTES) -> DataFrame:
    """_id, _digest, _bytes of every distinct capture of at least ``least`` bytes, stored."""
    body = F.coalesce(captures[payload], F.lit(""))
    marks = captures.select(captures[record_id].alias("_id"), F.sha1(body.cast("binary")).alias("_digest"), F.octet_length(body).alias("_bytes"))
    return stored(marks.where(F.col("_bytes") >= least).distinct(), "capture-marks")


def revisits(marks: DataFrame) -> DataFrame:
    """_id, _digest, _keeper of each capture whose payload another one keeps.

    Only ids and digests are shuffled. Groups of equal payloads are reduced by
    partial aggregation before they meet, and nothing after the join needs its
    partitioning, so that a payload of a third of all captures can be split.
    """
    groups = marks.groupBy("_digest").agg(F.max("_id").alias("_keeper"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return marks.join(groups, "_digest").where(~F.col("_id").eqNullSafe(F.col("_keeper"))).select("_id", "_digest", "_keeper")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def write_archives(captures: DataFrame, path: str, record_id: str, url: str, payload: str, seconds: str | None = None, least: int = REVISIT_BYTES) -> None:
    """Write every capture as a record under ``path``. ``seconds``: column of epoch seconds, else made from the id.

    Payloads are shuffled only if the revisits are too many to broadcast.
    """
    marks = marked(captures, record_id, payload, min(least, SIZES[0] + 1))
    largest = marks.agg(F.max("_bytes")).first()[0] or 0
    body = F.coalesce(captures[payload], F.lit(""))
    when = captures[seconds] if seconds else F.lit(EPOCH) + F.coalesce(captures[record_id], F.lit(0)) % 31_536_000
    rows = captures.select(captures[record_id].alias("_id"), F.sha1(body.cast("binary")).alias("_digest"), captures[url].alias("_url"), body.alias("_body"), when.cast("long").alias("_at"))
    again = stored(revisits(marks.where(F.col("_bytes") >= least)).withColumnsRenamed({"_id": "_rid", "_digest": "_rdigest"}), "capture-revisits")
    rows = rows.join(bounded(again), rows["_id"].eqNullSafe(again["_rid"]) & (rows["_digest"] == again["_rdigest"]), "left")
    revisit = F.col("_rdigest").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("_body").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("_body")))
    safe_url = F.regexp_replace(F.regexp_replace(F.col("_url"), "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", name(F.col("_id"))),
        _header("WARC-Date", F.date_format(F.timestamp_seconds("_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Target-URI", safe_url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.when(revisit, name(F.col("_keeper")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    for low, high in zip((-1, *SIZES), SIZES, strict=False):
        if low < largest:  # the first class always
            size = F.octet_length("_body")
            part = rows.where((size > low) & ((size <= high) if high < SIZES[-1] else F.lit(True)))
            writer = part.select(record.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip")
            writer.option("maxRecordsPerFile", ARCHIVE_BYTES // high).text(path)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed and comma-joined, then path and query."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].rsplit("@", 1)[-1].lower().split(":")[0]
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/")


def records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unpacked archive, headers by lower-case name, block) of each record."""
    at = 0
    while True:
        start, line = at, stream.readline()
        at += len(line)
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {start}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            at += len(line)
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        at += len(line)
        block = stream.read(int(head["content-length"]))
        at += len(block)
        yield start, head, block


def _number(name: str | None) -> int | None:
    tail = (name or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail and tail != "null" else None


def entry(archive: str, offset: int, head: dict[str, str], block: bytes) -> tuple:
    """One index entry, as in INDEX_SCHEMA. A response's digest is taken anew and compared."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    said, kind = head["warc-payload-digest"].partition(":")[2], head["warc-type"]
    digest = hashlib.sha1(payload).hexdigest() if kind == "response" else said
    return (url_key(head.get("warc-target-uri")), head["warc-date"], _number(head["warc-record-id"]), kind, digest, length, _number(head.get("warc-refers-to")), digest == said and (kind == "revisit" or length == len(payload)), archive, offset)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


class _Unzipped(io.RawIOBase):
    """Reads gzip members from bytes without holding the unpacked archive."""

    def __init__(self, packed: bytes) -> None:
        self.packed, self.at, self.zip = packed, 0, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            out = self.zip.decompress(self.zip.unconsumed_tail or self._more(), len(into))
            if out:
                into[: len(out)] = out
                return len(out)
            if self.zip.eof:
                rest = self.zip.unused_data
                if not rest and self.at >= len(self.packed):
                    return 0
                self.at -= len(rest)
                self.zip = zlib.decompressobj(31)
            elif self.at >= len(self.packed) and not self.zip.unconsumed_tail:
                return 0

    def _more(self) -> bytes:
        part = self.packed[self.at : self.at + 65536]
        self.at += len(part)
        return part


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives under ``path``; each archive's are sorted: one capture run."""
    import pyarrow as pa

    arrow_bounds(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream = io.BufferedReader(_Unzipped(content.as_py()), 1 << 16)
                archive = path.rpartition("/")[2]
                yield _batch(sorted((entry(archive, *r) for r in records(stream)), key=_order))

    out = files.mapInArrow(run, INDEX_SCHEMA)
    return out


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


class LoserTree:
    """Merges k sorted iterators with about log2 k comparisons an entry.

    Inner nodes keep the loser of their match, node 0 the overall winner; replacing
    the winner replays only its path to the root.
    """

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.head = [next(r, None) for r in runs]
        self.keys = [None if x is None else _order(x) for x in self.head]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.head[w := self.tree[0]] is not None:
            yield self.head[w]
            self.head[w] = row = next(self.runs[w], None)
            self.keys[w] = None if row is None else _order(row)
            self._play(w)


def _loaded(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield from pickle.load(f)
            except EOFError:
                return


def merged_rows(rows: Iterable[tuple], most: int = SPILL_ENTRIES) -> Iterator[tuple]:
    """All rows in order. Rows come in runs by archive; a row out of order opens another run."""
    with tempfile.TemporaryDirectory() as folder:
        spilled: list[str] = []
        runs: dict[str, list[list[tuple]]] = {}
        held = 0

        def merge() -> Iterator[tuple]:
            return iter(LoserTree([iter(r) for pieces in runs.values() for r in pieces]))

        for row in rows:
            pieces = runs.setdefault(row[8], [[]])
            if pieces[-1] and _order(row) < _order(pieces[-1][-1]):
                pieces.append([])
            pieces[-1].append(row)
            held += 1
            if held >= most:
                spilled.append(f"{folder}/{len(spilled)}")
                with open(spilled[-1], "wb") as f:
                    part: list[tuple] = []
                    for r in merge():
                        part.append(r)
                        if len(part) == 1000:
                            pickle.dump(part, f)
                            part = []
                    pickle.dump(part, f)
                runs, held = {}, 0
        yield from LoserTree([*map(_loaded, spilled), merge()])


def history(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Entries of all runs in global order of URL key, time and id: partition by partition, row by row."""
    import pyarrow as pa

    keys = [F.col("url_key").asc_nulls_first(), F.col("captured_at").asc_nulls_first(), F.col("record_id").asc_nulls_first(), F.col("archive"), F.col("offset")]
    dealt = runs.repartitionByRange(*([partitions] if partitions else []), *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        part: list[tuple] = []
        for row in merged_rows(rows):
            part.append(row)
            if len(part) == 4096:
                yield _batch(part)
                part = []
        if part:
            yield _batch(part)

    arrow_bounds(runs.sparkSession)
    return dealt.mapInArrow(run, INDEX_SCHEMA)


def captured(captures: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    """Write the captures as archives in the shared folder, read them back, merge their indexes."""
    spark = captures.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(captures, path, record_id, url, payload)
    return history(stored(read_runs(spark, path), "capture-runs"))
