"""Raw evidence images as ranges of bytes.

``evidence`` is a data source of windows: ``spark.read.format("evidence").option("path", ...)`` plans a partition for each
window, reads it with positioned reads, and takes conditions on ``core_start`` and ``core_end`` into its plan, so windows
that cannot hold what is asked for are not read. ``bytes_of`` reads stretches by place, on executors: no image
passes through the driver, a closure or a broadcast.

An image is cut into core windows; a task reads its window and a little beyond with
positioned reads, so images of any size scan in parallel and a hit belongs to the
window that holds its start. The path must be one that executors see too; images in a
store that only Spark reads come in through ``stored_images``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

WINDOW = 64 << 20
EWF_MAGIC = bytes.fromhex("455646090d0aff00")


def open_kind(path: str) -> str:
    """raw, or an error for a segmented container: those need a library that is not at hand."""
    with open(path, "rb") as f:
        if f.read(8) == EWF_MAGIC:
            raise ValueError("E01 containers are not supported; export the image as raw")
    return "raw"


def windows(spark: SparkSession, start: int, end: int, overlap: int, size: int = WINDOW) -> DataFrame:
    """core_start, core_end, search_end of each window of [start, end)."""
    n = max(0, -(-(end - start) // size))
    core = F.col("id") * size + start
    return spark.range(n).select(core.alias("core_start"), F.least(core + size, F.lit(end)).alias("core_end"), F.least(core + size + overlap, F.lit(end)).alias("search_end"))


def read_windows(spark: SparkSession, path: str, overlap: int, start: int = 0, end: int | None = None, size: int = WINDOW) -> DataFrame:
    """image, core_start, core_end, before (the byte before the window, -1 at the image's start), data. One window a row."""
    import pyarrow as pa

    open_kind(path)
    end = os.path.getsize(path) if end is None else end
    plan = windows(spark, start, end, overlap, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fd = os.open(path, os.O_RDONLY)
        try:
            for batch in batches:
                for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    lead = os.pread(fd, 1, a - 1)[0] if a else -1
                    data = os.pread(fd, c - a, a)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([a]), pa.array([b]), pa.array([lead], pa.int32()), pa.array([data], pa.binary())], names=["image", "core_start", "core_end", "before", "data"])
        finally:
            os.close(fd)

    return plan.repartition(max(1, min(4096, -(-(end - start) // size)))).mapInArrow(run, "image string, core_start long, core_end long, before int, data binary")


def stored_images(spark: SparkSession, path: str) -> DataFrame:
    """Whole images of moderate size from any store, one a row, in the shape of ``read_windows``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("image"), F.lit(0).cast("long").alias("core_start"), F.col("length").alias("core_end"), F.lit(-1).alias("before"), F.col("content").alias("data"))


WINDOW_SCHEMA = "image string, core_start long, core_end long, before int, data binary"


class Window(InputPartition):
    """[core_start, core_end) of an image, read up to ``search_end``."""

    def __init__(self, core_start: int, core_end: int, search_end: int) -> None:
        super().__init__((core_start, core_end, search_end))
        self.core_start, self.core_end, self.search_end = core_start, core_end, search_end


class EvidenceReader(DataSourceReader):
    """Plans and reads the windows of one image."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        open_kind(self.path)
        size = os.path.getsize(self.path)
        self.start, self.end = int(options.get("start", 0)), min(size, int(options.get("end", size)))
        self.window, self.overlap = int(options.get("window", WINDOW)), int(options.get("overlap", 0))
        self.conditions: list[tuple[str, str, int]] = []

    def pushFilters(self, filters: list[Filter]):
        """Remember what bounds a window's edges. Spark applies all conditions again."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and f.attribute in (("core_start",), ("core_end",)):
                self.conditions.append((f.attribute[0], signs[type(f)], int(f.value)))
            yield f

    def _holds(self, w: Window) -> bool:
        tests = {"=": int.__eq__, ">": int.__gt__, ">=": int.__ge__, "<": int.__lt__, "<=": int.__le__}
        return all(tests[sign](getattr(w, edge), value) for edge, sign, value in self.conditions)

    def partitions(self) -> list[Window]:
        starts = range(self.start, self.end, self.window)
        whole = (Window(a, min(a + self.window, self.end), min(a + self.window + self.overlap, self.end)) for a in starts)
        return [w for w in whole if self._holds(w)]

    def read(self, partition: Window | None):
        if partition is None:  # Spark reads once where nothing is planned
            return
        fd = os.open(self.path, os.O_RDONLY)
        try:
            a = partition.core_start
            lead = os.pread(fd, 1, a - 1)[0] if a else -1
            yield self.path, a, partition.core_end, lead, os.pread(fd, partition.search_end - a, a)
        finally:
            os.close(fd)


class Evidence(DataSource):
    """Options: path; window and overlap in bytes; start and end of the part to read."""

    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return WINDOW_SCHEMA

    def reader(self, schema) -> EvidenceReader:
        return EvidenceReader(dict(self.options))


def evidence(spark: SparkSession, path: str, overlap: int = 0, window: int = WINDOW, start: int = 0, end: int | None = None) -> DataFrame:
    """The windows of an image by the ``evidence`` source, registered with the session."""
    spark.dataSource.register(Evidence)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("evidence").option("path", path).option("overlap", overlap).option("window", window).option("start", start)
    return (reader if end is None else reader.option("end", end)).load()


def bytes_of(spans: DataFrame, source: DataFrame | None = None, start: str = "start", length: str = "length", name: str = "data") -> DataFrame:
    """``spans`` (image, start, length, ...) with the bytes there, as many as the image has.

    Without a ``source`` the image's name is its path, and every task reads its own spans, in order of place.
    With one (windows as of ``read_windows``) spans meet the window that holds their start, whose data must reach over them.
    """
    if source is None:
        return _read_spans(spans, start, length, name)
    size = source.agg(F.max(F.col("core_end") - F.col("core_start"))).first()[0] or 1
    cell = lambda c: F.floor(c / size).cast("long")
    windows = source.where("core_end > core_start").select(
        F.col("image").alias("_i"), "core_start", "core_end", F.col("data").alias("_d"), F.explode(F.sequence(cell(F.col("core_start")), cell(F.col("core_end") - 1))).alias("_cell")
    )
    at = F.col(start)
    own = spans.withColumn("_own", cell(at)).join(windows, (F.col("image") == F.col("_i")) & (F.col("_own") == F.col("_cell")) & (at >= F.col("core_start")) & (at < F.col("core_end")))
    held = F.substring(F.col("_d"), (at - F.col("core_start") + 1).cast("int"), F.col(length).cast("int"))
    return own.select(*spans.columns, held.alias(name))


def _read_spans(spans: DataFrame, start: str, length: str, name: str) -> DataFrame:
    import pyarrow as pa

    columns = spans.columns
    at = [columns.index(c) for c in ("image", start, length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, fd = None, None
        try:
            for batch in batches:
                out = []
                for image, a, n in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                    if image != path:
                        if fd is not None:
                            os.close(fd)
                        path, fd = image, os.open(image, os.O_RDONLY)
                    out.append(os.pread(fd, n, a))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*columns, name])
        finally:
            if fd is not None:
                os.close(fd)

    return spans.sortWithinPartitions("image", start).mapInArrow(run, spans.select("*").schema.add(name, "binary"))
