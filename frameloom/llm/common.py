"""Shared helpers: scratch storage on the cluster's shared folder, text expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as the contracts write it: space and U+0009 to U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows of one Arrow batch sent to Python: whole texts are long, so batches stay small.
ARROW_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see (``spark.checkpoint.dir``).

    Only where the session names none (local mode, tests) a temporary one is set.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    known = context.getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    path = "file://" + tempfile.mkdtemp(prefix="frameloom-")
    spark.sparkContext.setCheckpointDir(path)
    return path


#: The folder below ``scratch_root`` that ``passing_scratch`` has opened, if any.
_PASSING: ContextVar[str] = ContextVar("frameloom-passing", default="")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{_PASSING.get()}{label}-{uuid.uuid4().hex}"


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate results made inside are deleted at the end: whatever reads them must be written by then."""
    token = _PASSING.set(f"{_PASSING.get()}passing-{uuid.uuid4().hex}/")
    try:
        yield
    finally:
        path = f"{scratch_root(spark)}/{_PASSING.get()}"
        _PASSING.reset(token)
        removed(spark, path)


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate results; ``cleared`` empties it."""
    return f"{shared_dir(spark)}/frameloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage in a way that outlives any executor, and fixes the rows, so
    that later jobs all see the same ones.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Delete this application's intermediate results; DataFrames that still read them end with it."""
    removed(spark, scratch_root(spark))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def find_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the session names no path of its own."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def arrow_bounds(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python sees, by rows and by bytes; let workers find this package."""
    find_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only. Text of one byte a character takes the cheap way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, space: str = SPACE_CLASS, chars: str = SPACE_CHARS) -> Column:
    """The words between runs of white space; null and blank texts have none."""
    inner = F.trim(text, F.lit(chars))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, f"[{space}]+"))


def packed(rows: DataFrame, **named: str) -> DataFrame:
    """The whole row as struct ``_row``, and the named columns beside it: no outer name can clash with inner ones."""
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.select(whole.alias("_row"), *(F.col(f"`{column}`").alias(name) for name, column in named.items()))


def kept_names(columns: list[str], new: list[str]) -> list[str]:
    """Names of ``columns`` beside ``new`` ones: a column whose name is taken goes on as ``<name>_in``."""
    out, taken = [], {n.lower() for n in (*new, *columns)}
    for column in columns:
        name = column
        if column.lower() in {n.lower() for n in new}:
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
        out.append(name)
    return out


def unpacked(rows: DataFrame, columns: list[str], new: dict[str, Column] | None = None, replaced: str | None = None) -> DataFrame:
    """The packed columns again, and the new ones; only ``replaced`` gives its place to a new one of its name."""
    new = new or {}
    old = [c for c in columns if c != replaced]
    names = kept_names(old, list(new))
    return rows.select(*(F.col("_row").getField(c).alias(n) for c, n in zip(old, names, strict=True)), *(v.alias(n) for n, v in new.items()))


def filtered(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that fulfil ``condition``, judged where it stands.

    The optimiser would push the condition below the projections it comes from and
    repeat their nested expressions once for each use. A column that is not
    deterministic keeps it in place.
    """
    return rows.withColumn("_place", F.monotonically_increasing_id()).where(condition & (F.col("_place") >= 0)).drop("_place")


def doc_key(*cols: str) -> list[Column]:
    """A row's identity where ids may repeat or be null: the id and a hash of the text."""
    return [F.col(cols[0]).alias("_id"), F.md5(F.coalesce(F.col(cols[1]), F.lit("")).cast("binary")).alias("_h")]


#: Rows and bytes (as JSON text) of a stored side that may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def bounded(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``side``, a stored DataFrame, hinted for broadcast if it is small by rows and by bytes.

    Beyond that Spark plans a shuffled join, with the same rows.
    """
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in side.columns))))
    rows, held = side.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(side) if rows <= most and held <= BROADCAST_BYTES else side
