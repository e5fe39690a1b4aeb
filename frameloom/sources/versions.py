"""Tables in versions: rows go to a folder of their own, then a manifest names the folders that are the table now.

A manifest's number is taken by creating its file, which only one writer can, so two writers never both commit on top of
one version, and a writer that reads the table it replaces never writes where it reads. What a crash leaves behind, rows without a
manifest or a manifest that was not written to its end, is no version: readers take the last whole one. Works on any
store that Spark's file system layer reaches and that refuses to create a file twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "_versions"


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was made from."""


def _store(spark: SparkSession, path: str):
    """(file system, path) of the store's own classes."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, where = _store(spark, f"{path}/{FOLDER}")
    if not fs.exists(where):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(where))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, or the last whole one; None if there is none."""
    for number in reversed(_numbers(spark, path)) if version is None else [version]:
        fs, where = _store(spark, f"{path}/{FOLDER}/{number:012d}.json")
        if not fs.exists(where):
            continue
        stream = fs.open(where)
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        try:
            return json.loads(raw)
        except ValueError:
            continue
    return None


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table's rows as of a version, or now; None if it has never been committed."""
    known = manifest(spark, path, version)
    if known is None:
        return None
    schema = T.StructType.fromJson(known["schema"])
    if not known["folders"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in known["folders"]))


def _taken(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Create the manifest of a version, or fail if it is there."""
    fs, where = _store(spark, f"{path}/{FOLDER}/{number:012d}.json")
    try:
        stream = fs.create(where, False)
    except Exception as taken:
        if fs.exists(where):
            raise Conflict(f"version {number} of {path} is taken") from taken
        raise
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        stream.close()


def _committed(rows: DataFrame, path: str, base: dict | None, number: int, keep: bool, note: dict) -> int:
    """``rows`` written beside the folders of ``base`` (or in place of them) and committed as ``number``."""
    spark, folder = rows.sparkSession, f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    old = base["folders"] if base and keep else []
    _taken(spark, path, number, {"version": number, "folders": [*old, folder], "schema": json.loads(rows.schema.json()), "note": note})
    return number


def _next(spark: SparkSession, path: str) -> tuple[dict | None, int]:
    numbers = _numbers(spark, path)
    return manifest(spark, path), (numbers[-1] + 1 if numbers else 1)


def replace(rows: DataFrame, path: str, since: int | None = None, note: dict | None = None) -> int:
    """Commit ``rows``, which may come from the table itself, as its next version. With ``since`` only if that is still the last one."""
    base, number = _next(rows.sparkSession, path)
    if since is not None and (base["version"] if base else 0) != since:
        raise Conflict(f"{path} has changed since version {since}")
    return _committed(rows, path, base, number, False, note or {})


def append_new(rows: DataFrame, path: str, keys: list[str], tries: int = 5) -> int:
    """Add the rows whose ``keys`` the table does not hold yet; of several in ``rows`` one. Tried again on what others committed meanwhile.

    Returns the version: the present one if nothing is new.
    """
    spark = rows.sparkSession
    own = rows.dropDuplicates(keys)
    for _ in range(tries):
        base, number = _next(spark, path)
        now = read(spark, path)
        fresh = own
        if now is not None:
            there = now.select(*(F.col(k).alias(f"_there{i}") for i, k in enumerate(keys))).distinct()
            same = [own[k].eqNullSafe(there[f"_there{i}"]) for i, k in enumerate(keys)]
            fresh = own.join(there, same, "left_anti").select(*now.columns)
            if fresh.isEmpty():
                return base["version"]
        try:
            return _committed(fresh, path, base, number, True, {})
        except Conflict:
            continue
    raise Conflict(f"{path} changed {tries} times meanwhile")

