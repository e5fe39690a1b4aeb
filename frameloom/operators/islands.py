"""Runs in ordered rows: new where a gap, a null or a flag says so; all as window sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.operators.segments import chained, scanned


def run_ids(rows: DataFrame, keys: list[str], order: list[Column], breaks: Column, name: str = "run") -> DataFrame:
    """``rows`` with the number of ``breaks`` up to each row within its key; breaks may use lag over the same window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_b", breaks.cast("int")).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def gap_runs(rows: DataFrame, keys: list[str], ts: str, tie: str, gap: int, nulls: str = "drop", fill: int = -1) -> DataFrame:
    """Runs split where time moves on by more than ``gap`` (an equal gap does not split).

    nulls="drop": rows without time take no part. "keep": they sort as ``fill`` and never
    split; a gap counts only between two neighbours that both have a time.
    """
    if nulls == "drop":
        rows = rows.where(F.col(ts).isNotNull())
        order = [F.col(ts), F.col(tie)]
    else:
        order = [F.coalesce(F.col(ts), F.lit(fill)), F.col(tie)]
    w = Window.partitionBy(*keys).orderBy(*order)
    return run_ids(rows, keys, order, F.coalesce(F.col(ts) - F.lag(ts).over(w) > gap, F.lit(False)))


def jump_runs(rows: DataFrame, keys: list[str], ts: str, place: str, gap: int) -> DataFrame:
    """Runs in order of place, split where time jumps either way by more than ``gap`` from the last known time."""
    w = Window.partitionBy(*keys).orderBy(place)
    known = F.last(ts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return run_ids(rows, keys, [F.col(place)], F.coalesce(F.abs(F.col(ts) - known) > gap, F.lit(False)))


def from_first(rows: DataFrame, keys: list[str], place: str, is_first: Column) -> DataFrame:
    """Rows of each key from the first that fulfils ``is_first`` on."""
    w = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_s", F.max(is_first.cast("int")).over(w)).where("_s = 1").drop("_s")


def attach_to_next(rows: DataFrame, keys: list[str], place: str, closes: Column, name: str = "unit") -> DataFrame:
    """Groups that each end with a row that closes; rows after the last such row belong to none and go."""
    w = Window.partitionBy(*keys).orderBy(place)
    out = rows.withColumn("_c", closes.cast("int")).withColumn(name, F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    has = Window.partitionBy(*keys, name)
    return out.withColumn("_h", F.max("_c").over(has)).where("_h = 1").drop("_c", "_h")


def merge_close(spans: DataFrame, keys: list[str], start: str, end: str, gap: int, strict: bool = True) -> DataFrame:
    """Spans united where the next begins less than ``gap`` after the furthest end so far (``strict``: exactly gap splits)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) - reach >= gap if strict else F.col(start) - reach > gap
    out = run_ids(spans, keys, [F.col(start), F.col(end)], F.coalesce(apart, F.lit(False)), "_m")
    return out.groupBy(*keys, "_m").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_m")


def thinned(rows: DataFrame, keys: list[str], ts: str, step: int, most: int) -> DataFrame:
    """Keep the first time of each key and then each that is ``step`` or more after the last one kept; at most ``most``.

    If more stay, those at places int(i * n / most) are taken. Times are chained and numbered in segments, so a key of
    any length is spread over tasks.
    """
    ends = rows.where(F.col(ts).isNotNull()).select(*keys, F.col(ts), (F.col(ts) + step).alias("_until"))
    kept = chained(ends, keys, ts, "_until", laid_out=True)
    totals = kept.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("*").alias("_n"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    rows = scanned(kept, keys, [ts], sums={"_upto": F.lit(1)}).withColumn("_at", F.col("_upto") - 1).join(totals, same)
    # place p is int(i * n / most) for some i exactly if it is that of the least i with i * n >= p * most
    least = F.ceil(F.col("_at") * most / F.col("_n"))
    picked = (F.col("_n") <= most) | ((least < most) & (F.floor(least * F.col("_n") / most) == F.col("_at")))
    return rows.where(picked).select(*keys, ts)
