"""Ordered scans of long sequences in segments: no task holds a whole sequence.

A sequence (the rows of an image, a channel, a chain) is dealt to tasks by ranges of (key, order). Each
segment is scanned by itself and summed up in one row; summaries, as many as there are segments, are scanned in turn, and what
comes before a segment (or after it) is carried over its edge. Results are the same for any number of segments.

``scanned`` does this for sums, maxima, last and next known values and neighbours. ``chained`` does it for the
greedy choice "keep a row, then the first one at or beyond where it ends": a segment is summed up as where
it is left for each way in, and ways in are few, as they lie within the reach of what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from frameloom.sources.scratch import stored

SEGMENT = "_segment"


def segmented(rows: DataFrame, keys: list[str], order: list[str], segments: int | None = None) -> DataFrame:
    """``rows`` with the number of their range of (keys, order); rows alike in these stay together. Stored."""
    segments = segments or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(segments, *keys, *order).withColumn(SEGMENT, F.spark_partition_id()), "segments")


def _beside(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``carried``, a row for each segment and key."""
    named = carried.withColumnsRenamed({c: f"_of{i}" for i, c in enumerate([SEGMENT, *keys])})
    same = F.col(SEGMENT) == F.col("_of0")
    for i, key in enumerate(keys, 1):
        same = same & F.col(key).eqNullSafe(F.col(f"_of{i}"))
    return rows.join(named, same).drop(*(f"_of{i}" for i in range(len(keys) + 1)))


def scanned(
    laid: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    reaches: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    next_: dict[str, Column] | None = None,
) -> DataFrame:
    """Segmented rows with, by name: sums up to the row, maxima before it, last known values up to it, next ones from it on, and neighbours' values.

    A neighbour that is not there is null. Nulls count as nothing in sums and maxima; sums start from zero.
    """
    sums, reaches, last, lag, lead, next_ = (x or {} for x in (sums, reaches, last, lag, lead, next_))
    at = F.struct(*order)
    here, over = Window.partitionBy(SEGMENT, *keys).orderBy(*order), Window.partitionBy(*keys).orderBy(SEGMENT)
    upto, before = (here.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    # from the far end, as Spark goes over all that follows again for each row
    onward = Window.partitionBy(SEGMENT, *keys).orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.col(SEGMENT).desc()).rowsBetween(Window.unboundedPreceding, -1)
    own, totals, carries, whole = {}, [], [], {}

    def add(name: str, value: Column, local: Column, total: Column, carry: Column, both) -> None:
        own[f"_l_{name}"] = local
        totals.append(total.alias(f"_t_{name}"))
        carries.append(carry.alias(f"_c_{name}"))
        whole[name] = both(F.col(f"_l_{name}"), F.col(f"_c_{name}"))

    for name, v in sums.items():
        add(name, v, F.coalesce(F.sum(v).over(upto), F.lit(0)), F.sum(v), F.sum(f"_t_{name}").over(earlier), lambda a, c: a + F.coalesce(c, F.lit(0)))
    for name, v in reaches.items():
        add(name, v, F.max(v).over(before), F.max(v), F.max(f"_t_{name}").over(earlier), lambda a, c: F.greatest(a, c))
    for name, v in last.items():
        add(name, v, F.last(v, ignorenulls=True).over(upto), F.max_by(v, F.when(v.isNotNull(), at)), F.last(f"_t_{name}", ignorenulls=True).over(earlier), lambda a, c: F.coalesce(a, c))
    for name, v in next_.items():
        add(name, v, F.last(v, ignorenulls=True).over(onward), F.min_by(v, F.when(v.isNotNull(), at)), F.last(f"_t_{name}", ignorenulls=True).over(later), lambda a, c: F.coalesce(a, c))
    for name, v in lag.items():
        add(name, v, F.lag(F.struct(v.alias("v"))).over(here), F.max_by(F.struct(v.alias("v")), at), F.lag(f"_t_{name}").over(over), lambda a, c: F.coalesce(a, c)["v"])
    for name, v in lead.items():
        add(name, v, F.lead(F.struct(v.alias("v"))).over(here), F.min_by(F.struct(v.alias("v")), at), F.lead(f"_t_{name}").over(over), lambda a, c: F.coalesce(a, c)["v"])
    carried = laid.groupBy(SEGMENT, *keys).agg(*totals).select(SEGMENT, *keys, *carries)
    rows = _beside(laid.withColumns(own), carried, keys)
    return rows.select(*laid.columns, *(v.alias(name) for name, v in whole.items()))


def _next_places(place, until):
    """Of each row the first one at or beyond its end: rows sorted by place. The last one leads out."""
    import numpy as np

    return np.maximum(np.searchsorted(place, until, side="left"), np.arange(1, len(place) + 1))


def chained(rows: DataFrame, keys: list[str], place: str, until: str, segments: int | None = None, laid_out: bool = False) -> DataFrame:
    """The rows kept by going through each key's rows by ``place``: the first, then each whose place is at or beyond ``until`` of the last one kept.

    Rows without a place or end are left out; of rows alike in key and place the one that ends first comes first.
    ``laid_out``: stored in their segments of (keys, place), as ``scanned`` takes them.
    """
    import pyarrow as pa

    laid = segmented(rows.where(F.col(place).isNotNull() & F.col(until).isNotNull()), keys, [place], segments)
    reach = laid.groupBy(SEGMENT, *keys).agg(F.max(until).alias("_far")).withColumn("_reach", F.max("_far").over(Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1))).drop("_far")
    sort = [(place, "ascending"), (until, "ascending")]
    ways_schema = laid.select(SEGMENT, *keys).schema.add("_last", "long").add("_places", T.ArrayType(T.LongType())).add("_exits", T.ArrayType(T.LongType()))
    ways_names = ways_schema.names

    def ways(table: pa.Table) -> pa.Table:
        """Where a segment is left for each way in, and where its last row is."""
        import numpy as np

        table = table.sort_by(sort)
        at, end = (table.column(c).to_numpy() for c in (place, until))
        after = _next_places(at, end)
        out = end.copy()
        for i in range(len(at) - 2, -1, -1):
            if after[i] < len(at):
                out[i] = out[after[i]]
        far = table.column("_reach")[0].as_py()
        ins = 1 if far is None else min(len(at), int(np.searchsorted(at, far, side="left")) + 1)
        ends = [i for i in range(ins) if i + 1 == ins or out[i] != out[i + 1]]  # of ways in that lead to one place the last
        head = [table.column(c).slice(0, 1).combine_chunks() for c in (SEGMENT, *keys)]
        return pa.Table.from_arrays([*head, pa.array([int(at[-1])]), pa.array([at[ends].tolist()], pa.list_(pa.int64())), pa.array([out[ends].tolist()], pa.list_(pa.int64()))], names=ways_names)

    entry_schema = laid.select(SEGMENT, *keys).schema.add("_entry", "long")
    entry_names = entry_schema.names

    def entries(table: pa.Table) -> pa.Table:
        """The way into each segment of a key: a row for each segment goes in, with the few ways of each."""
        from bisect import bisect_left

        table, state, found = table.sort_by(SEGMENT), None, []
        for last, places, exits in zip(*(table.column(c).to_pylist() for c in ("_last", "_places", "_exits")), strict=True):
            found.append(state)
            if state is None or state <= last:
                state = exits[0 if state is None else bisect_left(places, state)]
        return pa.Table.from_arrays([*(table.column(c) for c in (SEGMENT, *keys)), pa.array(found, pa.int64())], names=entry_names)

    columns = laid.columns

    def keep(table: pa.Table) -> pa.Table:
        import numpy as np

        table = table.sort_by(sort)
        at, end = (table.column(c).to_numpy() for c in (place, until))
        after, entry, kept = _next_places(at, end), table.column("_entry")[0].as_py(), []
        i = 0 if entry is None else int(np.searchsorted(at, entry, side="left"))
        while i < len(at):
            kept.append(i)
            i = int(after[i])
        return table.select(columns).take(pa.array(kept, pa.int64()))

    narrow = _beside(laid.select(SEGMENT, *keys, place, until), reach, keys)
    found = narrow.groupBy(SEGMENT, *keys).applyInArrow(ways, ways_schema)
    known = stored(found.groupBy(*keys).applyInArrow(entries, entry_schema), "entries")
    kept = _beside(laid, known, keys).groupBy(SEGMENT, *keys).applyInArrow(keep, laid.schema)
    return stored(kept, "chain") if laid_out else kept.drop(SEGMENT)
