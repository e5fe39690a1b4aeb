"""Connected components by alternating large-star and small-star steps.

Each step is a minimum by key and a join, never a collected neighbourhood, so a hub
with millions of neighbours is spread by partial aggregation and skew-join splits.
Every round is written to the shared folder, which cuts lineage and survives the
loss of executors. Rounds grow with the logarithm of the number of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import stored

#: Far above any logarithm met; a guard against a defect, not a cut.
MOST_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of ``edges`` (a, b of one type).

    Steps end as soon as the edges are stars: every ``a`` has one ``b``, and no ``b`` is an ``a``.
    As a > b, each ``b`` is then the smallest of its component.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _are_stars(now):
            break
        now = stored(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether no larger end of an edge has a second edge. ``edges``: distinct (a, b) with a > b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()
