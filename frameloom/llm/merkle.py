"""Merkle manifest of a dataset, with a proof for every row, by superblock reduction.

A leaf is the hash of a row's columns; the leaves of a source stand in the order of their id, and every
``FANOUT`` consecutive nodes become their hash until one is left: the source's subroot. Subroots in the
order of their sources become the root in the same way.

No task sees a whole source. Rows are dealt by ranges of (source, id), numbered within their range, and
shifted by what the ranges before hold. A superblock is the bucket ``index // FANOUT ** LEVELS``:
``applyInPandas`` collapses its ``LEVELS`` levels at once to one node, and the nodes of all superblocks are
reduced again until each source has one. Every round is a table of 1 / ``FANOUT ** LEVELS`` of the rows of the one before.
Proofs come back down the same rounds: a superblock's own path is made once, sent to its bucket
by a cogroup, and appended to each member's path inside the bucket. Hashes of leaves are all that
is shuffled; texts are read once, in the pass that hashes them.

Defined cases: null columns hash as ``-``; rows without a source form one group, ahead of all others; null ids
come first; rows of one id stand in the order of their leaf, and equal rows are leaves of their own; an
empty table has no rows and no root; a lone leaf is its source's subroot, and a lone subroot the root. Only the named columns
are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.llm.common import bounded, find_package, stored

FANOUT = 16
#: Levels that one superblock collapses.
LEVELS = 2


def leaf(columns: Iterable[Column]) -> Column:
    """Hash of a row: each value as UTF-8 byte count, colon and value, or a dash where null."""
    whole = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*whole).cast("binary"), 256)


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels_over(nodes: int, fanout: int = FANOUT) -> int:
    """Levels between so many nodes and their root."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def collapsed(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes, and those of each level above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(levels: list[list[str]], at: int, fanout: int = FANOUT) -> tuple[list[str], list[str]]:
    """What stands left and right of a node in its run, for each level below the last."""
    left, right = [], []
    for nodes in levels[:-1]:
        first = at - at % fanout
        left.append("".join(nodes[first:at]))
        right.append("".join(nodes[at + 1 : first + fanout]))
        at //= fanout
    return left, right


def folded(node: str, left: Iterable[str], right: Iterable[str]) -> str:
    """The root that a node and its siblings lead to."""
    for before, after in zip(left, right, strict=True):
        node = digest((before, node, after))
    return node


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``i``, their place in their group from zero, and ``n``, the rows of the group.

    Ranges of (group, order) are numbered apart and shifted by the counts of the ranges before: one shuffle,
    and no window over a whole group. Rows that are alike are told apart by a number of their own.
    """
    spark = rows.sparkSession
    # written first, so that finding the ranges does not compute the rows again
    rows = stored(rows.withColumn("_own", F.monotonically_increasing_id()), label)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "_own"]
    placed = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("_range", F.shiftright("_at", 33)).drop("_own"), f"{label}-placed")
    held = placed.groupBy(F.col("_range").alias("_r"), F.col(group).alias("_g")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    over = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_rows").over(over.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = stored(held.select("_r", "_g", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(over).alias("n")), f"{label}-shifts")
    both = placed.join(bounded(shifts), (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return both.withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_r", "_g", "_shift")


def _superblocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("b", F.floor(F.col("i") / size).cast("long"))


def reduced(nodes: DataFrame, most: int, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """``nodes`` (g, i, h, n) and the tables of all rounds above it; the last has a node for each ``g``.

    ``most``: nodes of the largest group.
    """
    size, rounds = fanout**levels, [nodes]

    def collapse(frame):
        import pandas as pd

        frame = frame.sort_values("i")
        n = int(frame["n"].iloc[0])
        (root,) = collapsed(frame["h"].tolist(), min(levels, levels_over(n, fanout)), fanout)[-1]
        return pd.DataFrame({"g": frame["g"].iloc[:1], "i": frame["b"].iloc[:1], "h": [root], "n": [-(-n // size)]})

    while len(rounds) < 2 or most > 1:
        blocks = _superblocks(rounds[-1].select("g", "i", "h", "n"), size).groupBy("g", "b")
        rounds.append(stored(blocks.applyInPandas(collapse, "g long, i long, h string, n long"), "merkle-round"))
        most = -(-most // size)
    return rounds


def _members(nodes: DataFrame, paths: DataFrame, make, schema: str, fanout: int, levels: int) -> DataFrame:
    """``make``(row, left, right, tail) for each node of ``nodes``, whose superblock's path is in ``paths`` (g, i, left, right, tail)."""
    size = fanout**levels

    def members(frame, path):
        import pandas as pd

        frame = frame.sort_values("i")
        steps = collapsed(frame["h"].tolist(), min(levels, levels_over(int(frame["n"].iloc[0]), fanout)), fanout)
        above = [list(path[c].iloc[0]) for c in ("left", "right", "tail")]
        out = []
        for at, row in enumerate(frame.to_dict("records")):
            left, right = siblings(steps, at, fanout)
            out.append(make(row, left + above[0], right + above[1], above[2]))
        return pd.DataFrame(out)

    whole = paths.select("g", F.col("i").alias("b"), "left", "right", "tail")
    return _superblocks(nodes, size).groupBy("g", "b").cogroup(whole.groupBy("g", "b")).applyInPandas(members, schema)


def descended(rounds: list[DataFrame], paths: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Paths of the nodes of the second round, from those of the last one's: g, i, left, right, tail."""
    schema = "g long, i long, left array<string>, right array<string>, tail array<string>"

    def make(row, left, right, tail):
        return {"g": row["g"], "i": row["i"], "left": left, "right": right, "tail": tail}

    for nodes in reversed(rounds[1:-1]):
        paths = stored(_members(nodes, paths, make, schema, fanout, levels), "merkle-paths")
    return paths


def audited(docs: DataFrame, doc_id: str, group: str, columns: list[str], altered: dict[str, Column], tampered: Column, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Each document's leaf, subroot, root and proof, and whether a later copy of it still leads to the root.

    ``altered`` gives the later values of some columns for the documents where ``tampered`` holds.
    Returns doc_id, leaf, subroot, root, left and right (siblings by level, joined), later_leaf, folded_root, verified.
    """
    find_package(docs.sparkSession)
    now = leaf(altered.get(c, docs[c]) for c in columns)
    plain = leaf(docs[c] for c in columns)
    marked = F.coalesce(tampered, F.lit(False))
    kind = docs.schema[doc_id].dataType
    rows = docs.select(docs[doc_id].alias("id"), docs[group].alias("source"), plain.alias("h"), F.when(marked, now).alias("later"))
    rows = numbered(rows, "source", ["id", "h"], "merkle-leaves")
    most = rows.agg(F.max("n")).first()[0] or 0
    # places of the sources, as integers that rounds are grouped by
    sources = rows.groupBy("source").agg(F.max("n").alias("_n")).withColumn("_all", F.lit(0).cast("long"))
    sources = stored(numbered(sources.drop("_n"), "_all", ["source"], "merkle-sources").select(F.col("source").alias("_s"), F.col("i").alias("g"), F.col("n").alias("of")), "merkle-places")
    # ids travel as text: pandas has no integers beside nulls
    nodes = rows.join(bounded(sources.drop("of")), F.col("source").eqNullSafe(F.col("_s"))).drop("source", "_s").withColumn("id", F.col("id").cast("string"))
    rounds = reduced(nodes, most, fanout, levels)
    subroots = rounds[-1].select("g", F.col("h").alias("subroot"))
    upper = subroots.join(sources.select("g", "of"), "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.col("subroot").alias("h"), F.col("of").alias("n"))
    upper = stored(upper, "merkle-subroots")
    tops = reduced(upper, upper.count(), fanout, levels)
    none = F.array().cast("array<string>")
    paths = descended(tops, tops[-1].select("g", "i", none.alias("left"), none.alias("right"), F.array("h").alias("tail")), fanout, levels)
    # a source's path of its own to the root, then the subroot beside the root for its documents
    schema = "g long, i long, left array<string>, right array<string>, tail array<string>"
    own = _members(upper, paths, lambda row, left, right, tail: {"g": row["i"], "i": 0, "left": left, "right": right, "tail": [*tail, row["h"]]}, schema, fanout, levels)
    paths = descended(rounds, stored(own, "merkle-paths"), fanout, levels)

    def proof(row, left, right, tail):
        later = row["later"] or row["h"]
        to = folded(later, left, right)
        return {"id": row["id"], "leaf": row["h"], "subroot": tail[1], "root": tail[0], "left": left, "right": right, "later_leaf": later, "folded_root": to, "verified": to == tail[0]}

    typed = "id string, leaf string, subroot string, root string, left array<string>, right array<string>, later_leaf string, folded_root string, verified boolean"
    out = _members(nodes, paths, proof, typed, fanout, levels)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", doc_id)


def proof_digest(left: Column, right: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), "").cast("binary"), 256)
