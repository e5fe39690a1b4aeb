"""Vector code compression by filtering Lloyd: product codes whose codebooks are fitted over kd-trees.

Vectors are made integers and cut into equal parts; each part position has a codebook, and a vector's code
is the index of the nearest entry for each part. Every partition builds a kd-tree over its parts, in blocks of at
most ``BLOCK`` vectors: nodes are stretches of the points in tree order, with their bounding box, sum and count kept beside them,
and the blocks are stored, so trees are built once for all rounds. A round walks a tree from its root with all entries as candidates. In
each node the candidate nearest to the box's middle drops every other that is nowhere in the box nearer than it is
(tested at the box's corner farthest towards the other); where one is left it takes the whole subtree by its sum and count,
and only leaves with several left compare points. All arithmetic is in integers, and an equal distance counts for the
lower index, so the results are those of comparing every part with every entry.

A round leaves one row for each position, entry and component from each task; these are added up, and the driver holds the
codebooks: positions times entries times components, whatever the number of vectors.

Defined cases: vectors that are null, or hold a null or non-finite component, are dropped; shorter vectors count as padded
with zeros up to the longest, and that up to a multiple of the parts; components are held to what keeps
squared distances within 64 bits (±2^27 after scaling for 64 components); with fewer vectors than entries the codebooks are
shorter; unused entries stay; null ids come last in the choice of the first entries, and rows of one id stand in the order of their
vectors; repeated rows count each; an empty table has no rows. A label's summed error is null if it exceeds 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.llm.common import arrow_bounds, bounded, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors of one tree, and points of a leaf.
BLOCK = 8192
LEAF = 24


@lru_cache(maxsize=8)
def shape(n: int, leaf: int = LEAF):
    """first, end, left child (0: a leaf; the right one follows it) of the nodes of a tree over ``n`` points, parents before children."""
    import numpy as np

    first, end, child, at = [0], [n], [], 0
    while at < len(first):
        a, b = first[at], end[at]
        if b - a > leaf:
            child.append(len(first))
            middle = (a + b) // 2
            first += [a, middle]
            end += [middle, b]
        else:
            child.append(0)
        at += 1
    return np.array(first), np.array(end), np.array(child)


def built(points, leaf: int = LEAF):
    """(order, low, high, sums): the points' order in the tree, and each node's box and sum. Nodes halve the widest side."""
    import numpy as np

    first, end, child = shape(len(points), leaf)
    order = np.arange(len(points))
    for node, down in enumerate(child):
        if down:
            a, b = first[node], end[node]
            own = points[order[a:b]]
            side = int((own.max(axis=0) - own.min(axis=0)).argmax())
            order[a:b] = order[a:b][np.argpartition(own[:, side], (a + b) // 2 - a)]
    low, high, sums = (np.zeros((len(child), points.shape[1]), dtype=np.int64) for _ in range(3))
    tree = points[order]
    leaves = np.nonzero(child == 0)[0]
    at = leaves[np.argsort(first[leaves])]  # leaves from left to right hold all points
    low[at], high[at], sums[at] = (f.reduceat(tree, first[at], axis=0) for f in (np.minimum, np.maximum, np.add))
    for node in np.nonzero(child)[0][::-1]:
        a, b = child[node], child[node] + 1
        low[node], high[node], sums[node] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b]), sums[a] + sums[b]
    return order, low, high, sums


def _stretches(first, end):
    """The places of all stretches, one after another."""
    import numpy as np

    n = end - first
    return np.arange(n.sum()) + np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n)


def _squares(a):
    return (a * a).sum(axis=-1)


def assigned(tree, low, high, sums, entries, leaf: int = LEAF):
    """(entry of each point in tree order, each entry's sum, each entry's count, points compared one by one)."""
    import numpy as np

    first, end, child = shape(len(tree), leaf)
    n = len(entries)
    chosen = np.zeros(len(tree), dtype=np.int64)
    total, count = np.zeros(entries.shape, dtype=np.int64), np.zeros(n, dtype=np.int64)
    nodes, candidates, compared = np.array([0]), np.ones((1, n), dtype=bool), 0
    far = np.iinfo(np.int64).max
    rank = np.arange(n)
    while len(nodes):
        away = _squares((low[nodes] + high[nodes])[:, None, :] - 2 * entries)
        away[~candidates] = far
        best = away.argmin(axis=1)
        # the corner of the box that lies farthest from the best towards each other candidate
        corner = np.where(entries > entries[best][:, None, :], high[nodes][:, None, :], low[nodes][:, None, :])
        other, own = _squares(entries - corner), _squares(entries[best][:, None, :] - corner)
        candidates &= (other < own) | ((other == own) & (rank <= best[:, None]))
        one = candidates.sum(axis=1) == 1
        whole, entry = nodes[one], candidates[one].argmax(axis=1)
        chosen[_stretches(first[whole], end[whole])] = np.repeat(entry, end[whole] - first[whole])
        np.add.at(total, entry, sums[whole])
        np.add.at(count, entry, end[whole] - first[whole])
        bottom = ~one & (child[nodes] == 0)
        if bottom.any():
            at = nodes[bottom]
            places = _stretches(first[at], end[at])
            may = np.repeat(candidates[bottom], end[at] - first[at], axis=0)
            points = tree[places]
            # the points' own squares are alike for all entries
            distance = _squares(entries) - 2 * (points @ entries.T)
            distance[~may] = far
            entry = distance.argmin(axis=1)
            chosen[places] = entry
            np.add.at(total, entry, points)
            count += np.bincount(entry, minlength=n)
            compared += len(places)
        down = ~one & (child[nodes] != 0)
        nodes = np.concatenate((child[nodes[down]], child[nodes[down]] + 1))
        candidates = np.concatenate((candidates[down], candidates[down]))
    return chosen, total, count, compared


def bound_of(width: int) -> int:
    """The largest component that keeps a vector's squared distances within 64 bits."""
    return isqrt((1 << 62) // max(width, 1)) // 2


def kept(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """_id, _label and _v (doubles) of the rows whose vector is whole and finite."""
    v = F.col("_v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.select(rows[vec_id].alias("_id"), rows[label].alias("_label"), rows[vector].cast("array<double>").alias("_v"))
    return out.where(v.isNotNull() & whole)


def whole_numbers(vectors, width: int, scale: int = SCALE):
    """Rows of doubles of any length (an Arrow list array) as integers, padded with zeros to ``width``."""
    import numpy as np

    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), dtype=np.int64)
    most = bound_of(width)
    out[np.arange(width) < sizes[:, None]] = np.clip(np.floor(scale * np.clip(flat, -most, most)), -most, most)
    return out


def blocks(rows: DataFrame, width: int, parts: int = PARTS, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """``kept`` rows in blocks: ids and labels in their own order, and for each part the tree as bytes."""
    import pyarrow as pa

    arrow_bounds(rows.sparkSession)
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["_id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["_label"].dataType)), T.StructField("trees", T.ArrayType(T.ArrayType(T.BinaryType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            import numpy as np

            whole = pa.Table.from_batches(held).combine_chunks()
            ids, labels, vectors = (c.chunk(0) for c in whole.columns)
            points, n = whole_numbers(vectors, width, scale), len(whole)
            trees = []
            for part in np.split(points, parts, axis=1):
                order, *boxes = built(part)
                trees.append([x.astype("<i8").tobytes() for x in (order, part[order], *boxes)])
            listed = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for c in (ids, labels)]
            return pa.RecordBatch.from_arrays([*listed, pa.array([trees], pa.list_(pa.list_(pa.binary())))], names=["ids", "labels", "trees"])

        held, n = [], 0
        for batch in batches:
            while len(batch):
                take = batch.slice(0, block - n)
                held.append(take)
                n, batch = n + len(take), batch.slice(len(take))
                if n == block:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)

    return rows.select("_id", "_label", "_v").mapInArrow(run, schema)


def _trees(cell, width: int):
    """order, points, low, high, sums of one part of a block."""
    import numpy as np

    order, *others = (np.frombuffer(b, dtype="<i8") for b in cell)
    return order, *(x.reshape(-1, width) for x in others)


def _round(stored_blocks: DataFrame, codebooks, columns: int):
    """The codebooks after one round: floored means, and the old entry where nothing was assigned."""
    import numpy as np
    import pyarrow as pa

    parts, entries = codebooks.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(codebooks.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for trees in batch.column(0).to_pylist():
                for part, cell in enumerate(trees):
                    _, own, n, _ = assigned(*_trees(cell, columns)[1:], codebooks[part])
                    total[part] += own
                    count[part] += n
        part, entry, at = (x.ravel() for x in np.indices(codebooks.shape))
        used = count[part, entry] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (part, entry, at, total.ravel(), count[part, entry])], names=["part", "entry", "at", "total", "n"])

    sums = stored_blocks.select("trees").mapInArrow(run, "part long, entry long, at long, total long, n long")
    out = codebooks.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # as many as codebooks hold
        out[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return out


class Codebooks:
    """Entries by part, and the scale of their integers."""

    def __init__(self, entries, scale: int = SCALE) -> None:
        self.entries, self.scale = entries, scale

    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        digits = max(2, len(f"{max(self.entries.shape[1] - 1, 0):x}"))
        at = [int(code[i : i + digits], 16) for i in range(0, len(code), digits)]
        return [x / self.scale for part, i in enumerate(at) for x in self.entries[part, i].tolist()]


def compressed(rows: DataFrame, vec_id: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, Codebooks]:
    """(``vec_id``, ``label``, code, error, label_error of every whole vector, codebooks)."""
    import numpy as np
    import pyarrow as pa

    spark = rows.sparkSession
    whole = kept(rows, vec_id, vector, label)
    longest = whole.agg(F.max(F.size("_v"))).first()[0] or 1
    width = -(-longest // parts) * parts
    columns = width // parts
    first = whole.orderBy(F.col("_id").isNull(), "_id", "_v").limit(entries).select("_v").collect()
    start = whole_numbers(pa.array([r["_v"] for r in first], pa.list_(pa.float64())), width)
    codebooks = start.reshape(len(first), parts, columns).transpose(1, 0, 2).copy()
    trees = stored(blocks(whole, width, parts, block), "code-blocks")
    for _ in range(rounds if len(first) else 0):
        codebooks = _round(trees, codebooks, columns)
    shared = spark.sparkContext.broadcast(codebooks)
    ids, labels = (trees.schema[c].dataType.elementType for c in ("ids", "labels"))
    schema = T.StructType([T.StructField("_id", ids), T.StructField("_label", labels), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        digits = max(2, len(f"{max(books.shape[1] - 1, 0):x}"))
        names = np.array([f"{i:0{digits}x}" for i in range(books.shape[1])], dtype=object)
        for batch in batches:
            for row, cells in enumerate(batch.column(2).to_pylist()):
                own = [batch.column(i).slice(row, 1).flatten() for i in range(2)]
                code, error = [], np.zeros(len(own[0]), dtype=np.int64)
                for part, cell in enumerate(cells):
                    order, points, *boxes = _trees(cell, columns)
                    chosen, _, _, _ = assigned(points, *boxes, books[part])
                    entry = np.empty_like(chosen)
                    entry[order] = chosen
                    code.append(names[entry])
                    error[order] += _squares(points - books[part][chosen])
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.sum(code, axis=0), pa.string()), pa.array(error)], names=schema.names)

    out = stored(trees.select("ids", "labels", "trees").mapInArrow(run, schema), "codes")
    by_label = stored(out.groupBy(F.col("_label").alias("_l")).agg(F.try_sum("error").alias("label_error")), "code-labels")
    joined = out.join(bounded(by_label), F.col("_label").eqNullSafe(F.col("_l")))
    return joined.select(F.col("_id").alias(vec_id), F.col("_label").alias(label), "code", "error", "label_error"), Codebooks(codebooks)
