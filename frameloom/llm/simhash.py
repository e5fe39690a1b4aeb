"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint is cut into its bytes; the index lists fingerprints under the bytes
they hold at given positions. Two fingerprints that differ in at most ``d`` bits
differ in at most ``d`` bytes, so at least ``bytes - d`` positional bytes are
shared: that is the guaranteed minimum match count. Candidates come from lists keyed
by several positions at once (below), their shared positional bytes are tallied,
pairs under the minimum are dropped, the rest verified bit by bit.

Index keys. With a minimum of T shared of B bytes, any P positions hold at least
T - (B - P) shared ones; keying lists by every combination of that many of the
first P positions loses no pair. For 64 bits and d = 2: T = 6, P = 6, four shared,
15 keys of 32 bits each. Only distinct fingerprints are indexed, so copies cost one.

Long lists (many fingerprints alike in four bytes) are not paired. Their members
are linked through the values within one bit: two fingerprints are within two bits
exactly if some value is within one bit of both, and at most 65 fingerprints
are within one bit of a value, so these groups are bounded by construction and no
link is lost.

Documents without words have fingerprint zero and link like any other. Null ids are
kept as rows and never name a component while another id can.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType

from frameloom.llm.common import arrow_bounds, bounded, packed, stored, unpacked
from frameloom.llm.graph import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Lists up to this length are paired; longer ones go through one-bit neighbours.
LIST_LENGTH = 24
#: Shingles hashed at a time: bounds the bit matrix of very long texts.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, width: int):
    """XXH64 (seed 42) of each run of ``width`` words, repeats included; one of all if fewer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter((xxh64_intdigest(s, 42) for s in shingles), dtype=np.uint64)


def votes_to_fingerprint(hashes) -> int:
    """64 bits: each set if it is set in over half of the hashes."""
    import numpy as np

    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK].astype(">u8"))
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str, text: str, width: int = 5) -> DataFrame:
    """doc_id and ``fp``, the 64-bit fingerprint as a signed long. One pass, no shuffle."""
    import pyarrow as pa

    arrow_bounds(docs.sparkSession)
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [votes_to_fingerprint(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return source.mapInArrow(run, source.schema[:1].add("fp", "long"))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(255)


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally: at how many of the eight positions both hold the same byte."""
    return sum((_byte(a, i) == _byte(b, i)).cast("int") for i in range(8))


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (a, b) over distinct ``fp``: enough to connect all within ``bits`` bits (at most 2)."""
    if not 0 <= bits <= 2:
        raise ValueError("one-bit neighbours join fingerprints up to two bits apart")
    least = 8 - bits
    positions = 6
    agree = least - (8 - positions)
    masks = [sum(255 << (8 * p) for p in combo) for combo in combinations(range(positions), agree)]
    index = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("k")) for i, m in enumerate(masks)))).alias("e")).select("e.c", "e.k", "fp")
    lists = index.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    postings = stored(index.join(lists, ["c", "k"]), "simhash-postings")
    short = postings.where(F.col("n") <= LIST_LENGTH).groupBy("c", "k").agg(F.array_sort(F.collect_list("fp")).alias("l"))
    pairs = (
        short.select(F.posexplode("l").alias("i", "a"), "l")
        .select("a", F.explode(F.slice("l", F.col("i") + 2, LIST_LENGTH)).alias("b"))
        .where(shared_bytes(F.col("a"), F.col("b")) >= least)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    )
    crowded = postings.where(F.col("n") > LIST_LENGTH).select("fp").distinct()
    near = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64))]
    stars = (
        crowded.select("fp", F.explode(F.array(*near)).alias("v"))
        .groupBy("v")
        .agg(F.collect_set("fp").alias("l"))
        .where(F.size("l") > 1)
        .select(F.array_min("l").alias("a"), F.explode("l").alias("b"))
        .where("a <> b")
    )
    if bits < 2:
        stars = stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return pairs.union(stars).distinct()


def classes(marked: DataFrame, bits: int = 2) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable over links, itself included.

    ``marked`` holds doc_id and fp. Copies share a fingerprint and are collapsed
    before anything is indexed; the class of a fingerprint is joined back at the end.
    """
    marked = stored(marked, "simhash-fp")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(fps.select("fp"), bits))
    rooted = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Near-duplicate groups: places of a signature, and how many of them 0.8 alike texts share at least.
PLACES = 64
LEAST_SHARED = 40
#: Bytes of a key and number of keys.
KEY_BYTES, KEYS = 4, 16
#: Entries that a random part of a list holds on average.
PART = 6
#: Classes of shingles by their first 16 bits, counted to put common shingles last.
CLASSES = 1 << 16
#: Bytes of shingle sets that may be broadcast.
SETS_BYTES = 16 << 20
#: Bounds of similarity give way by so much, that rounding loses no pair.
SLACK = 1e-6


def _orders():
    """Multipliers and offsets that put shingle hashes in ``PLACES`` orders."""
    import numpy as np

    rng = np.random.default_rng(42)
    return rng.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)


def signature(shingles, orders):
    """A byte for each order, drawn from the set's least shingle in it.

    Sets of Jaccard similarity s agree at each place with a chance of s + (1 - s) / 256,
    wherever their differences stand in the text.
    """
    import numpy as np

    times, plus = orders
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (np.multiply.outer(times, shingles[at : at + 2048]) + plus[:, None]).min(axis=1), out=least)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).view(np.int8)


def _key(doc_id: Column, text: Column) -> Column:
    """A row's identity where ids may repeat or be null: the text's hash, and the id unless it is null."""
    return F.concat_ws("|", F.md5(F.coalesce(text, F.lit("")).cast("binary")), doc_id.cast("string"))


def _marked_texts(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """_id, _key, digest (of the word sequence), n (distinct shingles) and signature of each document."""
    import hashlib

    import pyarrow as pa

    arrow_bounds(docs.sparkSession)
    source = docs.select(docs[doc_id].alias("_id"), _key(docs[doc_id], docs[text]).alias("_key"), docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        orders = _orders()
        for batch in batches:
            digests, sizes, signatures = [], [], []
            for t in batch.column(2).to_pylist():
                digests.append(hashlib.md5(b" ".join((t or "").encode().translate(_LOWER).split())).digest())
                shingles = np.unique(shingle_hashes(t, width))
                sizes.append(len(shingles))
                signatures.append(signature(shingles, orders))
            columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["_id", "_key", "digest", "n", "signature"])

    return source.mapInArrow(run, source.schema[:2].add("digest", "binary").add("n", "long").add("signature", ArrayType(ByteType())))


def shared_places(a: Column, b: Column) -> Column:
    """The tally: at how many places two signatures hold the same byte."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _places() -> list[list[int]]:
    """The positions of each key: random orders of all places, cut into keys."""
    rnd = random.Random(0)
    orders = [rnd.sample(range(PLACES), PLACES) for _ in range(KEYS * KEY_BYTES // PLACES)]
    return [order[i : i + KEY_BYTES] for order in orders for i in range(0, PLACES, KEY_BYTES)]


def _lists(nodes: DataFrame) -> DataFrame:
    """list, node: ``nodes`` (node, signature) under their keys; lists of one are gone."""
    keys = F.transform(F.lit(_places()), lambda key: F.xxhash64(F.transform(key, lambda i: F.get("signature", i))))
    cells = nodes.select("node", F.posexplode(keys).alias("key", "value")).select(F.xxhash64("key", "value").alias("list"), "node")
    several = cells.groupBy("list").agg(F.count("*").alias("_n")).where("_n > 1").select("list")
    return cells.join(several, "list")


def _mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """``lists`` with root and n: those whose entries are not all in one group yet, with their lengths."""
    rooted = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("list").agg(F.min("root").alias("_r0"), F.max("root").alias("_r1"), F.count("*").alias("n")).where("_r0 < _r1")
    return rooted.join(split, "list").select(*lists.columns, "root", "n")


def _stars(mixed: DataFrame) -> DataFrame:
    """a, b: the smallest node of each list with every other one of another group."""
    heads = mixed.groupBy("list").agg(F.min(F.struct("node", "root")).alias("h"))
    return mixed.join(heads, "list").where("root <> h.root").select(F.col("h.node").alias("a"), F.col("node").alias("b"))


def _parts(mixed: DataFrame) -> DataFrame:
    """a, b: pairs of different groups within random parts of each list: in proportion to its length."""
    part = F.pmod(F.xxhash64("list", "node"), F.ceil(F.col("n") / PART))
    parts = mixed.groupBy("list", part.alias("part")).agg(F.collect_list(F.struct("root", "node")).alias("l")).where(F.size("l") > 1)
    each = parts.select(F.posexplode("l").alias("i", "x"), "l").select("x", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("y")).where("x.root <> y.root")
    return each.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _crossing(mixed: DataFrame) -> DataFrame:
    """a, b: pairs of one list that are in different groups."""
    left, right = (mixed.select("list", F.col("node").alias(name), F.col("root").alias(f"r{name}")) for name in "ab")
    return left.join(right, "list").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))).select("a", "b")


def _tallied(pairs: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """The distinct pairs that share enough positional bytes and are near enough in size."""
    left, right = (heads.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("signature").alias(f"s{name}")) for name in "ab")
    both = pairs.distinct().join(left, "a").join(right, "b").where(F.least("na", "nb") >= least * F.greatest("na", "nb"))
    return both.where(shared_places(F.col("sa"), F.col("sb")) >= LEAST_SHARED).select("a", "b")


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """node and the distinct shingle hashes of each text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", "_text").mapInArrow(run, "node long, shingles array<long>")


def _texts_of(nodes: DataFrame, heads: DataFrame, keyed: DataFrame, width: int, label: str) -> DataFrame:
    """``_shingle_sets`` of the distinct ``nodes``, stored."""
    wanted = stored(nodes.distinct().join(heads, "node").select("node", F.col("head._key").alias("_key")), f"{label}-wanted")
    return stored(_shingle_sets(keyed.join(bounded(wanted), "_key"), width).dropDuplicates(["node"]), label)


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose shingle sets (stored) have a Jaccard similarity of at least ``least``, stored."""
    held = sets.agg(F.coalesce(F.sum(F.size("shingles") + 4), F.lit(0))).first()[0] * 8  # summed where it lies: sets are too large for one task
    sets = F.broadcast(sets) if held <= SETS_BYTES else sets
    left, right = (sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s{name}")) for name in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return stored(both.where(F.col("n") >= least * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b"), "near-edges")


def _class_counts(sets: DataFrame):
    """How often shingles of each class occur, as far as tasks see them more than once: at most ``CLASSES`` sums."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            shingles = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            own += np.bincount((shingles >> np.uint64(48)).astype(np.int64), minlength=CLASSES)
        several = np.nonzero(own > 1)[0]
        yield pa.RecordBatch.from_arrays([pa.array(several), pa.array(own[several])], names=["class", "n"])

    out = np.zeros(CLASSES, dtype=np.int64)
    for row in sets.select("shingles").mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[row["class"]] = row["n"]
    return out


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """list, node, at, size: the first shingles of each set, rare ones first, with their places.

    Sets of a similarity of at least ``least`` share one of them, whatever the order, so the
    counts that make it need not be exact.
    """
    import pyarrow as pa

    shared = sets.sparkSession.sparkContext.broadcast(_class_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            lists, nodes, places, sizes = [], [], [], []
            for node, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = own.values.to_numpy(zero_copy_only=False)
                classes = own.view(np.uint64) >> np.uint64(48)
                n = len(own) - int(np.ceil(least * len(own) - SLACK)) + 1
                lists.append(own[np.lexsort((own, shared.value[classes.astype(np.int64)]))[:n]])
                nodes.append(np.full(n, node))
                places.append(np.arange(n))
                sizes.append(np.full(n, len(own)))
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in (lists, nodes, places, sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "node", "at", "size"])

    return sets.mapInArrow(run, "list long, node long, at long, size long")


def _within_reach(x: str, y: str, least: float) -> Column:
    """Whether two sets can be alike whose first common shingle is this one: from here on the shorter rest must do."""
    rest = F.least(*(F.col(f"{z}.size") - F.col(f"{z}.at") for z in (x, y)))
    return rest >= least / (1 + least) * (F.col(f"{x}.size") + F.col(f"{y}.size")) - SLACK


def _prefix_stars(mixed: DataFrame, least: float) -> DataFrame:
    """a, b: one entry of each list of prefixes, drawn by hash, with those of other groups within its reach."""
    entry = F.struct("node", "root", "at", "size")
    heads = mixed.groupBy("list").agg(F.min_by(entry, F.xxhash64("list", "node")).alias("h"))
    both = mixed.select("list", entry.alias("x")).join(heads, "list").where("x.root <> h.root").where(_within_reach("x", "h", least))
    return both.select(F.least("x.node", "h.node").alias("a"), F.greatest("x.node", "h.node").alias("b"))


def _prefix_crossing(mixed: DataFrame, least: float) -> DataFrame:
    """a, b: all pairs of one list of prefixes that are in different groups and within reach."""
    left, right = (mixed.select("list", F.struct("node", "root", "at", "size").alias(name)) for name in "xy")
    both = left.join(right, "list").where("x.node < y.node and x.root <> y.root").where(_within_reach("x", "y", least))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def near_groups(docs: DataFrame, doc_id: str, text: str, width: int = 5, least: float = 0.8) -> DataFrame:
    """_id, _key, root: documents with equal ``root`` are exact or near copies, linked directly or in a chain.

    The index of positional bytes with count filtering, over signatures that follow the
    Jaccard similarity of the texts' shingle sets: at 0.8 the bits of a SimHash differ too much
    for any guaranteed minimum. Candidates of one list must share ``LEAST_SHARED`` of
    ``PLACES`` bytes, and are then compared exactly.

    Entries of a list are compared with its smallest one, then within random parts, which
    is in proportion to its length and joins most copies. Of lists that are not one group
    then, short ones give all pairs between groups. Entries of long ones are indexed anew
    by prefixes: their shingles from rare to common, of which alike texts share one
    among the first fifth. Of each such list one entry meets the others, and then all pairs of
    different groups whose places leave room for ``least`` are compared. That is exact: no
    list is capped, and no pair that shares a list is lost there. Of pairs at 0.8 about one in
    five hundred shares no list or too few bytes. Exact copies are collapsed before.
    """
    spark = docs.sparkSession
    marked = stored(_marked_texts(docs, doc_id, text, width), "near-marks")
    heads = marked.groupBy("digest").agg(F.any_value("n").alias("n"), F.any_value("signature").alias("signature"), F.min_by(F.struct("_id", "_key"), F.struct(F.col("_id").isNull(), "_id", "_key")).alias("head"))
    heads = stored(heads.withColumn("node", F.monotonically_increasing_id()), "near-heads")
    keyed = docs.select(_key(docs[doc_id], docs[text]).alias("_key"), docs[text].alias("_text"))

    def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
        return stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges)), "near-roots")

    def tallied(pairs: DataFrame) -> DataFrame:
        pairs = stored(_tallied(pairs, heads, least), "near-pairs")
        return _alike(pairs, _texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), heads, keyed, width, "near-shingles"), least)

    lists = stored(_lists(heads.where("n > 0").select("node", "signature")), "near-lists")
    roots = joined(spark.createDataFrame([], "node long, root long"), tallied(_stars(lists.withColumn("root", F.col("node")))))
    roots = joined(roots, tallied(_parts(_mixed(lists, roots))))
    mixed = stored(_mixed(lists, roots), "near-mixed")
    crowded = mixed.where(F.col("n") > LIST_LENGTH).select("node")
    if crowded.isEmpty():
        roots = joined(roots, tallied(_crossing(mixed)))
    else:
        sets = _texts_of(crowded, heads, keyed, width, "near-crowded")
        prefixes = stored(_prefixes(sets, least), "near-prefixes")
        short = _crossing(mixed.where(F.col("n") <= LIST_LENGTH))
        roots = joined(roots, tallied(short.union(_prefix_stars(_mixed(prefixes, roots), least))))
        pairs = stored(_prefix_crossing(stored(_mixed(prefixes, roots), "near-left"), least).distinct(), "near-crossing")
        roots = joined(roots, _alike(pairs, sets, least))
    named = heads.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return marked.select("_id", "_key", "digest").join(named, "digest").select("_id", "_key", "root")


def near_deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of copies: that with the smallest id."""
    groups = stored(near_groups(docs, doc_id, text, width, least), "near-groups")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id"), F.col("_key"))
    kept = stored(groups.groupBy("root").agg(F.min(order).alias("k")).select("k._key"), "near-kept")
    rows = packed(docs, _id=doc_id, _text=text).select("_row", _key(F.col("_id"), F.col("_text")).alias("_key"))
    return unpacked(rows.join(bounded(kept), "_key").dropDuplicates(["_key"]), docs.columns)
