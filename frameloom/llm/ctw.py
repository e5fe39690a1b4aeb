"""Context-tree weighting over bytes: mixed Krichevsky-Trofimov estimates of all depths.

A byte is eight binary decisions. Decision node u (the bits already known, after a
leading one) has a context tree over the ``DEPTH`` bytes before, nearest first. A
context s of depth d with n0 zeros and n1 ones estimates by KT, and is weighted

    Pw(s) = 1/2 Pe(s) + 1/2 prod over one-byte-longer contexts of Pw,   Pw = Pe at DEPTH,

so every depth takes part with a weight learned from the corpus. KT block
probabilities depend on counts alone, so the tree is built from counts of
(DEPTH + 1)-grams of the whole training part. A text costs, byte by byte, the
sequentially mixed probability along its context path; an end byte closes each text.

At scale. Texts are read in blocks (a file split, cut finer by hash until a block holds
about ``BLOCK_BYTES`` of text). A first pass counts words and grams per block with
a bounded table that is flushed when full. Counts are summed over blocks by a window;
a word that one block alone holds is not sent back. The context tree is worked per
two nearest bytes: below them are at most 2**24 grams whatever the corpus, which bounds a
task; above them are at most 256 * 255 nodes, which the driver weighs. Sums and gram
scores return to their blocks, where texts meet them once.

Defined cases: null and empty texts are one end; a document whose id is null trains;
with nothing to train on every bit costs 1; repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.llm.common import arrow_bounds, stored

DEPTH = 4
BLOCK_BYTES = 16 << 20
#: Entries of a task's counting tables before they are flushed.
TABLE_ENTRIES = 2_000_000
CHUNK_BYTES = 2 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lgamma(x):
    """log gamma of an array of positive numbers: Stirling's series after a shift by 8."""
    import numpy as np

    x = np.asarray(x, dtype=np.float64)
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def log_kt(n0, n1):
    """Natural log of the KT probability of any one sequence with these counts."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - math.log(math.pi) - lgamma(n0 + n1 + 1.0)


def grams(texts: list[bytes]):
    """(DEPTH + 1)-grams of every byte and the end of each text, and how many each text has."""
    import numpy as np

    pad = b"\0" * DEPTH
    a = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), dtype=np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    key = np.zeros(len(a) - DEPTH, dtype=np.int64)
    for i in range(DEPTH + 1):
        key = key << 8 | a[i : len(a) - DEPTH + i]
    starts = np.concatenate(([0], np.cumsum(lengths + DEPTH)[:-1]))
    own = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    return key[own], lengths


def _chunks(texts: list[bytes]) -> Iterator[list[int]]:
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lowered(text: str | None) -> bytes:
    return (text or "").encode().translate(_LOWER)


def blocked(docs: DataFrame, doc_id: str, text: str, train: Column) -> DataFrame:
    """doc_id, text, train and ``block`` of each document of a file scan."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), train.alias("train"), F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start"))
    size = rows.groupBy("_file", "_start").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-size // BLOCK_BYTES))
    return rows.withColumn("block", F.xxhash64("_file", "_start", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))).drop("_file", "_start")


def block_counts(rows: DataFrame) -> DataFrame:
    """block, word (null for grams), gram (null for words), n in training documents (may be 0)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        words: dict[int, Counter] = {}
        seen: dict[int, list] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, table in words.items():
                n = len(table)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(list(table), pa.binary()), pa.nulls(n, pa.int64()), pa.array(list(table.values()), pa.int64())], names=["block", "word", "gram", "n"])
            for block, parts in seen.items():
                key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.nulls(len(key), pa.binary()), pa.array(key), pa.array(n)], names=["block", "word", "gram", "n"])
            words.clear()
            seen.clear()

        for batch in batches:
            texts = [_lowered(t) for t in batch.column(0).to_pylist()]
            train = batch.column(1).to_pylist()
            blocks = batch.column(2).to_pylist()
            groups: dict[tuple[int, bool], list[int]] = {}
            for i, pair in enumerate(zip(blocks, train, strict=True)):
                groups.setdefault(pair, []).append(i)
            for (block, learns), members in groups.items():
                table = words.setdefault(block, Counter())
                before = len(table)
                if learns:
                    for i in members:
                        table.update(texts[i].split())
                else:
                    for i in members:
                        for w in set(texts[i].split()):
                            table.setdefault(w, 0)
                held += len(table) - before
                own = [texts[i] for i in members]
                for part in _chunks(own):
                    key, n = np.unique(grams([own[i] for i in part])[0], return_counts=True)
                    parts = seen.setdefault(block, [])
                    parts.append((key, n if learns else np.zeros_like(n)))
                    if len(parts) > 15:
                        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                        seen[block] = [(key, np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64))]
            if held > TABLE_ENTRIES or sum(len(k) for parts in seen.values() for k, _ in parts) > 2 * TABLE_ENTRIES:
                yield from flush()
                held = 0
        yield from flush()

    arrow_bounds(rows.sparkSession)
    return rows.select("text", "train", "block").mapInArrow(run, "block long, word binary, gram long, n long")


def _nodes(ctx, u, n0, n1, below):
    """Sum binary nodes by (ctx, u): unique keys, position of each row, counts, log of the product below."""
    import numpy as np

    key, at = np.unique(ctx << 8 | u, return_inverse=True)
    return key, at, np.bincount(at, weights=n0), np.bincount(at, weights=n1), np.bincount(at, weights=below)


def _subtree(gram, n):
    """Weigh the levels DEPTH to 2 of the grams of one pair of nearest bytes.

    Returns what each (gram, bit) predicts from level 2 down, and level 2's nodes.
    """
    import numpy as np

    bits = np.repeat(np.arange(8), len(gram))
    byte, ctx = np.tile(gram & 255, 8), np.tile(gram >> 8, 8)
    n = np.tile(n.astype(np.float64), 8)
    u, bit = (1 << bits) | (byte >> (8 - bits)), (byte >> (7 - bits)) & 1
    level, now, chosen = [], ctx, None
    c0, c1, below, nodes_u, nodes_ctx = n * (bit == 0), n * (bit == 1), np.zeros(len(n)), u, now
    pick = np.arange(len(n))
    for depth in range(DEPTH, 1, -1):
        nodes_ctx = nodes_ctx & ((1 << 8 * depth) - 1)
        key, at, c0, c1, below = _nodes(nodes_ctx, nodes_u, c0, c1, below)
        pick = at[pick]
        pe = log_kt(c0, c1)
        pw = pe if depth == DEPTH else np.logaddexp(pe, below) - math.log(2)
        rho = np.ones(len(key)) if depth == DEPTH else np.exp(pe - math.log(2) - pw)
        level.append((pick, rho, (c1 + 0.5) / (c0 + c1 + 1)))
        nodes_ctx, nodes_u, below = key >> 8, key & 255, pw
    for pick, rho, one in level:
        p = np.where(bit == 1, one[pick], 1 - one[pick])
        chosen = p if chosen is None else rho[pick] * p + (1 - rho[pick]) * chosen
    return u, bit, chosen, (nodes_ctx, nodes_u, c0, c1, below)


def gram_scores(counts: DataFrame) -> DataFrame:
    """gram, score: log10 probability of each gram's last byte after its others. ``counts``: gram, n (stored)."""
    import pyarrow as pa

    near = counts.select("gram", "n", F.shiftright("gram", 8).bitwiseAND(65535).alias("near"))

    def weigh(t: pa.Table) -> pa.Table:
        _, _, _, (ctx, u, n0, n1, pw) = _subtree(t["gram"].to_numpy(), t["n"].to_numpy())
        return pa.table({"ctx": ctx & 255, "u": u, "n0": n0, "n1": n1, "pw": pw})

    top = near.groupBy("near").applyInArrow(weigh, "ctx long, u long, n0 double, n1 double, pw double")
    top = top.groupBy("ctx", "u").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("pw"))
    upper = _upper(top.toPandas())  # at most 256 contexts of 255 nodes

    def score(t: pa.Table) -> pa.Table:
        import numpy as np

        gram = t["gram"].to_numpy()
        u, bit, p, _ = _subtree(gram, t["n"].to_numpy())
        rho1, one1, rho0, one0 = upper
        ctx = np.tile(gram >> 8 & 255, 8)
        for rho, one in ((rho1[ctx, u], one1[ctx, u]), (rho0[u], one0[u])):
            p = rho * np.where(bit == 1, one, 1 - one) + (1 - rho) * p
        return pa.table({"gram": gram, "score": np.log10(p).reshape(8, -1).sum(axis=0)})

    return near.groupBy("near").applyInArrow(score, "gram long, score double")


def _upper(top):
    """Weights and estimates of levels 1 and 0 from level 1's sums."""
    import numpy as np

    top = top.sort_values(["ctx", "u"])
    n0, n1, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    at = top["ctx"].to_numpy(dtype=np.int64), top["u"].to_numpy(dtype=np.int64)
    n0[at], n1[at], below[at] = top["n0"], top["n1"], top["pw"]
    pe = log_kt(n0, n1)
    pw = np.logaddexp(pe, below) - math.log(2)
    r0, r1 = n0.sum(axis=0), n1.sum(axis=0)
    rpe = log_kt(r0, r1)
    rpw = np.logaddexp(rpe, pw.sum(axis=0)) - math.log(2)
    return np.exp(pe - math.log(2) - pw), (n1 + 0.5) / (n0 + n1 + 1), np.exp(rpe - math.log(2) - rpw), (r1 + 0.5) / (r0 + r1 + 1)


def scored(docs: DataFrame, doc_id: str, text: str, train: Column, direct: bool = False) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, code_bits (per byte).

    ``direct``: docs is a plain scan of files; anything else is stored first, so that
    both passes see the same splits.
    """
    import pyarrow as pa

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), train.alias("_train"))
    rows = blocked(rows if direct else stored(rows, "ctw-docs"), "doc_id", "text", F.col("_train"))
    counts = stored(block_counts(rows), "ctw-counts")
    w = Window.partitionBy("word")
    words = counts.where("word IS NOT NULL").select("block", "word", F.sum("n").over(w).alias("c"), (F.min("block").over(w) == F.col("block")).alias("first"), (F.min("block").over(w) != F.max("block").over(w)).alias("shared"), F.col("n"))
    words = stored(words, "ctw-words")
    summed = stored(counts.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")), "ctw-grams")
    scores = stored(gram_scores(summed), "ctw-scores")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    distinct = words.where("c > 0 AND first").select("word").distinct().count()
    ends = rows.where("train").count()
    big_n, big_v = total + ends, distinct + (1 if ends else 0)

    back = words.where("shared").select("block", "word", F.lit(None).cast("long").alias("gram"), F.col("c").cast("double").alias("value"))
    back = back.unionByName(counts.where("gram IS NOT NULL").select("block", "gram").join(scores, "gram").select("block", F.lit(None).cast("binary").alias("word"), "gram", F.col("score").alias("value")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        texts = [_lowered(t) for t in left["text"].to_pylist()]
        learns = left["train"].to_pylist()
        known = right.filter(right["word"].is_valid())
        logs = dict(zip(known["word"].to_pylist(), np.log10(known["value"].to_numpy() + 1).tolist(), strict=True))
        local: Counter = Counter()
        for t, yes in zip(texts, learns, strict=True):
            if yes:
                local.update(t.split())
        for w, n in local.items():
            if w not in logs:
                logs[w] = math.log10(n + 1)
        table = right.filter(right["gram"].is_valid())
        key, value = table["gram"].to_numpy(), table["value"].to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        per_token, end = math.log10(big_n + big_v + 1), math.log10(ends + 1)
        n_tokens, n_known, base, look = [], [], [], logs.get
        for t in texts:
            parts = [look(x, 0.0) for x in t.split()]
            n_tokens.append(len(parts) + 1)
            n_known.append(len(parts) - parts.count(0.0) + (ends > 0))
            base.append(math.fsum(parts) + end - (len(parts) + 1) * per_token)
        score = np.zeros(len(texts))
        for part in _chunks(texts):
            g, lengths = grams([texts[i] for i in part])
            u, at = np.unique(g, return_inverse=True)
            each = value[np.searchsorted(key, u)][at]
            score[part] = np.add.reduceat(each, np.cumsum(lengths) - lengths)
        sizes = np.array([len(t) + 1 for t in texts])
        return pa.table({"doc_id": left["doc_id"], "train": left["train"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([big_n] * len(texts), pa.int64()), "base_score": base, "score": score, "code_bits": -score / math.log10(2) / sizes})

    schema = rows.select("doc_id", "train").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("code_bits", "double")):
        schema = schema.add(name, kind)
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)
