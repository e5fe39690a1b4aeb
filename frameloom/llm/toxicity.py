"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word is the bag of its character n-grams (with ends marked) and itself, each hashed
to one of ``BUCKETS`` vectors; misspellings never seen share most n-grams with
the words they come from. A window of ``WINDOW`` words is the average of its words,
which are averages of their subwords; a linear softmax over two labels scores the
average, and a text scores as its worst window, so a few words are not washed out in a
long text. Vectors and softmax are trained together by full-batch Adam in numpy. With two labels
only the difference of the two softmax rows matters, so each subword acts through
one number, its vector times that difference; passes over the corpus use these numbers.

Learning takes at most ``SAMPLE_ROWS`` labelled documents and ``SAMPLE_BYTES`` of text, those with the smallest hash
of their id: a documented bound on what reaches the driver. Scoring is one narrow
pass over all texts with 2**16 numbers a task and a bounded memo of words.

Defined cases: null and empty texts score as an empty average (the bias alone); with
one label only, or none, every score is the share of label 1 (0.5 with none); repeated rows
are scored alike; an id that is labelled twice counts as toxic if either label is; kept columns
called score go on as score_in; texts of any length are scored whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.llm.common import arrow_bounds, kept_names

SAMPLE_ROWS = 4000
#: Bytes of text that the fitting sample holds at most; one text at most a sixteenth of it.
SAMPLE_BYTES = 64 << 20
BUCKETS = 1 << 16
DIMENSIONS = 8
NGRAMS = (3, 4, 5)
WINDOW = 4
STEP = 2
SCALE = 4.0
#: Pull towards zero on each subword's number, in documents.
DECAY = 0.03
MEMO = 400_000
_EDGES = "\"'()[]{}<>.,;:!?#*$%&|-_=+"


def subwords(word: str) -> list[int]:
    """Buckets of a word and its character n-grams."""
    plain = word.lower().strip(_EDGES) or word
    data = f"<{plain}>".encode("utf-16-le", "replace")
    out = [crc32(data) % BUCKETS]
    for n in NGRAMS:
        out += [crc32(data[i : i + 2 * n]) % BUCKETS for i in range(0, len(data) - 2 * n + 1, 2)]
    return out


def window_starts(n: int) -> range:
    """First words of the windows of a text of n words; the last window may be short."""
    return range(0, max(1, n - STEP), STEP)


@dataclass
class Model:
    """One number for each subword, and the bias, of label 1 against label 0."""

    weights: list[float]
    bias: float

    def word(self, word: str) -> float:
        at = subwords(word)
        w = self.weights
        return sum([w[i] for i in at]) / len(at)


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(texts: list[str | None], labels: list[int], epochs: int = 120, seed: int = 7, decay: float = DECAY) -> Model:
    """Joint training of vectors and softmax on whole texts."""
    import numpy as np

    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model([0.0] * BUCKETS, float(np.log(share / (1 - share))))
    ids: dict[str, int] = {}
    packed, bounds = array("i"), [0]
    for t in texts:
        packed.extend([ids.setdefault(w, len(ids)) for w in (t or "").split()])
        bounds.append(len(packed))
    packed.append(0)
    bags, ends = array("i"), array("q")
    for w in ids or [""]:
        bags.extend(subwords(w))
        ends.append(len(bags))
    tokens, sub, ends = np.frombuffer(packed, np.int32), np.frombuffer(bags, np.int32), np.frombuffer(ends, np.int64)
    n_words = len(ends)
    sizes = np.diff(ends, prepend=0)
    sub_start = ends - sizes
    of_word = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
    ids.clear()
    counts = np.diff(bounds)
    each = np.array([len(window_starts(n)) for n in counts])
    doc = np.repeat(np.arange(len(y), dtype=np.int32), each)
    doc_start = np.cumsum(each) - each
    begin = np.array(bounds[:-1])[doc]
    first = (begin + (np.arange(len(doc)) - doc_start[doc]) * STEP).astype(np.int32)
    last = np.minimum(first + WINDOW, begin + counts[doc]).astype(np.int32)
    width = np.maximum(last - first, 1).astype(np.float32)
    del begin

    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    softmax = rng.normal(0, 0.5, (2, DIMENSIONS))
    bias = float(np.log(y.mean() / (1 - y.mean()))) - 1.0
    importance = np.where(y == 1, (len(y) / y.sum() - 1) ** 0.5, 1.0)
    state = [np.zeros_like(vectors), np.zeros_like(vectors), np.zeros_like(softmax), np.zeros_like(softmax), 0.0, 0.0]
    for epoch in range(1, epochs + 1):
        turn = softmax[1] - softmax[0]
        s = vectors @ turn
        u = np.add.reduceat(s[sub], sub_start) / sizes
        total = np.concatenate(([0.0], np.cumsum(u[tokens])))
        z = (bias + SCALE * (total[last] - total[first]) / width).astype(np.float32)
        top = np.maximum.reduceat(z, doc_start)
        # soft choice of the worst window, hardening as training goes on
        heat = min(1.0 + epoch / 10, 8.0)
        share = np.exp(np.clip(heat * (z - top[doc]), -60, 0))
        share /= np.add.reduceat(share, doc_start)[doc]
        pooled = np.add.reduceat(share * z, doc_start)
        g = (_sigmoid(pooled) - y) * importance / len(y)
        g_window = g[doc] * share
        g_bias = g_window.sum()
        push = SCALE * g_window / width
        del z, share
        diff = np.bincount(first, push, len(tokens) + 1) - np.bincount(last, push, len(tokens) + 1)
        g_word = np.bincount(tokens[:-1], np.cumsum(diff)[: len(tokens) - 1], n_words)
        g_s = np.bincount(sub, (g_word / sizes)[of_word], BUCKETS) + decay / len(y) * s
        g_vectors = g_s[:, None] * turn
        g_turn = g_s @ vectors
        g_softmax = np.stack([-g_turn, g_turn])
        rate = 0.05 * min(1.0, 2.0 * (1 - epoch / (epochs + 1)))
        for value, grad, k in ((vectors, g_vectors, 0), (softmax, g_softmax, 2)):
            state[k] = 0.9 * state[k] + 0.1 * grad
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * grad**2
            value -= rate * (state[k] / (1 - 0.9**epoch)) / (np.sqrt(state[k + 1] / (1 - 0.99**epoch)) + 1e-8)
        state[4], state[5] = 0.9 * state[4] + 0.1 * g_bias, 0.99 * state[5] + 0.01 * g_bias**2
        bias -= rate * (state[4] / (1 - 0.9**epoch)) / ((state[5] / (1 - 0.99**epoch)) ** 0.5 + 1e-8)
    return Model((vectors @ (softmax[1] - softmax[0])).tolist(), float(bias))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, learn: Column, most: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """_lid, text and _label of at most ``most`` labelled documents that ``learn`` allows, by smallest hash of the id, and of at most ``size`` bytes.

    Ids are chosen from the labels alone; then their texts' lengths are read, and only texts that fit into
    what is left of ``size`` when their turn comes. Of documents that share an id the text of smallest hash counts.
    """
    ids = labels.where(labels[label].isin(0, 1) & learn).select(labels[doc_id].alias("_lid"), labels[label].cast("int").alias("_label"))
    chosen = F.broadcast(ids.groupBy("_lid").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_lid"), "_lid").limit(most))
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.join(chosen, docs[doc_id] == F.col("_lid")).select("_lid", "_label", F.xxhash64(body).alias("_h"), F.octet_length(body).alias("_n"), docs[text].alias("text"))
    one = rows.groupBy("_lid", "_label").agg(F.min(F.struct("_h", "_n")).alias("_x")).select("_lid", "_label", "_x.*")
    turn = F.sum("_n").over(Window.orderBy(F.xxhash64("_lid"), "_lid"))  # of at most ``most`` rows
    fits = F.broadcast(one.where(F.col("_n") <= size // 16).withColumn("_sum", turn).where(F.col("_sum") <= size).select(F.col("_lid").alias("_fid"), F.col("_h").alias("_fh")))
    return rows.join(fits, (F.col("_lid") == F.col("_fid")) & (F.col("_h") == F.col("_fh"))).groupBy("_lid", "_label").agg(F.any_value("text").alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, learn: Column, most: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    rows = labelled_sample(docs, labels, doc_id, text, label, learn, most, size).orderBy("_lid").collect()
    return train([r["text"] for r in rows], [r["_label"] for r in rows])


_MEMOS: dict[int, dict[str, float]] = {}


def scored(docs: DataFrame, text: str, keep: list[str], model: Model) -> DataFrame:
    """Columns ``keep`` with score: the probability of label 1 of the worst window. One narrow pass."""
    import pyarrow as pa

    arrow_bounds(docs.sparkSession)
    kept = kept_names(keep, ["score", "_text"])
    source = docs.select(*(docs[c].alias(n) for c, n in zip(keep, kept, strict=True)), docs[text].alias("_text"))
    weights, bias = model.weights, model.bias
    key = crc32(repr((weights, bias)).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = Model(weights, bias)
        if key not in _MEMOS:
            _MEMOS.clear()
            _MEMOS[key] = {}
        memo = _MEMOS[key]
        for batch in batches:
            out = []
            for t in batch.column(len(keep)).to_pylist():
                parts = (t or "").split()
                if len(memo) > MEMO:
                    memo.clear()
                for w in parts:
                    if w not in memo:
                        memo[w] = own.word(w)
                n = len(parts)
                total = np.zeros(n + 1)
                np.cumsum(np.fromiter(map(memo.__getitem__, parts), dtype=np.float64, count=n), out=total[1:])
                first = np.array(window_starts(n))
                last = np.minimum(first + WINDOW, n)
                out.append((bias + SCALE * (total[last] - total[first]) / np.maximum(last - first, 1)).max())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(_sigmoid(np.array(out, dtype=np.float64)))], names=[*kept, "score"])

    return source.mapInArrow(run, source.schema[:-1].add("score", "double"))
