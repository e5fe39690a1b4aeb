"""Many lines, many items of one window, many documents of one id: time and memory follow the input."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from frameloom.llm import decontaminate, linededup, toxicity


def test_many_lines_in_equal_texts(docs):
    text = "\n".join(f"line number {i} of a text that others hold too" if i % 3 else f"w{i}x y{i}" for i in range(60_000))
    began = time.time()
    out = {r.doc_id: r for r in linededup.deduped(docs([text, text, text + "\nown line stays here", None])).collect()}
    assert out[0].text == text and out[1].text == "" and out[2].text == "own line stays here" and out[3].text is None
    assert out[2].n_dropped == 60_000 and time.time() - began < 60


def test_the_bound_of_long_lines_is_a_parameter(docs):
    line = " ".join("abcdefghij")
    two = docs([line, line + "\nrest"])
    assert [r.n_dropped for r in linededup.deduped(two).orderBy("doc_id").collect()] == [0, 0]
    assert [r.n_dropped for r in linededup.deduped(two, long_tokens=10).orderBy("doc_id").collect()] == [0, 1]


def test_many_items_of_one_window(docs, spark):
    window = "one window of ten words that twenty thousand items share"
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit(window).alias("text"))
    texts = [f"{window} and " * 1800, "la " * 22_000, window.upper(), "no such words"]
    out = {r.doc_id: r for r in decontaminate.marked(docs(texts), items).collect()}
    assert len(out[0].hits) == 1800 and len(out[0].hit_items) == 20_000 and out[2].hit_items == out[0].hit_items
    assert out[1].hits == [] and out[3].hit_items == [] and out[1].n_words == 22_000
    assert sorted(r.doc_id for r in decontaminate.clean(docs(texts), items).collect()) == [1, 3]


def test_repeated_rows_and_ids_keep_their_own_matches(docs, spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "k l m n o p q r s t")], "item_id long, text string")
    texts = ["a b c d e f g h i j"] * 3 + ["k l m n o p q r s t", "nothing", None]
    rows = decontaminate.marked(docs(texts, [7, 7, None, 7, None, None]), items).collect()
    assert sorted((r.doc_id or 0, tuple(r.hit_items)) for r in rows) == [(0, ()), (0, ()), (0, ("1",)), (7, ("1",)), (7, ("1",)), (7, ("2",))]


def test_the_sample_holds_a_row_an_id_and_so_many_bytes(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    texts = [f"text {i}" for i in range(5000)] + ["x" * 5000, "fine", None]
    data = docs(texts, [i % 3 for i in range(5000)] + [3, 4, 5])
    take = lambda **k: toxicity.labelled_sample(data, labels, "doc_id", "text", "toxic", F.lit(True), **k).collect()
    assert sorted(r._lid for r in take()) == list(range(6))
    assert sorted(r._lid for r in take(size=16 * 100)) == [0, 1, 2, 4, 5]
    assert sum(len(r.text or "") for r in take(size=320)) <= 320 and len(take(most=2)) == 2
