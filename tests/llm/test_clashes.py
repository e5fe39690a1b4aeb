"""No operator or stage loses or overwrites a column of its input, and none fails on one."""

from __future__ import annotations

import pytest

import corpus_pipeline
from frameloom.llm import bpe, decontaminate, linededup, pii, quality, toxicity, urls

NAMES = ["n_words", "n_dropped", "n_lines", "hits", "hit_items", "n_tokens", "token_ids", "host", "length", "score", "verdict", "_row", "_text", "_h", "_key", "kept", "spans", "path", "rule"]
RANKS = {bytes([i]): i for i in range(256)}


def words(i: int) -> str:
    return " ".join(f"{'abc'[i]}{c} {c}and some{'abc'[i]} more" for c in "defghijklmno")


@pytest.fixture
def clashing(spark):
    """Documents with a column for every name that an operator gives, each holding its name and row."""

    def make(texts):
        rows = [(i, t, "en", "s", len(t or ""), *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))

    return make


def whole(rows, names):
    return all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


@pytest.mark.parametrize("at", range(5))
def test_stages_keep_all_columns(clashing, spark, tmp_path, at):
    spark.createDataFrame([(1, "a window of ten words that no document holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing([words(0), words(1), words(2), None, ""])
    out = corpus_pipeline.STAGES[at][1](spark, docs, str(tmp_path))
    rows = [r.asDict() for r in out.collect()]
    ids = {r["doc_id"] for r in rows}
    assert ids >= {0, 1, 2}
    if at < 4:
        assert out.columns == docs.columns and whole(rows, NAMES)
        assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] < 3} == {i: words(i) for i in range(3)}
    else:
        assert whole(rows, set(NAMES) - {"n_tokens", "token_ids", "_text"})
        assert all(r["n_tokens_in"] == f"n_tokens{r['doc_id']}" and isinstance(r["n_tokens"], int) for r in rows)


@pytest.mark.parametrize("at", range(4))
def test_stages_take_empty_tables(clashing, spark, tmp_path, at):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(["x"]).limit(0)
    out = corpus_pipeline.STAGES[at][1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() == 0


def test_operators_keep_clashing_columns_under_another_name(clashing, spark):
    docs = clashing([words(0), None])
    none = spark.createDataFrame([], "item_id long, text string")
    model = toxicity.Model([0.0] * toxicity.BUCKETS, 0.0)
    outs = {
        "n_dropped": linededup.deduped(docs),
        "hits": decontaminate.marked(docs, none),
        "n_words": quality.judged(docs),
        "spans": pii.found(docs, "text"),
        "score": toxicity.scored(docs, "text", docs.columns, model),
        "n_tokens": bpe.encoded(docs, "text", docs.columns, RANKS, r"\S+|\s+"),
        "host": urls.judged(docs, "text", docs.columns, []),
        "verdict": urls.judged(docs, "text", docs.columns, []),
    }
    for name, out in outs.items():
        rows = [r.asDict() for r in out.collect()]
        assert len(rows) == 2 and {r[name + "_in"] for r in rows} == {f"{name}0", f"{name}1"}
        assert all(r[name] != f"{name}{r['doc_id']}" for r in rows)


def test_repeated_words_and_many_items_of_one_window(docs, spark):
    bench = spark.createDataFrame([(1, "la " * 400), (2, "la " * 30), (None, "x y"), (3, "ha la " * 20)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.marked(docs(["la " * 60_000, "la " * 9, "ha la " * 5, "y x y x"]), bench).collect()}
    assert len(out[0].hits) == 59_991 and out[0].hit_items == ["1", "2"]
    assert out[1].hits == [] and out[2].hit_items == ["3"]
    assert [tuple(h) for h in out[3].hits] == [(1, 2)] and out[3].hit_items == []


def test_a_long_line_of_two_documents_recurs(docs):
    long, short = ("abcdefghijklmnopqrstuvwxy"[:k] * 2 for k in (25, 24))
    long, short = " ".join("l" + c for c in long), " ".join("s" + c for c in short)
    out = {r.doc_id: r.text for r in linededup.deduped(docs([f"{long}\na", f"b\n{long}", f"{short}\nc", f"{short}\nd"])).collect()}
    assert out == {0: f"{long}\na", 1: "b", 2: f"{short}\nc", 3: f"{short}\nd"}


def test_many_spans_in_one_text(docs):
    text = " ".join(f"u{i}@host{i}.example" for i in range(100_000))
    (row,) = pii.found(docs([text]), "text").collect()
    assert len(row.spans) == 100_000 and all(text[s.start : s.end] == s.text for s in row.spans[::997])
