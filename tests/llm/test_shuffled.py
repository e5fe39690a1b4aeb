"""The ways taken where a side is too large to broadcast give the same rows."""

from __future__ import annotations

import pytest

from frameloom.llm import common, decontaminate, linededup, quality, simhash

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(map(str, r)) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", ["lines", "items", "fences", "copies"])
def test_same_rows_without_broadcast(spark, monkeypatch, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    run = {
        "lines": lambda: rows(linededup.deduped(docs), "doc_id", "text", "n_dropped"),
        "items": lambda: rows(decontaminate.marked(docs, spark.read.parquet(f"{SF}/benchmark.parquet")), "doc_id", "hits", "hit_items"),
        "fences": lambda: rows(quality.judged(docs), "doc_id", "kept"),
        "copies": lambda: rows(simhash.near_deduped(docs), "doc_id"),
    }[name]
    before = run()
    for module in (common, decontaminate, linededup, quality):
        if hasattr(module, "bounded"):
            monkeypatch.setattr(module, "bounded", lambda side, most=0: side)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
