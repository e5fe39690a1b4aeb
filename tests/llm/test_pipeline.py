from __future__ import annotations

from glob import glob

import pytest

import corpus_pipeline
from frameloom.llm import queries
from frameloom.llm.common import scratch_root

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_narrow_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= before
        assert docs.columns[: len(COLUMNS)] == COLUMNS
        assert name == "tokens" or docs.columns == COLUMNS
        before = set(now)
    assert len(before) > 100
    assert docs.where("decoded_sha256 <> sha2(text, 256)").count() == 0


def test_run_leaves_only_its_rows_in_the_shared_folder(spark):
    root = scratch_root(spark).removeprefix("file://")
    before = set(glob(f"{root}/*"))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100
    (left,) = set(glob(f"{root}/*")) - before
    assert "/stage-tokens-" in left


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_a_row_for_each(spark, name):
    table = "pages" if name in ("op2_warc", "op8_urls") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
