from __future__ import annotations

import gzip
import hashlib
import io
import random

from frameloom.llm import warc
from frameloom.llm.common import scratch_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, url_key string")


def test_round_trip_and_verdicts(spark):
    big, other = "é\r\n\r\nWARC/1.1\r\n" * 90, "y" * 1000
    rows = [(1, "http://b.Example.com/x?q#f", big, "k"), (2, "https://a.example.com", big, "k"), (3, None, None, "k"), (4, "no scheme", "small", "k"), (5, "http://b.example.com/x", "small", "k"), (6, "http://c\r\nX: y/", other, "k"), (7, "http://d/", big, "k")]
    out = {r.record_id: r for r in warc.captured(pages(spark, rows), "page_id", "url", "html").collect()}
    assert len(out) == len(rows) and all(r.intact for r in out.values())
    for i, _, html, _ in rows:
        data = (html or "").encode()
        revisit = html == big and i != 7
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (out[i].record_type, out[i].refers_to) == (("revisit", 7) if revisit else ("response", None))
    assert out[1].url_key == "com,example,b)/x?q#f" and out[3].url_key == ""


def test_global_order(spark):
    rnd = random.Random(1)
    rows = [(i, f"http://h{rnd.randrange(9)}.org/{rnd.randrange(4)}", "p" * rnd.randrange(30), "") for i in range(300)]
    got = [(r.url_key, r.captured_at, r.record_id) for r in warc.captured(pages(spark, rows).repartition(7), "page_id", "url", "html").collect()]
    assert got == sorted(got) and len(got) == 300


def test_archives_are_plain_warc(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages(spark, [(1, "http://a/", "x", "")]), path, "page_id", "url", "html")
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).first().content
    text = gzip.decompress(bytes(packed))
    (_, head, block), = warc.records(io.BytesIO(text))
    assert head["warc-type"] == "response" and int(head["content-length"]) == len(block) and text.endswith(b"\r\n\r\n")


def test_empty_repeated_and_null_ids(spark):
    assert warc.captured(pages(spark, []), "page_id", "url", "html").count() == 0
    big = "z" * 2000
    rows = [(3, "http://a/", big, ""), (3, "http://a/", big, ""), (None, "http://b/", big, "")]
    out = sorted((r.record_id or 0, r.record_type, r.refers_to) for r in warc.captured(pages(spark, rows), "page_id", "url", "html").collect())
    assert out == [(0, "revisit", 3), (3, "response", None), (3, "response", None)]


def test_loser_tree_and_spills():
    rnd = random.Random(8)
    make = lambda run, n: sorted([(f"u{rnd.randrange(20)}", "t", rnd.randrange(99), "response", "d", 1, None, True, run, i) for i in range(n)], key=warc._order)
    for sizes in ([], [0], [1], [5, 0, 3], [40, 1, 17, 9, 22]):
        runs = [make(f"r{i}", n) for i, n in enumerate(sizes)]
        want = sorted((r for run in runs for r in run), key=warc._order)
        assert list(warc.LoserTree([iter(r) for r in runs])) == want
        mixed = [r for run in runs for r in run]
        rnd.shuffle(mixed)
        assert list(warc.merged_rows(mixed, most=10)) == want
