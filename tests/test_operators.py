"""Operators against direct loops and on small fixed cases."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import clock, custody, islands, lookup, stats
from frameloom.operators.intervals import asof, complement, nearest_within, overlap_join


def test_chronological_matches_the_fold(spark):
    rnd = random.Random(3)
    data = []
    for channel in range(60):
        for off in range(rnd.randint(0, 12)):
            data.append((channel, off, rnd.choice([None, rnd.randint(0, 200) * 1_000_000])))
    want = {}
    state = {}
    for channel, off, ts in data:
        index, high = state.get(channel, (0, None))
        if ts is not None:
            if high is not None and ts < high - 5_000_000 and index < 2:
                index += 1
            high = ts if high is None else max(high, ts)
        state[channel] = (index, high)
        want[channel, off] = index
    rows = spark.createDataFrame(data, "channel int, off int, ts long")
    got = clock.chronological(rows, ["channel"], "ts", "off", F.lit(3)).collect()
    assert {(r.channel, r.off): r.segment for r in got} == want


def test_segments_fold_back_from_the_seizure(spark):
    h = 3_600_000_000
    changes = spark.createDataFrame([(1, 10 * h, 9 * h), (1, 20 * h, 22 * h)], "channel int, old_us long, new_us long")
    got = clock.segments(changes, ["channel"], F.lit(312_000_000)).orderBy("i").collect()
    assert [(r.from_us, r.to_us, r.offset_us) for r in got] == [(None, 10 * h, 312_000_000 - h), (9 * h, 20 * h, 312_000_000 - 2 * h), (22 * h, None, 312_000_000)]


def test_interpolation_of_edges_and_middle(spark):
    rows = spark.createDataFrame([(1, 0, None, 0.0), (1, 1, 100, 0.9), (1, 2, None, 0.0), (1, 3, 201, 0.9), (1, 4, None, 0.0), (2, 0, None, 0.0)], "channel int, off int, ts long, conf double")
    got = clock.interpolated(rows, ["channel"], "off", "ts", "conf").orderBy("channel", "off").collect()
    assert [(r.ts, r.conf) for r in got] == [(100, 0.15), (100, 0.9), (150, 0.3), (201, 0.9), (201, 0.15), (None, 0.0)]


def test_overlap_join_matches_nested_loops(spark):
    rnd = random.Random(5)
    make = lambda n: [(i, rnd.randint(0, 3), s := rnd.randint(-50, 500), s + rnd.randint(0, 90)) for i in range(n)]
    a, b = make(60), make(50)
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] <= x[3] + 7 and y[3] >= x[2] - 7}
    left, right = spark.createDataFrame(a, "i int, c int, s long, e long"), spark.createDataFrame(b, "j int, d int, s2 long, e2 long")
    got = overlap_join(left, right, [("c", "d")], ("s", "e"), ("s2", "e2"), 7, 40).select("i", "j").collect()
    assert len(got) == len(want) and {(r.i, r.j) for r in got} == want


def test_nearest_ties_go_to_the_first(spark):
    left = spark.createDataFrame([(1, 100), (2, 500)], "q int, mid long")
    right = spark.createDataFrame([(7, 90), (8, 110), (9, 900)], "r int, t long")
    got = nearest_within(left, right, "q", "mid", "t", ["t", "r"], 10).collect()
    assert [(x.q, x.r) for x in got] == [(1, 7)]


def test_complement_of_nested_and_outside_spans(spark):
    spans = spark.createDataFrame([(1, -5, 3), (1, 10, 40), (1, 12, 20), (1, 90, 130)], "k int, s long, e long")
    got = complement(spans, ["k"], "s", "e", F.lit(0), F.lit(100)).orderBy("gap_start").collect()
    assert [(r.gap_start, r.gap_end) for r in got] == [(3, 10), (40, 90)]


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, p long")
    right = spark.createDataFrame([(1, 5), (1, 7)], "k int, p long")
    got = asof(left, right, ["k"], "p", F.col("p"), "v").collect()
    assert {(r.k, r.p): r.v for r in got} == {(1, 5): 5, (1, 9): 7, (2, 1): None}


def test_thinning_keeps_distance_from_the_last_kept(spark):
    rows = spark.createDataFrame([(1, t) for t in (0, 20, 35, 50, 70)], "k int, t long")
    assert [r.t for r in islands.thinned(rows, ["k"], "t", 30, 60).orderBy("t").collect()] == [0, 35, 70]
    assert [r.t for r in islands.thinned(rows, ["k"], "t", 1, 2).orderBy("t").collect()] == [0, 35]


def test_robust_median_without_spread(spark):
    rows = spark.createDataFrame([("a", 5.0)] * 3 + [("b", v) for v in (1.0, 2.0, 3.0, 1000.0)], "k string, v double")
    got = {r.k: (r.median, r.n_kept) for r in stats.robust_median(rows, ["k"], "v").collect()}
    assert got == {"a": (5.0, 3), "b": (2.0, 3)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_merkle_root(spark, n):
    hexes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    level = hexes
    while len(level) > 1:
        level = [hashlib.sha256(bytes.fromhex(level[i]) + bytes.fromhex(level[min(i + 1, len(level) - 1)])).hexdigest() for i in range(0, len(level), 2)]
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate(hexes)], "k int, i int, h string")
    assert custody.merkle_root(rows, ["k"], "i", "h").first().root == level[0]


def test_page_cursor(spark):
    rows = spark.range(7).withColumnRenamed("id", "v")
    page, after = lookup.page(rows, ["v"], 3, "3")
    assert [r.v for r in page.collect()] == [3, 4, 5] and after == "6"
    assert lookup.page(rows, ["v"], 3, "6")[1] is None
    with pytest.raises(ValueError):
        lookup.page(rows, ["v"], 3, "x")


def test_refusal_of_payloads(spark):
    cases = {
        '{"note": "fine", "payload_offset": 3}': None,
        '{"a": {"Thumb-Nail": 1}}': "key",
        '{"clip_bytes": 1}': "key",
        '{"a": "frame: image"}': None,
        '{"a": "%s"}' % ("aB" * 200): "string",
        '{"a": "%s"}' % ("aB" * 128): None,
        '{"a": "%s"}' % ("two words " * 40): None,
        '{"a": "\\"frame\\": 1"}': None,
        '{"a": "%s"}' % ("two words " * 90): "size",
        None: None,
    }
    rows = spark.createDataFrame([(p, w) for p, w in cases.items()], "payload string, want string")
    assert rows.where(~lookup.refusal(F.col("payload"), 256, 800).eqNullSafe(F.col("want"))).collect() == []


def test_over_budget(spark):
    calls = spark.createDataFrame([("a", 40), ("a", 30), ("b", 10)], "case string, cost long")
    asked = spark.createDataFrame([("a", 5), ("a", 31), ("b", 30), ("c", 100), ("c", 121)], "case string, estimated long")
    got = {(r.case, r.estimated): (r.spent_case, r.refused) for r in lookup.over_budget(calls, asked, "case", 200, 100).collect()}
    assert got == {("a", 5): (70, None), ("a", 31): (70, "case"), ("b", 30): (10, None), ("c", 100): (0, None), ("c", 121): (0, "total")}
    empty = lookup.over_budget(calls.limit(0), asked.where("case = 'c'"), "case", 110, 200)
    assert {r.refused for r in empty.collect()} == {None, "total"}


def test_global_search_caps_reasons_and_order(spark):
    cases = spark.createDataFrame([(1, "C-1", "Depot"), (2, "C-2", None)], "case_id int, number string, title string")
    evidence = spark.createDataFrame([("i1", 1, "/x/Depot.raw", "a" * 64), ("i2", 2, None, None)], "id string, case_id int, path string, sha256 string")
    recordings = spark.createDataFrame([("r-depot", 2, 4, "index")], "id string, case_id int, channel int, source string")
    findings = spark.createDataFrame([("f1", 1, "overwrite", ["at the DEPOT", "later"]), ("f2", 1, "format", None), ("f3", 2, "depot", [])], "id string, case_id int, method string, reasons array<string>")
    noon = 12 * 3_600_000_000
    frames = spark.createDataFrame([(i, 1 + i % 2, 3, i, noon + i * 100_000 + (i % 3) * 86_400_000_000) for i in range(30)], "id long, case_id int, channel int, payload_offset long, ts_us long")
    find = lambda q, **k: [(r.kind, r.id, r.case_id, r.detail) for r in lookup.global_search(q, cases, evidence, recordings, findings, frames, **k).collect()]
    assert find(" depot ") == [
        ("case", "1", "1", "C-1"),
        ("evidence", "i1", "1", "sha256=" + "a" * 12 + "…"),
        ("finding", "f1", "1", "at the DEPOT; later"),
        ("recording", "r-depot", "2", "index"),
        ("finding", "f3", "2", ""),
    ]
    at = find("12:00:00")
    assert [(c, sum(x[2] == c for x in at)) for c in ("1", "2")] == [("1", 5), ("2", 5)] and {x[0] for x in at} == {"frame"}
    assert find("12:00:00", most=3) == at[:3] and find("  ") == [] and find("99:99:99") == [] and len(find("i")) == 3


def test_postings_of_grams(spark):
    rows = spark.createDataFrame([(1, "The Cat sat"), (2, "scatter"), (3, "ca t"), (None, "cat"), (5, None), (6, "at"), (7, "catXcat\ncat")], "id int, t string")
    index = lookup.gram_index(rows, "id", "t")
    for q in ("cat", "CAT", "at", "tcat", "cat sat", "t\nc", ""):
        want = sorted((r.id or 0) for r in rows.collect() if r.t is not None and q.lower() in r.t.lower()) if q else None
        got = sorted((r.id or 0) for r in lookup.containing(rows, "id", "t", q, index).collect())
        assert q == "" or got == want
        assert got == sorted((r.id or 0) for r in lookup.containing(rows, "id", "t", q).collect())


def test_dates_of_all_shapes(spark):
    cases = {
        "Mon 2024-03-05 07:08:09 Tue": "2024-03-05 07:08:09",
        "x 2024-03-05T7:08:09 PM": "2024-03-05 19:08:09",
        "05-03-2024  12:00:01am": "2024-03-05 00:00:01",
        "Fri 03/05/2024 17:00:00 Fri": "2024-03-05 17:00:00",
        "3/5/2024 5:00:00 PM": "2024-03-05 17:00:00",
        "03/05/2024 12:30:00 PM": "2024-03-05 12:30:00",
        "2024-13-05 07:08:09 then 05-03-2024 01:02:03": "2024-03-05 01:02:03",
        "2024-02-30 07:08:09": None,
        "no date 12:00:00": None,
        "2024-03-05 25:00:00": None,
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", lookup.parsed_datetime(F.col("t")).alias("us"), F.timestamp_micros(lookup.parsed_datetime(F.col("t"))).cast("string").alias("s"))
    assert {r.t: r.s for r in rows.collect()} == cases


def test_sentences_against_their_facts(spark):
    facts = spark.createDataFrame([("f1", "1,250 frames on channel 3"), ("f2", "at 12.5 s"), ("f3", None)], "id string, text string")
    rows = [(1, "1250 frames", ["f1"]), (2, "1250 frames at 12.5", ["f1"]), (3, "nothing", []), (4, "nothing", None), (5, "3 and 12.5 and 9", ["f2", "f1", "x", "a", "f2"]), (6, None, ["f3"]), (7, "7", ["f3"])]
    out = {r.id: list(r.reasons) for r in lookup.judged_sentences(spark.createDataFrame(rows, "id int, text string, evidence_ids array<string>"), facts).collect()}
    assert out == {1: [], 2: ["numbers that no cited fact has: 12.5"], 3: ["cites nothing"], 4: ["cites nothing"], 5: ["cites what is not known: a, x", "numbers that no cited fact has: 9"], 6: [], 7: ["numbers that no cited fact has: 7"]}
