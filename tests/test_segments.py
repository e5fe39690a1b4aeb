"""Scans and chains in segments against plain loops, for several numbers of segments."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import islands, records, segments
from frameloom.plans import case
from frameloom.plans.images import as_range
from frameloom.sources import synthetic


def sequences(seed=1):
    rnd = random.Random(seed)
    rows = []
    for key, n in (("hot", 300), ("b", 7), (None, 40), ("one", 1)):
        places = rnd.sample(range(2000), n)
        rows += [(key, p, rnd.choice([None, -3, 0, 5, 9]), p + rnd.choice([1, 3, 40, 400 if rnd.random() < 0.05 else 2])) for p in places]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [1, 3, 16])
def test_scans_are_those_of_a_loop(spark, n):
    rows = sequences()
    data = spark.createDataFrame(rows, "k string, at long, v long, until long").repartition(5)
    v = F.col("v")
    laid = segments.segmented(data, ["k"], ["at"], n)
    out = segments.scanned(laid, ["k"], ["at"], sums={"total": v}, reaches={"far": v}, last={"known": v}, lag={"before": v}, lead={"after": v})
    got = {(r.k, r["at"]): (r.total, r.far, r.known, r.before, r.after) for r in out.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == key) if key else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        values = [r[2] for r in own]
        for i, r in enumerate(own):
            told = [x for x in values[: i + 1] if x is not None]
            past = [x for x in values[:i] if x is not None]
            want = (sum(told), max(past, default=None), told[-1] if told else None, values[i - 1] if i else None, values[i + 1] if i + 1 < len(own) else None)
            assert got[key, r[1]] == want


def greedy(rows):
    out, reach = [], None
    for r in sorted(rows, key=lambda r: (r[1], r[3])):
        if reach is None or r[1] >= reach:
            out.append(r)
            reach = r[3]
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_chains_are_those_of_a_loop(spark, n, seed):
    rows = sequences(seed)
    rows += [("all", p, None, 5000) for p in range(0, 900, 3)] + [("grid", p, None, p + 10) for p in range(400)]
    data = spark.createDataFrame([*rows, ("hot", None, 1, 2)], "k string, at long, v long, until long").repartition(3)
    got = sorted((tuple(r) for r in segments.chained(data, ["k"], "at", "until", n).collect()), key=repr)
    want = [x for key in {r[0] for r in rows} for x in greedy([r for r in rows if r[0] == key])]
    assert got == sorted(want, key=repr)


def test_chains_of_nothing(spark):
    assert segments.chained(spark.createDataFrame([], "k string, at long, until long"), ["k"], "at", "until").count() == 0


@pytest.mark.parametrize("step, most", [(1, 7), (30, 60), (13, 5), (5, 1)])
def test_thinning_is_that_of_a_loop(spark, step, most):
    rnd = random.Random(step)
    times = {key: sorted(rnd.choices(range(1000), k=n)) for key, n in ((1, 400), (2, 9), (None, 60))}
    data = spark.createDataFrame([(k, t) for k, own in times.items() for t in own] + [(1, None)], "k int, t long").repartition(4)
    got = sorted((tuple(r) for r in islands.thinned(data, ["k"], "t", step, most).collect()), key=repr)
    want = []
    for key, own in times.items():
        kept = []
        for t in own:
            if not kept or t - kept[-1] >= step:
                kept.append(t)
        want += [(key, kept[int(i * len(kept) / most)]) for i in range(most)] if len(kept) > most else [(key, t) for t in kept]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("n", [1, 5, 23])
def test_segments_do_not_change_what_is_carved(spark, n):
    image = synthetic.dh_image()
    whole = sorted(map(str, records.carved(as_range(spark, image), "dhsim", 2).collect()))
    assert sorted(map(str, records.carved(as_range(spark, image), "dhsim", n).collect())) == whole and len(whole) == 36
    runs = synthetic.hw_run() + b"\xee" * 3 + synthetic.hw_run(9)[:-30]
    whole = sorted(map(str, records.carved(as_range(spark, runs), "hwsim", 2).collect()))
    assert sorted(map(str, records.carved(as_range(spark, runs), "hwsim", n).collect())) == whole
    unknown = synthetic.unknown_image()
    whole = sorted(map(str, case.generic_carve(as_range(spark, unknown), pieces=2).collect()))
    assert sorted(map(str, case.generic_carve(as_range(spark, unknown), pieces=n).collect())) == whole and len(whole) > 100


def test_a_record_over_a_whole_image_takes_one_row(spark):
    """Thousands of records within one: no row or group gathers them."""
    data = spark.range(4000).select(F.lit("x").alias("image"), F.col("id").alias("at"), F.when(F.col("id") == 0, 10_000).otherwise(F.col("id") + 1).alias("until"))
    assert [r["at"] for r in segments.chained(data, ["image"], "at", "until", 9).collect()] == [0]
