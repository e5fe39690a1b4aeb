"""The nearest row in time against a plain loop, and without pairs where many rows lie within reach."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import verdict
from frameloom.operators.intervals import nearest_within


def most_rows(frame) -> int:
    """The most rows that a node of the plan made when ``frame`` was last run."""

    def walk(node):
        name = node.getClass().getSimpleName()
        metric = node.metrics().get("numOutputRows")
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        below = node.children()
        return max([metric.get().value() if metric.isDefined() else 0, *map(walk, inner), *(walk(below.apply(i)) for i in range(below.size()))])

    return walk(frame._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("n", [1, 3, 16])
def test_nearest_is_that_of_a_loop(spark, n):
    rnd = random.Random(n)
    asks = [(i, rnd.choice([None, rnd.randrange(-50, 700)])) for i in range(150)]
    logs = [(j, rnd.choice([None, *[rnd.randrange(0, 600) // 5 * 5] * 9]), rnd.choice([None, "a", "b"])) for j in range(120)]
    want = {}
    for i, at in asks:
        near = [(abs(t - at), t, j, kind) for j, t, kind in logs if at is not None and t is not None and abs(t - at) <= 7]
        if near:
            want[i] = min(near, key=lambda x: x[:3])[1:]
    left, right = spark.createDataFrame(asks, "q int, at long").repartition(4), spark.createDataFrame(logs, "j int, t long, kind string").repartition(3)
    out = nearest_within(left, right, "q", "at", "t", ["t", "j"], 7, n)
    assert out.columns == ["q", "at", "j", "t", "kind"]
    assert {r.q: (r.t, r.j, r.kind) for r in out.collect()} == want and out.count() == len(want)


def test_a_tie_goes_by_the_order_asked_for(spark):
    left, right = spark.createDataFrame([(1, 100)], "q int, at long"), spark.createDataFrame([(7, 90), (8, 110), (5, 110)], "j int, t long")
    assert [r.j for r in nearest_within(left, right, "q", "at", "t", ["j"], 10).collect()] == [5]


def test_many_rows_of_one_time_make_no_pairs(spark):
    n = 2000
    left = spark.range(n).select(F.col("id").alias("q"), F.lit(1000).cast("long").alias("at"))
    right = spark.range(n).select(F.col("id").alias("j"), (F.lit(1000) + F.col("id") % 3).cast("long").alias("t"))
    out = nearest_within(left, right, "q", "at", "t", ["t", "j"], 50)
    assert {r.j for r in out.collect()} == {0} and out.count() == n
    assert most_rows(out) <= 4 * n


def test_verdicts_of_many_spans_about_one_time_make_no_pairs(spark):
    n = 2000
    spans = spark.range(n).selectExpr("id AS channel", "0L AS run", "1000L AS start_us", "1200L AS end_us", "3L AS n_frames", "9L AS n_bytes")
    logs = spark.range(n).selectExpr("id AS log_id", "1090L + id % 5 AS log_ts", "CASE WHEN id % 5 = 4 THEN 'time_change' ELSE 'logout' END AS log_kind")
    live = spark.range(n).selectExpr("id AS channel", "1500L AS live_start")
    out = verdict.verdicts(spans, live, logs, "channel", 50, 50, 1000)
    assert {(r.method, r.confidence) for r in out.collect()} == {("expiry", 0.4)} and out.count() == n
    assert most_rows(out) <= 4 * n
