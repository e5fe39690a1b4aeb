from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import veccodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(points, entries):
    distance = ((points[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    return np.array([min(range(len(entries)), key=lambda e: (row[e], e)) for row in distance])


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 90), st.integers(1, 12), st.integers(1, 4), st.sampled_from([2, 5, 1000, 1 << 26]), st.integers(0, 10**6))
def test_filtering_assigns_as_all_comparisons_do(n, e, width, spread, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, (n, width))
    entries = np.concatenate((points[rng.integers(0, n, e)], rng.integers(-spread, spread + 1, (e, width))))
    order, *boxes = veccodes.built(points, leaf=3)
    assert sorted(order.tolist()) == list(range(n))
    chosen, total, count, _ = veccodes.assigned(points[order], *boxes, entries, leaf=3)
    want = brute(points[order], entries)
    assert chosen.tolist() == want.tolist() and count.tolist() == np.bincount(want, minlength=2 * e).tolist()
    assert all(total[k].tolist() == points[order][want == k].sum(axis=0).tolist() for k in range(2 * e))


def test_whole_subtrees_are_assigned_at_once():
    rng = np.random.default_rng(1)
    middles = rng.integers(-1000, 1000, (8, 4))
    points = middles[rng.integers(0, 8, 4000)] + rng.integers(-20, 21, (4000, 4))
    order, *boxes = veccodes.built(points)
    *_, compared = veccodes.assigned(points[order], *boxes, middles)
    assert compared < 400  # of 4000 points


def lloyd(rows, parts, entries, rounds):
    """The contract, part by part and vector by vector."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in rows), default=1) // parts) * parts
    whole = [[int(np.floor(256 * float(np.float32(x)))) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    cut = lambda v, p: v[p * width // parts : (p + 1) * width // parts]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut(whole[i], p) for i in first] for p in range(parts)]
    squares = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((squares(cut(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        sums = defaultdict(list)
        for p in range(parts):
            for v in whole:
                sums[p, near(v, p)[1]].append(cut(v, p))
        for (p, i), members in sums.items():
            books[p][i] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = []
    for r, v in zip(rows, whole, strict=True):
        best = [near(v, p) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)))
    label_error = defaultdict(int)
    for _, label, _, error in out:
        label_error[label] += error
    return sorted(((i, label, c, e, label_error[label]) for i, label, c, e in out), key=repr), ",".join(str(x) for book in books for e in book for x in e)


def messy(n, width, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, width).astype(np.float32)], int(i % 3) or None, f"c{i}") for i in rng.permutation(n)]
    rows += [(n, None, 1, "c"), (n + 1, [None, *[0.5] * (width - 1)], 1, "c"), (n + 2, [float("nan")] * width, 2, "c"), (n + 3, [float("-inf")] * width, None, "c")]
    return [*rows, rows[0], rows[0], (None, rows[1][1], None, "c"), (7, [0.25] * width, 2, None)]


@pytest.mark.parametrize("n, width, block, slices", [(150, 8, 16, 3), (40, 12, 8192, 1), (9, 4, 4, 5)])
def test_against_the_contract(spark, n, width, block, slices):
    rows = messy(n, width)
    data = spark.createDataFrame(rows, SCHEMA).repartition(slices)
    out, books = veccodes.compressed(data, "vec_id", "embedding", "label", parts=4, entries=16, block=block)
    want, joined = lloyd(rows, 4, 16, veccodes.ROUNDS)
    got = sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in out.collect()), key=repr)
    assert got == want and ",".join(map(str, books.entries.ravel().tolist())) == joined


def test_vectors_of_other_lengths_are_padded(spark):
    rows = [(i, [0.5 * i] * (3 + i), None, None) for i in range(6)] + [(9, [], 1, None)]
    out, _ = veccodes.compressed(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", parts=4, entries=3)
    want, _ = lloyd(rows, 4, 3, veccodes.ROUNDS)
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in out.collect()), key=repr) == want


def test_huge_components_and_empty_tables(spark):
    data = spark.createDataFrame([(1, [3e38, -3e38, 1.0, 0.0], 1, None), (2, [0.0] * 4, 1, None)], SCHEMA)
    out, _ = veccodes.compressed(data, "vec_id", "embedding", "label", parts=2, entries=1)
    assert all(r.error >= 0 for r in out.collect())
    for none in (data.limit(0), data.where("vec_id > 2"), spark.createDataFrame([(1, None, 1, None)], SCHEMA)):
        out, books = veccodes.compressed(none, "vec_id", "embedding", "label")
        assert out.count() == 0 and books.entries.size == 0


def test_codes_lead_back_near_their_vectors(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 1, (5, 16))
    rows = [(i, [float(x) for x in middles[i % 5] + rng.normal(0, 0.02, 16)], i % 5, None) for i in range(300)]
    out, books = veccodes.compressed(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", parts=8, entries=32, rounds=4)
    for r in out.collect():
        assert np.abs(np.array(books.decoded(r.code)) - middles[r.vec_id % 5]).max() < 0.15
