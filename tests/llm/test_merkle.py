from __future__ import annotations

import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from frameloom.llm import merkle

COLUMNS = ["doc_id", "source", "n_words", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """(root, siblings of each leaf by level), straight from the rule."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            run = nodes[k - k % fanout : k - k % fanout + fanout]
            paths[leaf].append((run[: k % fanout], run[k % fanout + 1 :]))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [k // fanout for k in at]
    return nodes[0], paths


def brute(rows, tampered, fanout):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, n_words, text)."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = tree([leaf_of(r) for r in by_source[s]], fanout)
    root, upper = tree([trees[s][0] for s in sources], fanout)
    out = []
    for s, above in zip(sources, upper, strict=True):
        for r, own in zip(by_source[s], trees[s][1], strict=True):
            later = (*r[:3], r[3].lower() if r[3] and tampered(r) else r[3])
            node = leaf_of(later)
            for left, right in [*own, *above]:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in [*own, *above] for x in left + right))
            out.append((r[0], leaf_of(r), trees[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def audited(data, fanout=3, levels=2):
    out = merkle.audited(data, "doc_id", "source", COLUMNS, {"text": F.lower("text")}, F.col("doc_id") % 4 == 0, fanout, levels)
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("left"), F.col("right")), "folded_root", "verified").collect()), key=repr)


def rows_of(sizes, seed=0):
    rnd, out = random.Random(seed), []
    for s, n in sizes.items():
        for i in range(n):
            out.append((rnd.randrange(10 * n) if i % 9 else None, s, f"{i % 5}" if i % 3 else None, rnd.choice([None, "", "ÄB c", "abc", f"Text {i}"])))
    rnd.shuffle(out)
    return out


def frame(spark, rows, slices=3):
    extra = [(*r, "x", "y", 1) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, source string, n_words string, text string, leaf string, g string, i long").repartition(slices)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "b": 2}, {"a": 3, "b": 4, "é": 9, "Z": 10, None: 28}, {"hot": 200, "b": 1, "c": 81}, {f"s{i}": 1 + i % 3 for i in range(31)}])
@pytest.mark.parametrize("levels", [1, 2])
def test_against_the_rule(spark, sizes, levels):
    rows = rows_of(sizes)
    assert audited(frame(spark, rows), 3, levels) == brute(rows, lambda r: r[0] is not None and r[0] % 4 == 0, 3)


def test_repeated_rows_are_leaves_of_their_own(spark):
    rows = [(5, "s", "w", "Same")] * 40 + [(8, "s", "w", "Same"), (8, "s", "w", "Other")]
    got = audited(frame(spark, rows))
    assert got == brute(rows, lambda r: r[0] % 4 == 0, 3) and sum(not r[-1] for r in got) == 2


def test_only_changed_documents_fail(spark):
    rows = rows_of({"a": 30, "b": 30}, 2)
    out = {(r[0], r[1]): r[-1] for r in audited(frame(spark, rows))}
    for r in rows:
        assert out[r[0], leaf_of(r)] == (not (r[0] is not None and r[0] % 4 == 0 and r[3] and r[3] != r[3].lower()))


def test_empty_table_and_long_text(spark):
    assert audited(frame(spark, [(1, "s", None, "x")]).limit(0)) == []
    rows = [(1, "s", None, "Ab é" * 500_000), (4, "s", None, "Ab" * 500_000)]
    assert audited(frame(spark, rows)) == brute(rows, lambda r: r[0] == 4, 3)


def test_numbers_follow_the_order_whatever_the_ranges(spark):
    rows = [(i * 7 % 500, "hot" if i % 3 else f"s{i % 11}") for i in range(2000)]
    data = spark.createDataFrame(rows, "k long, s string").repartition(9)
    got = defaultdict(list)
    for r in merkle.numbered(data, "s", ["k"], "test").collect():
        got[r.s].append((r.i, r.k, r.n))
    for cells in got.values():
        cells.sort()
        assert [i for i, _, _ in cells] == list(range(len(cells))) and {n for *_, n in cells} == {len(cells)}
        assert [k for _, k, _ in cells] == sorted(k for _, k, _ in cells)
