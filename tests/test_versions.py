"""Committed versions, crashes between steps, and stages that follow what they depend on."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from frameloom.plans import rerun
from frameloom.sources import versions

SCHEMA = "k int, v string"


def rows(spark, *cells):
    return spark.createDataFrame(list(cells), SCHEMA)


def held(spark, path, version=None):
    return sorted(tuple(r) for r in versions.read(spark, path, version).collect())


def test_a_table_replaces_itself_and_keeps_its_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.read(spark, path) is None
    assert versions.replace(rows(spark, (1, "a"), (2, None)), path) == 1
    assert versions.replace(versions.read(spark, path).withColumn("v", F.coalesce("v", F.lit("new"))), path, since=1) == 2
    assert held(spark, path) == [(1, "a"), (2, "new")] and held(spark, path, 1) == [(1, "a"), (2, None)]
    with pytest.raises(versions.Conflict):
        versions.replace(rows(spark), path, since=1)
    assert versions.replace(rows(spark), path) == 3 and held(spark, path) == []


def test_appending_what_is_new(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.append_new(rows(spark, (1, "a"), (1, "a"), (None, "n")), path, ["k"]) == 1
    assert versions.append_new(rows(spark, (1, "b"), (None, "m")), path, ["k"]) == 1
    assert versions.append_new(rows(spark, (1, "b"), (3, "c")), path, ["k"]) == 2
    assert sorted(((r.k, r.v) for r in versions.read(spark, path).collect()), key=repr) == [(1, "a"), (3, "c"), (None, "n")]


def test_crashes_leave_the_last_whole_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    versions.replace(rows(spark, (1, "a")), path)
    with monkeypatch.context() as m:  # rows are written, the manifest is not
        m.setattr(versions, "_taken", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            versions.replace(rows(spark, (2, "b")), path)
    assert held(spark, path) == [(1, "a")]
    (tmp_path / "t" / "_versions" / "000000000002.json").write_text('{"version": 2, "fold')  # cut off
    assert held(spark, path) == [(1, "a")]
    assert versions.replace(rows(spark, (3, "c")), path, since=1) == 3 and held(spark, path) == [(3, "c")]


def test_two_writers_cannot_take_one_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    versions.replace(rows(spark, (1, "a")), path)
    commit, other = versions._committed, []

    def late(*args):
        if not other:  # someone else commits between reading and committing
            other.append(commit(rows(spark, (2, "other")), path, versions.manifest(spark, path), 2, True, {}))
        return commit(*args)

    monkeypatch.setattr(versions, "_committed", late)
    assert versions.append_new(rows(spark, (2, "mine"), (3, "mine")), path, ["k"]) == 3
    assert held(spark, path) == [(1, "a"), (2, "other"), (3, "mine")]


def test_stages_follow_what_they_depend_on(spark, tmp_path):
    folder, made = f"file://{tmp_path}/case", []

    def stage(name, *needs, params=""):
        def make(tables):
            made.append(name)
            return spark.createDataFrame([(sum(t.count() for t in tables.values()), name)], "n long, name string")

        return rerun.Stage(name, needs, make, params)

    stages = [stage("hash", "image"), stage("carve", "image"), stage("frames", "carve", "layouts"), stage("verdict", "frames", "hash")]
    sources = {"image": ("sha-1", spark.range(3))}
    rerun.propose(spark, folder, "L1", "img", "{}")
    rerun.propose(spark, folder, "L2", "img", "{}")
    with pytest.raises(KeyError):
        rerun.confirm(spark, folder, "L9", "ann", stages, sources)
    assert set(rerun.confirm(spark, folder, "L1", "ann", stages, sources).values()) == {"made"} and made == ["hash", "carve", "frames", "verdict"]
    assert versions.read(spark, f"{folder}/frames").first().n == 2
    made.clear()
    assert set(rerun.confirm(spark, folder, "L1", "bob", stages, sources).values()) == {"kept"} and made == []
    assert rerun.confirm(spark, folder, "L2", "bob", stages, sources) == {"hash": "kept", "carve": "kept", "frames": "made", "verdict": "made"}
    log = versions.read(spark, f"{folder}/audit").orderBy("seq").collect()
    assert [r.action for r in log if r.action.startswith("layout")] == ["layout.confirmed", "layout.confirm_noop", "layout.confirmed"]
    assert [r.seq for r in log] == list(range(1, len(log) + 1)) and log[0].prev_hash == rerun.GENESIS and all(b.prev_hash == a.entry_hash for a, b in zip(log, log[1:], strict=False))
    assert {r.layout_id: r.confirmed_by for r in versions.read(spark, f"{folder}/layouts").collect()} == {"L1": "ann", "L2": "bob"}


def test_a_failed_stage_is_noted_and_the_next_run_goes_on(spark, tmp_path):
    folder, state = f"file://{tmp_path}/case", {"fails": True}

    def second(tables):
        if state["fails"]:
            raise ValueError("no")
        return tables["one"]

    stages = [rerun.Stage("one", ("image",), lambda t: t["image"]), rerun.Stage("two", ("one",), second)]
    sources = {"image": ("x", spark.range(4))}
    with pytest.raises(ValueError):
        rerun.run(spark, folder, stages, sources, "ann")
    state["fails"] = False
    assert rerun.run(spark, folder, stages, sources, "ann") == {"one": "kept", "two": "made"}
    assert [r.action for r in versions.read(spark, f"{folder}/audit").orderBy("seq").collect()] == ["stage.made", "stage.failed", "stage.made"]
    assert os.path.isdir(tmp_path / "case" / "two")
