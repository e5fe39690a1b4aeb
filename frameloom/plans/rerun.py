"""A case's stages as tables that know what they were made from.

A stage's output is a versioned table whose manifest holds a mark: the hash of the stage's name and parameters and of the marks of
what it needs. A run goes through the stages in order and makes those whose mark has changed; the others, and all that a change does not
reach, are left as they are. So confirming a layout makes anew what depends on layouts and nothing else, running again after a
crash goes on where it ended, and running again without a change does nothing. Every step is an entry of the case's audit chain.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators import custody
from frameloom.sources import versions

GENESIS = "0" * 64
AUDIT = "seq long, prev_hash string, entry_hash string, actor string, action string, object_id string, details string"


@dataclass(frozen=True)
class Stage:
    """``make`` turns the tables a stage needs (stages or sources, by name) into its own; ``params`` is what else its result depends on."""

    name: str
    needs: tuple[str, ...]
    make: Callable[[dict[str, DataFrame]], DataFrame]
    params: str = ""

    def mark(self, marks: dict[str, str]) -> str:
        return hashlib.sha256(json.dumps([self.name, self.params, [marks[n] for n in self.needs]]).encode()).hexdigest()


def audited(spark: SparkSession, folder: str, entries: list[dict]) -> None:
    """Add entries (actor, action, object_id, details) to the case's chain; a writer that comes second links to what came first."""
    path = f"{folder}/audit"
    while True:
        base = versions.manifest(spark, path)
        log = versions.read(spark, path)
        log = spark.createDataFrame([], AUDIT) if log is None else log
        new = custody.appended(log, [{**e, "details": json.dumps(e.get("details", {}), sort_keys=True)} for e in entries], GENESIS)
        names = [c.split()[0] for c in AUDIT.split(", ")]
        rows = spark.createDataFrame([tuple(e[n] for n in names) for e in new], AUDIT)
        try:
            versions.replace(log.unionByName(rows), path, since=base["version"] if base else 0)
            return
        except versions.Conflict:
            continue


def run(spark: SparkSession, folder: str, stages: Iterable[Stage], sources: dict[str, tuple[str, DataFrame]], actor: str) -> dict[str, str]:
    """Each stage's outcome, made or kept. ``sources``: (content id, rows) by name; stages come after what they need.

    A stage that fails ends the run; what was made before it stays and is kept the next time.
    """
    marks = {name: content for name, (content, _) in sources.items()}
    tables = {name: rows for name, (_, rows) in sources.items()}
    out: dict[str, str] = {}
    for stage in stages:
        path, mark = f"{folder}/{stage.name}", stage.mark(marks)
        known = versions.manifest(spark, path)
        if known and known["note"].get("mark") == mark:
            out[stage.name] = "kept"
        else:
            try:
                versions.replace(stage.make({n: tables[n] for n in stage.needs}), path, note={"mark": mark})
            except Exception as fault:
                audited(spark, folder, [{"actor": actor, "action": "stage.failed", "object_id": stage.name, "details": {"error": type(fault).__name__}}])
                raise
            out[stage.name] = "made"
            audited(spark, folder, [{"actor": actor, "action": "stage.made", "object_id": stage.name, "details": {"mark": mark}}])
        marks[stage.name], tables[stage.name] = mark, versions.read(spark, path)
    return out


LAYOUTS = "layout_id string, image_id string, layout string, confirmed_by string"


def propose(spark: SparkSession, folder: str, layout_id: str, image_id: str, layout: str) -> None:
    """Add an inferred layout, unconfirmed; one that is there stays as it is."""
    versions.append_new(spark.createDataFrame([(layout_id, image_id, layout, None)], LAYOUTS), f"{folder}/layouts", ["layout_id"])


def confirm(spark: SparkSession, folder: str, layout_id: str, actor: str, stages: Iterable[Stage], sources: dict[str, tuple[str, DataFrame]]) -> dict[str, str]:
    """Confirm a layout and make anew what depends on layouts; confirming it again is noted and changes nothing.

    Stages that need ``layouts`` see the confirmed ones. KeyError if the layout is not known.
    """
    path = f"{folder}/layouts"
    while True:
        base, rows = versions.manifest(spark, path), versions.read(spark, path)
        one = rows.where(F.col("layout_id") == layout_id).first() if rows is not None else None
        if one is None:
            raise KeyError(layout_id)
        if one.confirmed_by is not None:
            audited(spark, folder, [{"actor": actor, "action": "layout.confirm_noop", "object_id": layout_id, "details": {"already_confirmed_by": one.confirmed_by}}])
            break
        named = F.when(F.col("layout_id") == layout_id, actor).otherwise(F.col("confirmed_by"))
        try:
            versions.replace(rows.withColumn("confirmed_by", named), path, since=base["version"])
        except versions.Conflict:
            continue
        audited(spark, folder, [{"actor": actor, "action": "layout.confirmed", "object_id": layout_id, "details": {"image_id": one.image_id}}])
        break
    confirmed = versions.read(spark, path).where("confirmed_by IS NOT NULL")
    # a content id that does not depend on who confirmed
    content = confirmed.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list("layout_id"))), 256)).first()[0]
    return run(spark, folder, stages, {**sources, "layouts": (content, confirmed)}, actor)
