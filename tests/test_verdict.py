"""Deletion findings on fixed cases: every rule, the gate, shared starts, wrap-around and evidence."""

from __future__ import annotations

import pytest

from frameloom.operators import verdict

S = 1_000_000
FRAMES = "image_id string, channel int, deleted boolean, ts_us long, off long, payload_len long"
RECORDINGS = "image_id string, recording_id string, channel int, deleted boolean, start_us long, end_us long, place long"
LOGS = "image_id string, log_id long, log_ts long, log_kind string, user string"


@pytest.fixture
def found(spark):
    def run(frames, recordings, logs):
        tables = [spark.createDataFrame(rows, schema) for rows, schema in ((frames, FRAMES), (recordings, RECORDINGS), (logs, LOGS))]
        out = verdict.findings(*tables, "image_id", "channel", 5 * S, 30 * S, 1800 * S, 600 * S)
        proof = verdict.evidence(out, tables[0], tables[1], "image_id", "channel")
        return {(r.image_id, r.channel): r for r in out.collect()}, proof.collect()

    return run


def test_rules(found):
    base = 100_000 * S
    frames = []
    for channel, starts in ((1, [0, 100]), (2, [50]), (3, [0]), (4, [0])):
        frames += [("a", channel, True, base + (t + i) * S, channel * 1000 + t + i, 10) for t in starts for i in range(3)]
    frames += [("a", 3, True, None, 3999, 10), ("a", 5, False, base, 5000, 10), ("gated", 1, True, base, 1, 10), ("b", 1, True, base, 1, 10), ("c", 1, True, base, 7, 10)]
    recordings = [
        ("a", "r1", 1, False, base + 5000 * S, base + 6000 * S, 10),
        ("a", "r2", 2, False, base + 5000 * S, base + 6000 * S, 20),
        ("a", "r3", 3, False, base + 5 * S, base + 90 * S, 30),
        ("a", "r3d", 3, True, base - 50 * S, base, 35),
        ("a", "r5a", 5, False, base, base + 40 * S, 60),
        ("a", "r5b", 5, False, base + 900 * S, base + 925 * S, 50),
        ("b", "r1", 1, False, base + 20 * S, base + 30 * S, 10),
        ("c", "r1", 1, False, base - 500 * S, base + 30 * S, 10),
    ]
    logs = [("a", 1, base + 3000 * S, "hdd_format", "admin"), ("a", 2, base + 6790 * S, "hdd_format", "late"), ("a", 3, None, "hdd_format", "x"), ("b", 4, base + 10 * S, "logout", "guest"), ("b", 5, base - 600 * S, "time_change", "guest")]
    got, proof = found(frames, recordings, logs)
    assert ("gated", 1) not in got
    one, two = got["a", 1], got["a", 2]
    assert (one.method, one.actor, one.action_us, one.confidence, one.n_frames) == ("format", "admin", base + 3000 * S, 0.7, 6)
    assert (one.start_us, two.start_us, two.end_us) == (base, base, base + 52 * S)
    assert len(one.reasons) == 2 and "in 2 runs" in one.reasons[0] and len(two.reasons) == 3
    assert got["a", 3].method == "expiry" and got["a", 3].action_us == base + 5 * S and got["a", 3].n_frames == 3
    assert (got["a", 4].method, got["a", 4].actor, got["a", 4].confidence) == ("format", None, 0.5)
    assert "no live recording" in got["a", 4].reasons[1]
    assert (got["b", 1].method, got["b", 1].actor, got["b", 1].confidence, len(got["b", 1].reasons)) == ("expiry", "guest", 0.5, 4)
    assert got["c", 1].method == "expiry" and got["c", 1].confidence == 0.5
    wrap = got["a", 5]
    assert (wrap.method, wrap.start_us, wrap.end_us, wrap.action_us, wrap.n_frames) == ("overwrite", base - 25 * S, base, base + 900 * S, 0)
    refs = {(p.image_id, p.channel, p.kind, p.ref) for p in proof}
    assert ("a", 5, "recording", "r5a") in refs and ("a", 3, "frame", "3999") not in refs and sum(p.channel == 1 and p.image_id == "a" for p in proof) == 6


def test_empty(found):
    assert found([], [], []) == ({}, [])
