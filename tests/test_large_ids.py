"""Images of events with large ids against the SQL of their queries: such ids put chance start codes into headers and fill fields."""

from __future__ import annotations

import duckdb
import pytest

from frameloom.plans import images, registry  # noqa: F401
from frameloom.sources.rendered import PER_IMAGE

TYPES = "['view', 'click', 'error', 'signup', 'purchase']"


@pytest.fixture
def against_sql(spark, tmp_path):
    """Rows of a query that are not in its SQL's and the other way, over events of the images that hold the ids."""

    def run(name: str, *ids: int):
        numbers = ", ".join(str(i // PER_IMAGE) for i in (0, *ids))
        con = duckdb.connect()
        con.execute(
            f"CREATE TABLE events AS SELECT id AS event_id, TIMESTAMP '2024-01-01' + id * INTERVAL 26 SECOND AS ts, id % 7 AS user_id, {TYPES}[1 + CAST(id * 7 % 5 AS INT)] AS event_type, (id * 13 % 90)::DOUBLE AS value, '{{}}' AS props"
            f" FROM (SELECT unnest([{numbers}]) * {PER_IMAGE} AS first), range({PER_IMAGE}) r(k), LATERAL (SELECT CAST(first + k AS BIGINT) AS id)"
        )
        con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        want = con.execute(registry.ORACLE[name])
        columns = [c[0] for c in want.description]
        want = {tuple(r) for r in want.fetchall()}
        out = registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
        got = {tuple(r) for r in out}
        assert len(out) == len(got)
        return got - want, want - got

    return run


@pytest.mark.parametrize("chance", [3_345_664, 5_442_816])  # a slice, and side information, by the bytes of the time
def test_start_codes_in_headers_are_no_units(against_sql, chance):
    assert against_sql("replay_layout", chance) == (set(), set())


def test_serials_have_six_places(against_sql):
    assert against_sql("genome_match", 5_120, 1_001_472) == (set(), set())
