"""Queries on writes whose seq repeats, as it does beyond 1,000,003 events: against their SQL with the ties it leaves open decided by event_id."""

import random

import duckdb
import pytest

from orrery.plans import registry
from tests.test_queries import rows

ASCENDING = "seq, event_id"


def settled(sql: str) -> str:
    """The SQL with ties ordered by event_id; of values at one seq, that which the merge takes."""
    sql = sql.replace("ORDER BY seq ROWS", f"ORDER BY {ASCENDING} ROWS").replace("ORDER BY seq) AS k", f"ORDER BY {ASCENDING}) AS k")
    sql = sql.replace("t AS (SELECT user_id", "t AS (SELECT event_id, user_id").replace("e ORDER BY seq)", f"e ORDER BY {ASCENDING})")
    return sql.replace("(made, seq)", "(made, {'a': seq, 'b': event_id})").replace("(value, seq)", "(value, {'a': seq, 'b': value})")


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Events of 80 records whose seqs each occur five times, later ones first in the file."""
    folder, rng = tmp_path_factory.mktemp("tied"), random.Random(8)
    events = [(base + k * 1000003, rng.randrange(10**6), base % 40, "ab"[base % 80 // 40], rng.randrange(100)) for base in range(240) for k in range(5)]
    con = duckdb.connect()
    con.execute("create table raw(event_id bigint, us bigint, user_id bigint, event_type varchar, k bigint)")
    con.executemany("insert into raw values (?, ?, ?, ?, ?)", sorted(events, reverse=True))
    con.execute(f"""copy (select event_id, make_timestamp(1704067200000000 + us) as ts, user_id, event_type, 0.5::double as value, '{{"k": ' || k || '}}' as props from raw order by event_id desc) to '{folder}/events.parquet'""")
    con.execute(f"create view events as from '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["A1_fold_fallback", "W2_fresh_flag", "A1_observation_merge", "R2_stream_merge", "J2_A6_S6_snapshot_upsert"])
def test_ties_follow_events(name, spark, tied):
    folder, con = tied
    df = registry.queries()[name](spark, folder)
    want = con.execute(settled(registry.oracle_sql()[name]))
    columns = [c[0] for c in want.description]
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, want.fetchall())
