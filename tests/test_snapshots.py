"""Versions of tables, and writes against a snapshot in buckets."""

import random

import pytest

from orrery.operators import merge, upsert
from orrery.sources import versions
from orrery.sources.storage import fresh


def test_versions_move_together_and_one_writer_wins(spark):
    root = fresh(spark, "versions")
    assert versions.latest(spark, root) is None
    rows = lambda *values: spark.createDataFrame([(v,) for v in values], "v bigint")
    assert versions.commit(spark, root, {"a": versions.stored(rows(1), root), "b": versions.stored(rows(2), root)}, None) == 0
    versions.stored(rows(9), root)  # a job that dies before its manifest
    read = lambda version: {k: [r.v for r in versions.opened(spark, t).collect()] for k, t in versions.manifest(spark, root, version).items()}
    assert versions.latest(spark, root) == 0 and read(0) == {"a": [1], "b": [2]}
    assert versions.commit(spark, root, {"a": versions.stored(rows(3), root)}, 0) == 1
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, {"a": versions.stored(rows(4), root)}, 0)
    assert read(0) == {"a": [1], "b": [2]} and read(1) == {"a": [3], "b": [2]}
    assert versions.collect(spark, root, 2, 0) == []  # nothing is old enough
    assert len(versions.collect(spark, root, 1, 1 << 60)) == 3  # the dead job's, the loser's, and the first a
    assert versions.latest(spark, root) == 1 and read(1) == {"a": [3], "b": [2]}


WRITES = "record string, seq bigint, at bigint, observed bigint, reporting boolean"
LEAVES = "record string, seq bigint, path string, removed boolean, value string"
LINKS = "record string, seq bigint, evidence string, added boolean"


def made(rng, first):
    writes, leaves, links = [], [], []
    for seq in range(first, first + 60):
        record = f"r{rng.randrange(12)}"
        writes.append((record, seq, seq * 10, rng.randrange(100), rng.random() < 0.8))
        for path in rng.sample(["/a", "/b", "/a/c", "/d/e"], 1):
            removed = rng.random() < 0.2
            leaves.append((record, seq, path, removed, None if removed else str(rng.randrange(9))))
        for e in rng.sample(["x", "y", "z"], 2):
            links.append((record, seq, e, rng.random() < 0.6))
    return writes, leaves, links


def test_batches_against_one_by_one(spark):
    rng, root = random.Random(5), fresh(spark, "snapshot")
    tables = upsert.empty(spark, root, 3)
    known, held, history = {}, set(), {}
    for first in (0, 100, 200):
        writes, leaves, links = made(rng, first)
        frames = [spark.createDataFrame(rows, ddl).repartition(3) for rows, ddl in ((writes, WRITES), (leaves, LEAVES), (links, LINKS))]
        tables, told = upsert.upsert(spark, root, tables, *frames)
        want = {}
        for record, seq, at, observed, reporting in writes:
            added = removed = 0
            for _, _, e, on in (x for x in links if x[:2] == (record, seq)):
                added, removed = added + (on and (record, e) not in held), removed + (not on and (record, e) in held)
                (held.add if on else held.discard)((record, e))
            want[seq] = (record not in known, added, removed)
            created, _, lo, hi = known.get(record, (at, at, None, None))
            if reporting:
                lo, hi = min(observed if lo is None else lo, observed), max(observed if hi is None else hi, observed)
            known[record] = (created, at, lo, hi)
            mine = [x for x in leaves if x[:2] == (record, seq)]
            history.setdefault(record, []).append((observed, reporting, {x[2]: x[4] for x in mine if not x[3]}, [x[2] for x in mine if x[3]]))
        assert {r.seq: (r.created, r.links_added, r.links_removed) for r in told.collect()} == want
        got = versions.opened(spark, tables["records"]).collect()
        assert {r.record: (r.created_at, r.updated_at, r.first_seen, r.last_seen) for r in got} == known
        assert {r.record: {x.path: x.value for x in r.leaves} for r in got} == {k: merge.fold(h) for k, h in history.items()}
        assert {tuple(r) for r in versions.opened(spark, tables["links"]).collect()} == held


def test_snapshot_has_no_exchange_and_odd_writes_do_nothing(spark):
    root = fresh(spark, "snapshot")
    tables = upsert.empty(spark, root, 3)
    write = lambda rows: spark.createDataFrame(rows, WRITES)
    none = spark.createDataFrame([], LEAVES), spark.createDataFrame([], LINKS)
    tables, told = upsert.upsert(spark, root, tables, write([("a", 1, 5, None, True), (None, 2, 5, 1, True), ("b", None, 5, 1, True)]), *none)
    assert sorted(map(tuple, told.collect()), key=repr) == [("a", 1, True, False, 0, 0, None), ("b", None, False, False, 0, 0, "no record or seq"), (None, 2, False, False, 0, 0, "no record or seq")]
    same, told = upsert.upsert(spark, root, tables, write([]), *none)
    assert told.count() == 0
    assert [tuple(r) for r in versions.opened(spark, same["records"]).collect()] == [("a", 5, 5, None, None, [])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        records = versions.opened(spark, tables["records"])
        plan = upsert.touched(records, write([("a", 2, 6, 1, True)]), 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan
    scan = plan[: plan.index("Bucketed: true")].splitlines()
    join = max(i for i, line in enumerate(scan) if "Join" in line)
    assert not any("Exchange" in line for line in scan[join:])  # between the join and the snapshot's scan
