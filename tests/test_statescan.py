"""Requests to records' state, against going through them one by one."""

import random

import pytest

from orrery.operators import statescan

ALL = ["owned", "candidate", "dependency", "rejected"]
SCHEMA = "record string, seq long, by_id boolean, ownership string, authorization string, allowlist boolean, evidenced boolean, allowed array<string>"


def one_request(now, r):
    """State after a request, and whether it was refused."""
    _, _, by_id, ownership, authorization, allowlist, evidenced, allowed = r
    o, a, listed = now
    if o is None and by_id:
        return now, True
    if o is not None and not by_id:
        return now, False
    if o is None:
        if ownership is None:
            return now, True
        a = "unknown"
    if ownership is not None and (ownership not in ALL or ownership not in (ALL if allowed is None else allowed)):
        return now, True
    if authorization not in (None, "unknown", "in_scope", "out_of_scope"):
        return now, True
    if ownership is not None and ownership != o:
        if ownership == "rejected":
            if o != "candidate":
                return now, True
            a, listed = "unknown", False
        elif ownership == "candidate":
            if o == "rejected":
                return now, True
        elif not evidenced:
            return now, True
        o = ownership
    if authorization is not None and authorization != a:
        if o == "rejected" or (authorization != "unknown" and not evidenced):
            return now, True
        a = authorization
    if allowlist is not None and allowlist != listed:
        if not evidenced:
            return now, True
        listed = allowlist
    return (now, True) if listed and a != "in_scope" else ((o, a, listed), False)


def made(n, records, seed):
    pick = random.Random(seed)
    rows = []
    for seq in range(n):
        record = "hot" if pick.random() < 0.4 else f"r{pick.randrange(records)}"
        rows.append((record, seq, pick.random() < 0.8, pick.choice([None, *ALL, "candidate", "owner"]), pick.choice([None, None, "unknown", "in_scope", "in_scope", "out_of_scope", "all"]),
                     pick.choice([None, None, True, False]), pick.random() < 0.7, pick.choice([None, None, ["owned", "candidate", "rejected"]])))
    return rows


@pytest.mark.parametrize("size", [3, 256])
def test_roots_as_one_by_one(spark, size):
    rows = made(900, 40, size)
    want, now = {}, {"r1": ("owned", "in_scope", True)}
    for r in rows:
        before = now.get(r[0], (None, None, False))
        now[r[0]], refused = one_request(before, r)
        want[r[1]] = (before, now[r[0]], refused)
    shuffled = random.Random(1).sample(rows, len(rows))
    snapshot = spark.createDataFrame([("r1", "owned", "in_scope", True), ("elsewhere", "owned", "unknown", False)], "record string, ownership string, authorization string, allowlist boolean")
    got = statescan.root_requests(spark.createDataFrame(shuffled, SCHEMA).repartition(5), snapshot, size).collect()
    assert len(got) == len(rows)
    assert {r.seq: (tuple(r.before), tuple(r.after), r.reason is not None) for r in got} == want


def test_requests_without_place_and_none_at_all(spark):
    rows = [(None, 1, False, "candidate", None, None, None, None), ("a", None, False, "candidate", None, None, None, None), ("a", 1, None, "owned", None, None, None, None)]
    got = {(r.record, r.seq): (r.after and r.after.ownership, r.reason) for r in statescan.root_requests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(None, 1): (None, "no record or seq"), ("a", None): (None, "no record or seq"), ("a", 1): (None, "evidence required")}
    assert statescan.root_requests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_children_meet_their_root_as_it_is_then(spark):
    marks = [("root", 1, True), ("root", 5, False), ("other", 2, False)]
    child = "record string, root string, seq long, by_id boolean, ownership string, authorization string, allowlist boolean, evidenced boolean"
    rows = [
        ("c", "root", 0, True, None, "in_scope", None, True),  # the root has no allowlist yet
        ("c", "root", 1, True, None, "in_scope", None, False),  # no evidence
        ("c", "root", 2, True, None, "in_scope", None, True),
        ("c", "root", 3, False, None, "out_of_scope", None, True),  # found by identity
        ("c", "root", 6, True, None, "in_scope", None, False),  # as it is
        ("c", "root", 7, True, None, "unknown", None, False),
        ("c", "root", 8, True, None, "in_scope", None, True),  # the allowlist is gone
        ("c", "root", 9, True, "owned", None, None, True),
        ("c", "root", 10, True, None, None, True, True),
        ("d", None, 1, True, None, "out_of_scope", None, True),
    ]
    for size in (2, 256):
        got = statescan.child_requests(spark.createDataFrame(rows, child), spark.createDataFrame(marks, "record string, seq long, allowlist boolean"), size).collect()
        assert sorted((r.record, r.seq, r.before, r.after, r.reason) for r in got if r.record == "c") == [
            ("c", 0, None, None, "root has no allowlist"),
            ("c", 1, None, None, "evidence required"),
            ("c", 2, None, "in_scope", None),
            ("c", 3, "in_scope", "in_scope", None),
            ("c", 6, "in_scope", "in_scope", None),
            ("c", 7, "in_scope", None, None),
            ("c", 8, None, None, "root has no allowlist"),
            ("c", 9, None, None, "ownership is inherited"),
            ("c", 10, None, None, "allowlist is inherited"),
        ]
        assert [(r.after, r.root_listed) for r in got if r.record == "d"] == [("out_of_scope", False)]
