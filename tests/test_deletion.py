"""Delete requests against plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import deletion
from orrery.operators.catalog import METHODS_OF_SCOPE

SCHEMAS = {
    "nodes": "id string, type string, lifecycle string, ownership string, authorization string, override string",
    "relations": "id string, type string, source_id string, target_id string, lifecycle string",
    "evidence": "id string, lifecycle string",
    "node_links": "node_id string, evidence_id string",
    "relation_links": "relation_id string, evidence_id string",
    "sources": "evidence_id string, source string",
    "properties": "kind string, owner_id string, path string",
    "texts": "kind string, owner_id string, text string",
}


@pytest.fixture(scope="module")
def data():
    rng = random.Random(21)
    life = lambda: "deleting" if rng.random() < 0.1 else "ready"
    scope = list(METHODS_OF_SCOPE.values())
    out = {
        "nodes": [(f"n{k}", "domain", life(), rng.choice([None, "owned", "candidate", "rejected"]), rng.choice([None, None, "in_scope"]), None) for k in range(40)],
        "relations": [(f"r{k}", rng.choice([scope[0], "cname_to", "cname_to", "cname_to"]), f"n{rng.randrange(20)}", f"n{rng.randrange(20, 44)}", life()) for k in range(30)],
        "evidence": [(f"e{k}", life()) for k in range(25)],
        "node_links": sorted({(f"n{rng.randrange(40)}", f"e{rng.randrange(20)}") for _ in range(35)}),
        "relation_links": sorted({(f"r{rng.randrange(30)}", f"e{rng.randrange(20)}") for _ in range(15)}),
        "sources": [(f"e{k}", "s") for k in range(25)],
    }
    owners = [(kind, row[0]) for kind in deletion.KINDS for row in out[kind]]
    return out | {"properties": [(*o, "/a") for o in owners], "texts": [(*o, "t") for o in owners]}


@pytest.fixture(scope="module")
def tables(spark, data):
    return {name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in data.items()}


def plain(data, kind, ids, cascade):
    life = {row[0]: row[2] if kind == "nodes" else row[4] if kind == "relations" else row[1] for row in data[kind]}
    ready = {e for e, state in data["evidence"] if state == "ready"}
    scope, nodes = set(METHODS_OF_SCOPE.values()), {n[0]: n for n in data["nodes"]}
    out = {}
    for i in ids:
        rels = [r for r in data["relations"] if (i in r[2:4] if kind == "nodes" else r[0] == i)]
        links = [x for x in data["node_links"] if x[0 if kind == "nodes" else 1] == i] if kind != "relations" else []
        tied = (rels if kind == "nodes" else []) + links + ([x for x in data["relation_links"] if x[0 if kind == "relations" else 1] == i] if kind != "nodes" else [])
        child = any(r[1] in scope and (r[2] == i if kind == "nodes" else r[3] in nodes) for r in rels) if kind != "evidence" else False
        holds = lambda n: n in nodes and nodes[n][2] == "ready" and (nodes[n][3] in ("owned", "rejected") or nodes[n][4] == "in_scope")
        bare = kind == "evidence" and any(holds(n) and not any(m == n and e in ready and e not in ids for m, e in data["node_links"]) for n, _ in links)
        out[i] = "missing" if i not in life else "pending" if life[i] != "ready" else "scoped child" if child else "dependencies" if tied and not cascade else "last evidence" if bare else None
    return out


@pytest.mark.parametrize(("kind", "cascade"), [("nodes", True), ("nodes", False), ("relations", False), ("evidence", True), ("evidence", False)])
def test_admission(spark, data, tables, kind, cascade):
    rng = random.Random(3)
    requests = {k: {f"{kind[0]}{rng.randrange(44)}" for _ in range(rng.randrange(1, 5))} for k in range(40)}
    asked = spark.createDataFrame([(k, i) for k, ids in requests.items() for i in ids], "request bigint, id string")
    got = {(r.request, r.id): (r.reason, r.accepted) for r in deletion.admission(asked, kind, tables, cascade).collect()}
    want = {}
    for k, ids in requests.items():
        reasons = plain(data, kind, ids, cascade)
        want |= {(k, i): (reason, not any(reasons.values())) for i, reason in reasons.items()}
    assert got == want and len({r for r, _ in want.values()}) > 2


def test_what_goes_with_a_node(spark, data, tables):
    left = {k: {tuple(r) for r in v.select(*tables[k].columns).collect()} for k, v in deletion.deleted(spark.createDataFrame([("n3",), ("n25",)], "id string"), "nodes", tables).items()}
    gone = {"n3", "n25"}
    lost = {r[0] for r in data["relations"] if gone & set(r[2:4])}
    assert left["nodes"] == {n for n in data["nodes"] if n[0] not in gone} and left["relations"] == {r for r in data["relations"] if r[0] not in lost} and left["evidence"] == set(data["evidence"])
    assert left["node_links"] == {x for x in data["node_links"] if x[0] not in gone} and left["relation_links"] == {x for x in data["relation_links"] if x[0] not in lost}
    assert all(left[t] == {x for x in data[t] if x[1] not in gone | lost} for t in ("properties", "texts")) and lost


def test_what_goes_with_evidence(spark, data, tables):
    left = {k: {tuple(r) for r in v.select(*tables[k].columns).collect()} for k, v in deletion.deleted(spark.createDataFrame([("e1",)], "id string"), "evidence", tables).items()}
    assert left["nodes"] == set(data["nodes"]) and left["relations"] == set(data["relations"])
    assert all(left[t] == {x for x in data[t] if "e1" not in x} for t in ("evidence", "node_links", "relation_links", "sources", "properties", "texts"))
    with pytest.raises(ValueError):
        deletion.admission(spark.range(1).select(F.lit(1).alias("request"), F.lit("x").alias("id")), "files", tables, True)
