"""Predicates on columns and over the property index, against the evaluation of whole documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import jsonwalk
from orrery.operators import properties, propertyindex

DOCS = [
    {"p": 443, "q": {"r": "443", "s": None}, "list": list(range(600))},
    {f"f{k:03}": k for k in range(600)} | {"z": {"deep": 1}},
    {"long": "é" * 513, "p": "é" * 513},
    {"k" * 1024: 1, "k" * 1025: 2, "p": 443.0},
    {"p": 9007199254740993, "q": {"r": 443.5}},
    {"p": None, "q": {"r": True}},
    {"p": True, "list": [{"r": 1}, {"r": 2}]},
    {"p": {"r": 1}, "list": {}},
    {"p": [1, 2], "q": 5, "": 7, "a/b": {"c~d": 1}, "1": "one"},
    {"p": -(1 << 63), "q": {"r": 1e300}, "it's \"both\"": "x"},
    {"p": 10**30, "q": {"r": 0.1}},
    {},
]
PATHS = ["/p", "/q/r", "/q", "/list/599", "/list/1/r", "/long", "/" + "k" * 1024, "/" + "k" * 1025, "/f599", "/z/deep", "/none", "/", "/a~1b/c~0d", "/1", "/it's \"both\"", ""]
LEAVES = [
    ("eq", 443), ("eq", "443"), ("eq", 443.0), ("eq", None), ("eq", True), ("eq", 9007199254740992.0), ("eq", 9007199254740993), ("ne", 443), ("ne", "x"), ("in", [1, "one", None, 599]), ("exists", True), ("exists", False),
    ("gt", 442.5), ("gte", 9007199254740992.0), ("gt", 9007199254740992.0), ("lt", 9007199254740993), ("lte", 9007199254740992.0), ("lt", 1e308), ("gt", -1e308), ("gte", 10**30), ("gt", "z"), ("lte", "é"), ("lt", 10**400), ("gt", 0.1), ("gte", 0.1),
]


@pytest.fixture(scope="module")
def held(spark):
    texts = [*map(json.dumps, DOCS), '{"p": NaN}', "no json", None, "[" * 300000 + "]" * 300000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, d string")
    rows, coverage = propertyindex.build(docs, "id", "d", ["/z/deep"])
    return docs, rows, coverage


def wanted(node):
    return {i for i, d in enumerate(DOCS) if jsonwalk.matches(d, node)}


@pytest.mark.parametrize("path", PATHS)
def test_every_leaf_over_the_index(held, path):
    _, rows, coverage = held
    nodes = {f"t{k}": {"op": op, "path": path, "value": value} for k, (op, value) in enumerate(LEAVES)}
    got = propertyindex.truths(nodes, rows, coverage).collect()
    assert len(got) == len(DOCS) + 4
    for name, node in nodes.items():
        want = wanted(node)
        for r in got:
            assert r[name] in (None, r.owner in want), (node["op"], str(node["value"])[:30], r.owner)
            assert r[name] is not None or r.owner in (0, 1, 2, 3), (node, r.owner)


def random_tree(rng, depth=0):
    if depth < 3 and rng.random() < 0.5:
        return {rng.choice(["all", "any"]): [random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 4))]}
    op, value = rng.choice(LEAVES)
    return {"op": op, "path": rng.choice(PATHS), "value": value}


def test_trees_over_the_index(held):
    docs, rows, coverage = held
    rng = random.Random(2)
    for _ in range(12):
        node = random_tree(rng)
        assert {r.owner for r in propertyindex.search(node, rows, coverage, docs, "id", "d").collect()} == wanted(node), node


def test_only_unknown_documents_are_parsed(held):
    docs, rows, coverage = held
    parsed = lambda node: {(r.owner, r.parsed) for r in propertyindex.search(node, rows, coverage, docs, "id", "d").collect()}
    assert parsed({"op": "eq", "path": "/list/599", "value": 599}) == {(0, True)}
    assert parsed({"op": "eq", "path": "/p", "value": 443}) == {(0, False), (3, False)}
    assert parsed({"op": "eq", "path": "/z/deep", "value": 1}) == {(1, False)}
    plan = propertyindex.truths({"t": {"op": "eq", "path": "/p", "value": 443}}, rows, coverage)._jdf.queryExecution().executedPlan().toString()
    assert any("PushedFilters" in line and "/p" in line for line in plan.split("\n"))


def test_columns_compare_exactly(spark):
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "id int, d string").withColumn("v", F.parse_json("d"))
    own = [(p, op, v) for p in ("/p", "/q/r", "/a~1b/c~0d", "/1") for op, v in LEAVES]
    columns = [properties.predicate(F.col("v"), op, p, v).alias(f"c{k}") for k, (p, op, v) in enumerate(own)]
    for lo in range(0, len(own), 25):
        for r in docs.select("id", *columns[lo : lo + 25]).collect():
            for k in range(lo, min(lo + 25, len(own))):
                path, op, value = own[k]
                assert r[f"c{k}"] == (r.id in wanted({"op": op, "path": path, "value": value})), (own[k], r.id)


def test_refused_trees():
    leaf = {"op": "eq", "path": "/a", "value": 1}
    deep = leaf
    for _ in range(4):
        deep = {"all": [deep]}
    assert properties.checked(deep) and properties.checked({"any": [leaf] * 32})
    for bad in (
        {"all": [deep]}, {"any": [leaf] * 33}, {"all": []}, {"all": [leaf], "any": [leaf]}, {**leaf, "op": "like"}, {**leaf, "path": "a"}, {**leaf, "path": "/~2"}, {**leaf, "path": 5}, {**leaf, "value": [1]}, {**leaf, "op": "in"},
        {**leaf, "op": "in", "value": []}, {**leaf, "op": "in", "value": [1] * 101}, {**leaf, "op": "gt", "value": True}, {**leaf, "op": "gt", "value": None}, {**leaf, "op": "exists", "value": 1}, {**leaf, "more": 1}, [leaf],
    ):
        with pytest.raises(ValueError):
            properties.checked(bad)


def test_what_is_no_json_stops_nothing(spark):
    from orrery.functions import grammar
    from orrery.operators import mapping

    rows = spark.createDataFrame([(1, '{"a": NaN}'), (2, "{"), (3, None), (4, '{"a": [1, {"secret": "x"}]}')], "id bigint, d string")
    assert {r.owner for r in jsonwalk.exploded(rows, "id", "d").collect()} == {4}
    got = {r.owner: (r.document, r.secrets) for r in mapping.redacted(rows, "id", "d", ["a[].secret"]).collect()}
    assert got[1] == got[2] == got[3] == (None, []) and got[4][1] == ["x"]
    told = spark.createDataFrame([("true",), ("maybe",), (None,)], "v string").select(grammar.valid("boolean", F.col("v")).alias("ok")).collect()
    assert [r.ok for r in told] == [True, False, False]
