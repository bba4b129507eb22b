"""The property index as a search path: typed rows by path, and predicate trees answered from them.

`build` writes two tables.  `rows` has one row for each path that the index keeps of a document (containers too): owner, path, kind, whether the value is
there, and the value as text, decimal or double; its files are sorted by path, so that a search reads the row groups of its own paths.  `coverage` has one
row a document: how many paths it has and keeps, whether all, or all outside arrays, are kept.

`search` reads the rows of the tree's paths and of the paths above them, pivots them to one row a document, and evaluates the tree in three-valued
logic: a path that is there compares; one that is missing is false where coverage is complete, where a scalar stands above it, or where everything outside
arrays is kept and no array stands above it; otherwise it is unknown.  Only documents whose tree stays unknown are parsed.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import jsonwalk
from orrery.operators.properties import BUDGET, LONGEST_PATH, LONGEST_VALUE, TESTS, checked, real_test, whole_test
from orrery.sources.storage import fresh

_ROW = "struct<path:string,kind:string,materialized:boolean,text:string,whole:decimal(38,0),real:double>"
_INDEX = f"owner bigint, rows array<{_ROW}>, total_paths bigint, indexed_paths bigint, omitted_values bigint, paths_complete boolean, non_array_complete boolean, sound boolean"
#: Bytes of UTF-8 of a document's paths and values decide what is kept, so this is one document's work.
_KINDS = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("materialized", pa.bool_()), ("text", pa.string()), ("whole", pa.decimal128(38, 0)), ("real", pa.float64())]))


def _row(path: str, value) -> dict:
    kind = jsonwalk.kind_of(value)
    out = {"path": path, "kind": kind, "materialized": True, "text": None, "whole": None, "real": None}
    if kind == "string":
        out["materialized"] = len(value.encode("utf-8", "surrogatepass")) <= LONGEST_VALUE
        out["text"] = value if out["materialized"] else None
    elif kind == "boolean":
        out["text"] = "true" if value else "false"
    elif isinstance(value, float):
        out["real"] = value
    elif kind == "number":
        if abs(value) < 10**38:
            out["whole"] = Decimal(value)
        else:
            out["materialized"] = False
    return out


def _project(value, required: frozenset[str], budget: int) -> tuple:
    found = list(jsonwalk.nodes(value))
    size = {at: len(at.encode("utf-8", "surrogatepass")) for at, *_ in found}
    fits = [x for x in found if size[x[0]] <= LONGEST_PATH]
    fits.sort(key=lambda x: (0 if x[0] in required else 2 if x[2] else 1, x[0].encode("utf-8", "surrogatepass")))
    kept = fits[:budget]
    have = {at for at, *_ in kept}
    rows = [_row(at, v) for at, v, _ in kept]
    return rows, len(found), len(rows), sum(not r["materialized"] for r in rows), len(rows) == len(found), all(at in have for at, _, inside in found if not inside)


def projected(documents: DataFrame, owner: str, document: str, required: list[str] | None = None, budget: int = BUDGET) -> DataFrame:
    """owner, rows and coverage of each document: required paths first, then paths outside arrays, then the rest; what is no JSON has no rows and is not sound."""
    wanted = frozenset(required or ())

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                sound, value = jsonwalk.parsed(text)
                out.append((*_project(value, wanted, budget), True) if sound else ([], 0, 0, 0, False, False, False))
            rows, *rest = zip(*out) if out else ([],) * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _KINDS), *(pa.array(c, t) for c, t in zip(rest, kinds))], [c.split()[0] for c in _INDEX.replace(f"array<{_ROW}>", "x").split(", ")])

    return documents.selectExpr(f"cast({owner} as bigint) as owner", f"{document} as document").mapInArrow(run, _INDEX)


def build(documents: DataFrame, owner: str, document: str, required: list[str] | None = None, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(rows, coverage), both written; the documents are parsed once."""
    spark = documents.sparkSession
    whole, rows = fresh(spark, "projected"), fresh(spark, "index")
    projected(documents, owner, document, required, budget).write.parquet(whole)
    made = spark.read.parquet(whole)
    made.select("owner", F.explode("rows").alias("row")).select("owner", "row.*").sortWithinPartitions("path").write.parquet(rows)
    return spark.read.parquet(rows), made.drop("rows")


def _leaves(node: dict) -> list[dict]:
    return [x for m in node.get("all", node.get("any")) for x in _leaves(m)] if "all" in node or "any" in node else [node]


def _above(path: str) -> list[str]:
    steps = path.split("/")
    return ["/".join(steps[:k]) for k in range(2, len(steps))]


def _told(op: str, wanted) -> Column:
    """The predicate on the row of its path: true, false, or null where the value is not in the index."""
    if op == "exists":
        return F.lit(wanted is not False)
    if op == "in":
        out = F.lit(False)
        for w in wanted:
            out = out | _told("eq", w)
        return out
    if op == "ne":
        return ~_told("eq", wanted)
    kind = jsonwalk.kind_of(wanted)
    if kind == "number":
        value = F.when(F.col("whole").isNotNull(), whole_test(op, wanted)(F.col("whole"))).when(F.col("real").isNotNull(), real_test(op, wanted)(F.col("real")))
    elif kind == "null":
        value = F.lit(op == "eq")
    elif kind == "boolean":
        value = (F.col("text") == ("true" if wanted else "false")) if op == "eq" else F.lit(False)
    else:
        value = F.when(F.col("materialized"), TESTS[op](F.col("text"), F.lit(wanted)))
    return F.when(F.col("kind") != kind, F.lit(False)).otherwise(value)


def truths(nodes: dict[str, dict], rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """owner and a column for each named tree, all from one pass: true, false, or null where the index cannot tell."""
    leaves = [leaf for node in nodes.values() for leaf in _leaves(checked(node))]
    paths = sorted({p for leaf in leaves for p in (leaf["path"], *_above(leaf["path"]))})
    own = rows.where(F.col("path").isin(*paths)) if paths else rows.limit(0)
    pivot = []
    for k, leaf in enumerate(leaves):
        here, above = F.col("path") == leaf["path"], F.col("path").isin(*_above(leaf["path"])) if _above(leaf["path"]) else F.lit(False)
        pivot += [
            F.max(F.when(here, F.struct(_told(leaf["op"], leaf.get("value")).alias("v")))).alias(f"p{k}"),
            F.max(above & ~F.col("kind").isin("object", "array")).alias(f"s{k}"),
            F.max(above & (F.col("kind") == "array")).alias(f"a{k}"),
        ]
    both = coverage.join(own.groupBy("owner").agg(*pivot), "owner", "left")

    def leaf_truth(k: int, leaf: dict) -> Column:
        absent = F.lit(leaf["op"] == "exists" and leaf.get("value") is False)
        if not leaf["path"]:  # the document itself is there
            return F.lit(leaf.get("value") is not False) if leaf["op"] == "exists" else F.lit(leaf["op"] == "ne") if leaf["op"] in ("eq", "ne", "in") else F.lit(False)
        sure = F.coalesce(F.col(f"s{k}"), F.lit(False)) | F.col("paths_complete") | F.col("non_array_complete") & ~F.coalesce(F.col(f"a{k}"), F.lit(False))
        return F.when(F.col(f"p{k}").isNotNull(), F.col(f"p{k}.v")).when(sure, absent)

    numbered = iter(range(len(leaves)))

    def compiled(one: dict) -> Column:
        if "all" not in one and "any" not in one:
            return leaf_truth(next(numbered), one)
        out, *rest = [compiled(m) for m in one.get("all", one.get("any"))]
        for r in rest:
            out = out & r if "all" in one else out | r
        return out

    return both.select("owner", *[(F.col("sound") & compiled(node)).alias(name) for name, node in nodes.items()])


def search(node: dict, rows: DataFrame, coverage: DataFrame, documents: DataFrame, owner: str, document: str) -> DataFrame:
    """Owners whose document fulfils the tree (owner, parsed: whether the document was needed); documents that are no JSON fulfil none."""
    told = truths({"truth": node}, rows, coverage)
    unknown = told.where("truth is null").select("owner")

    def run(batches):
        for batch in batches:
            hit = [sound and jsonwalk.matches(value, node) for sound, value in map(jsonwalk.parsed, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], ["owner"])

    left = documents.selectExpr(f"cast({owner} as bigint) as owner", f"{document} as document").join(unknown, "owner", "left_semi").mapInArrow(run, "owner bigint")
    return told.where("truth").select("owner", F.lit(False).alias("parsed")).unionByName(left.withColumn("parsed", F.lit(True)))
