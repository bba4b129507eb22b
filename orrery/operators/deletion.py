"""Deleting records: who may go, and what goes with them.

Tables: nodes (id, type, lifecycle, ownership, authorization, override), relations (id, type, source_id, target_id, lifecycle), evidence (id, lifecycle),
node_links (node_id, evidence_id), relation_links (relation_id, evidence_id), and what is derived from records: sources (evidence_id, ...), properties (kind, owner_id, ...), texts (kind, owner_id, ...).

A request names ids of one kind.  Every id is looked at on its own, by joins of the request with the tables (the request is what is
shuffled or broadcast, by its size); one refused id refuses its whole request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.catalog import METHODS_OF_SCOPE

#: States that assert something, so that a node needs evidence for them (fixed values).
CLAIMS = {"ownership": ("owned", "dependency", "rejected"), "authorization": ("in_scope", "out_of_scope"), "override": ("in_scope", "out_of_scope")}
KINDS = ("nodes", "relations", "evidence")


def claims(prefix: str = "") -> Column:
    """Whether a node asserts ownership or authorization."""
    out = F.lit(False)
    for name, values in CLAIMS.items():
        out = out | F.coalesce(F.col(f"{prefix}{name}").isin(*values), F.lit(False))
    return out


def _among(asked: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """asked with a flag of this name: whether its request and id are in found (request, id)."""
    return asked.join(found.select("request", "id").distinct().withColumn(name, F.lit(True)), ["request", "id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def admission(asked: DataFrame, kind: str, tables: dict[str, DataFrame], cascade: bool) -> DataFrame:
    """asked (request, id) of one kind -> request, id, reason (null where the id may go), accepted (whether the request goes, as no id of it is refused).

    missing: no such record; pending: it is being deleted; scoped child: a node has children in its scope, or a relation holds a
    child that is there, and the child has to go first, cascade or not; dependencies: without cascade, anything is tied to it; last evidence: without these
    pieces of evidence (all of the request) a node that asserts something would have none that is ready.
    """
    if kind not in KINDS:
        raise ValueError(f"kinds are {', '.join(KINDS)}")
    ids, scope = asked.select("request", "id").distinct(), list(METHODS_OF_SCOPE.values())
    relations, node_links, relation_links = tables["relations"], tables["node_links"], tables["relation_links"]
    told = ids.join(tables[kind].select("id", "lifecycle"), "id", "left")
    tied_by = lambda table, column: ids.join(table.select(F.col(column).alias("id")), "id")
    none = ids.limit(0)
    orphans, bare = none, none
    if kind == "nodes":
        orphans = tied_by(relations.where(F.col("type").isin(*scope)), "source_id")
        tied = tied_by(relations, "source_id").unionByName(tied_by(relations, "target_id")).unionByName(tied_by(node_links, "node_id"))
    elif kind == "relations":
        held = relations.where(F.col("type").isin(*scope)).join(tables["nodes"].select(F.col("id").alias("target_id")), "target_id", "left_semi")
        orphans, tied = tied_by(held, "id"), tied_by(relation_links, "relation_id")
    else:
        tied = tied_by(node_links, "evidence_id").unionByName(tied_by(relation_links, "evidence_id"))
        holders = tables["nodes"].where((F.col("lifecycle") == "ready") & claims()).select(F.col("id").alias("node_id"))
        touched = ids.withColumnRenamed("id", "evidence_id").join(node_links, "evidence_id").join(holders, "node_id", "left_semi")
        ready = tables["evidence"].where("lifecycle = 'ready'").select(F.col("id").alias("evidence_id"))
        others = node_links.join(touched.select("request", "node_id").distinct(), "node_id").join(ready, "evidence_id", "left_semi")
        left = others.join(ids.withColumnRenamed("id", "evidence_id"), ["request", "evidence_id"], "left_anti").select("request", "node_id").distinct()
        bare = touched.join(left, ["request", "node_id"], "left_anti").select("request", F.col("evidence_id").alias("id"))
    for name, found in (("orphans", orphans), ("tied", tied if not cascade else none), ("bare", bare)):
        told = _among(told, found, name)
    reason = F.when(F.col("lifecycle").isNull(), "missing").when(F.col("lifecycle") != "ready", "pending").when(F.col("orphans"), "scoped child").when(F.col("tied"), "dependencies").when(F.col("bare"), "last evidence")
    refused = told.select("request", "id", reason.alias("reason"))
    whole = refused.groupBy("request").agg((F.count("reason") == 0).alias("accepted"))
    return refused.join(whole, "request")


def deleted(accepted: DataFrame, kind: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the accepted records (id) of one kind and all that goes with them: a node's relations, and links, sources, index and text rows of whatever goes; neighbours stay."""
    gone = {k: accepted.select("id").distinct() if k == kind else accepted.select("id").limit(0) for k in KINDS}
    if kind == "nodes":
        incident = [tables["relations"].join(gone["nodes"].withColumnRenamed("id", end), end, "left_semi").select("id") for end in ("source_id", "target_id")]
        gone["relations"] = incident[0].union(incident[1]).distinct()
    without = lambda rows, column, ids: rows.join(ids.withColumnRenamed("id", column), column, "left_anti")
    out = {k: without(tables[k], "id", gone[k]) for k in KINDS}
    out["node_links"] = without(without(tables["node_links"], "node_id", gone["nodes"]), "evidence_id", gone["evidence"])
    out["relation_links"] = without(without(tables["relation_links"], "relation_id", gone["relations"]), "evidence_id", gone["evidence"])
    out["sources"] = without(tables["sources"], "evidence_id", gone["evidence"])
    owners = None
    for k in KINDS:
        own = gone[k].select(F.lit(k).alias("kind"), F.col("id").alias("owner_id"))
        owners = own if owners is None else owners.unionByName(own)
    return out | {name: tables[name].join(owners, ["kind", "owner_id"], "left_anti").select(*tables[name].columns) for name in ("properties", "texts")}
