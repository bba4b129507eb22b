"""Breadth-first traversal over relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.storage import fresh


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """edges (ord, source_id, target_id) as (ord, owner, far)."""
    out = edges.select("ord", F.col("source_id").alias("owner"), F.col("target_id").alias("far"))
    into = edges.select("ord", F.col("target_id").alias("owner"), F.col("source_id").alias("far"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", types: tuple[str, ...] = (), ready: DataFrame | None = None) -> DataFrame:
    """node_id and level of all nodes within depth steps of the seeds (node_id): one join and one anti-join for each level.

    types: the relation types (column type of edges) to follow, all without any; ready: the nodes (node_id) that may be
    entered.  Each level but the last is written down, so the plan does not grow with the depth.
    """
    if types:
        edges = edges.where(F.col("type").isin(*types))
    ways = directed(edges, direction).select("owner", "far")
    if ready is not None:
        ways = ways.join(ready.select(F.col("node_id").alias("far")).distinct(), "far", "left_semi")
    seen = seeds.select("node_id").distinct().withColumn("level", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        new = frontier.select(F.col("node_id").alias("owner")).join(ways, "owner").select(F.col("far").alias("node_id")).distinct()
        frontier = new.join(seen, "node_id", "left_anti").withColumn("level", F.lit(level))
        if level < depth:
            path = fresh(edges.sparkSession, "level")
            frontier.write.parquet(path)
            frontier = edges.sparkSession.read.parquet(path)
        seen = seen.unionByName(frontier)
    return seen


def bounded(edges: DataFrame, seeds: list, depth: int, max_nodes: int, max_edges: int, direction: str = "both") -> dict:
    """A traversal that stops at the first edge beyond a budget, in the order of (owner's discovery, ord).

    Returns the tables nodes (place, node_id, level) and edges (place, ord) in the order of discovery, frontier (place, node_id: what was not
    expanded to its end), and truncated and reason.  A level is one pass: its edges are numbered by two prefix sums, over owners (no more than max_nodes) and
    inside each owner's first max_edges + 1, with the distinct new nodes counted along; the least number that breaks a budget ends
    it.  What is broadcast (nodes and edges so far) is bounded by the budgets; the driver sees a level's counts only.
    """
    spark, ways = edges.sparkSession, directed(edges, direction)
    kind = edges.schema["source_id"].dataType.simpleString()
    first = list(dict.fromkeys(seeds))
    nodes = spark.createDataFrame(list(enumerate(first)), f"place bigint, node_id {kind}").withColumn("level", F.lit(0))
    taken = spark.createDataFrame([], "place bigint, ord bigint")
    n_nodes, n_edges, reason, frontier = len(first), 0, None, nodes.limit(0).select("place", "node_id")
    for level in range(depth):
        owners = nodes.where(F.col("level") == level).select("place", F.col("node_id").alias("owner"))
        found = ways.join(F.broadcast(owners), "owner").join(F.broadcast(taken.select("ord")), "ord", "left_anti")
        once = found.groupBy("ord").agg(F.min(F.struct("place", "far")).alias("w")).select("ord", "w.place", "w.far")
        fresh_far = once.join(F.broadcast(nodes.select(F.col("node_id").alias("far"))), "far", "left_anti")
        debut = fresh_far.groupBy("far").agg(F.min(F.struct("place", "ord")).alias("d")).select(F.col("d.ord").alias("ord"), F.lit(1).alias("new"))
        marked = once.join(debut, "ord", "left").withColumn("new", F.coalesce("new", F.lit(0)))
        sums = marked.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("n_new"))
        before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # one row an owner
        sums = sums.select("place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("edges_before"), F.coalesce(F.sum("n_new").over(before), F.lit(0)).alias("new_before"))
        inside = Window.partitionBy("place").orderBy("ord")
        few = marked.withColumn("k", F.row_number().over(inside)).where(F.col("k") <= max_edges + 1)
        few = few.withColumn("new_k", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(sums), "place").where(F.col("edges_before") <= max_edges)
        number, discovered = F.col("edges_before") + F.col("k"), F.col("new_before") + F.col("new_k")
        why = F.when(number + n_edges > max_edges, "max_edges").when((F.col("new") == 1) & (discovered + n_nodes > max_nodes), "max_nodes")
        path = fresh(spark, "level")
        few.select("place", "ord", "far", "new", number.alias("number"), discovered.alias("discovered"), why.alias("why")).where(F.col("number") <= max_edges + 1).write.parquet(path)
        rows = spark.read.parquet(path)
        stop = rows.where("why is not null").agg(F.min(F.struct("number", "why", "place")).alias("s")).first()["s"]
        good = rows.where(F.col("number") < stop["number"]) if stop else rows
        new = good.where("new = 1").select((F.col("discovered") + (n_nodes - 1)).alias("place"), F.col("far").alias("node_id"), F.lit(level + 1).alias("level"))
        nodes, taken = nodes.unionByName(new), taken.unionByName(good.select((F.col("number") + (n_edges - 1)).alias("place"), "ord"))
        if stop:
            reason = stop["why"]
            frontier = nodes.where((F.col("place") >= stop["place"]) & (F.col("level") < depth)).select("place", "node_id")
            break
        added = good.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("new"), F.lit(0)).alias("m")).first()
        n_edges, n_nodes = n_edges + added["n"], n_nodes + added["m"]
        if not added["m"]:
            break
    return {"nodes": nodes, "edges": taken, "truncated": reason is not None, "reason": reason, "frontier": frontier}


def alias_hop(relations: DataFrame, seeds: DataFrame, over: str, back: str) -> DataFrame:
    """From seeds (node_id) along `over`, then against `back`: node_id of the affected."""
    first = seeds.select(F.col("node_id").alias("source_id")).join(relations.where(F.col("type") == over), "source_id").select(F.col("target_id").alias("node_id"))
    pivots = first.union(seeds.select("node_id")).distinct()
    return pivots.select(F.col("node_id").alias("target_id")).join(relations.where(F.col("type") == back), "target_id").select(F.col("source_id").alias("node_id")).distinct()
