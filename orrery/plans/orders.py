"""Queries on customers, orders and lines as a scope chain with state, on orders as a job log, and on parts and suppliers as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import transforms
from orrery.operators import deletion, inventory, relationchecks, reports, state, statescan, traverse, validation
from orrery.plans.book import query, table

_N = """
nodes AS (
  SELECT 'c' || c_custkey AS node_id, NULL AS parent_id, true AS carrying,
         CASE c_custkey % 4 WHEN 0 THEN 'owned' WHEN 1 THEN 'candidate' WHEN 2 THEN 'dependency' ELSE 'rejected' END AS ownership,
         CASE c_custkey % 3 WHEN 0 THEN 'in_scope' WHEN 1 THEN 'unknown' ELSE 'out_of_scope' END AS authorization_,
         c_custkey % 5 = 0 AS allowlist, NULL AS override FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, false, NULL, NULL, NULL, CASE WHEN o_orderstatus = 'F' THEN 'out_of_scope' END FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber, 'o' || l_orderkey, false, NULL, NULL, NULL, CASE WHEN l_returnflag = 'A' THEN 'in_scope' END FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)
),
member AS (
  SELECT node_id, node_id AS member FROM nodes
  UNION ALL SELECT n.node_id, n.parent_id FROM nodes n WHERE NOT n.carrying AND n.parent_id IS NOT NULL
  UNION ALL SELECT n.node_id, p.parent_id FROM nodes n JOIN nodes p ON n.parent_id = p.node_id WHERE NOT n.carrying AND NOT p.carrying
),
root AS (SELECT m.node_id, m.member AS root_id FROM member m JOIN nodes n ON m.member = n.node_id WHERE n.carrying),
said AS (SELECT m.node_id, bool_or(n.override = 'out_of_scope') AS narrowed, bool_or(n.override = 'in_scope') AS widened
         FROM member m JOIN nodes n ON m.member = n.node_id WHERE n.override IS NOT NULL GROUP BY m.node_id),
eff AS (
  SELECT n.node_id, CASE WHEN r.root_id <> n.node_id THEN r.root_id END AS state_root_id, q.ownership,
    CASE WHEN coalesce(s.narrowed, false) OR q.authorization_ = 'out_of_scope' THEN 'out_of_scope'
         WHEN q.allowlist AND n.node_id <> r.root_id THEN CASE WHEN coalesce(s.widened, false) THEN 'in_scope' ELSE 'unknown' END
         ELSE q.authorization_ END AS "authorization"
  FROM nodes n LEFT JOIN root r ON n.node_id = r.node_id LEFT JOIN nodes q ON r.root_id = q.node_id LEFT JOIN said s ON n.node_id = s.node_id
)
"""


def _nodes(spark, sf_dir) -> DataFrame:
    c, o, ln = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    pick = lambda column, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (column % len(names) + 1).cast("int"))
    text = lambda: F.lit(None).cast("string")
    customers = c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), text().alias("parent_id"), F.lit(True).alias("carrying"),
        pick(F.col("c_custkey"), "owned", "candidate", "dependency", "rejected").alias("ownership"), pick(F.col("c_custkey"), "in_scope", "unknown", "out_of_scope").alias("authorization"),
        (F.col("c_custkey") % 5 == 0).alias("allowlist"), text().alias("override"),
    )
    orders = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit(False), text(), text(), F.lit(None).cast("boolean"), F.when(F.col("o_orderstatus") == "F", "out_of_scope"))
    lines = ln.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    lines = lines.select(F.concat(F.lit("l"), F.concat_ws("-", "l_orderkey", "l_linenumber")), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.lit(False), text(), text(), F.lit(None).cast("boolean"), F.when(F.col("f") == "A", "in_scope"))
    return customers.union(orders).union(lines)


@query("N1_state_root", f"WITH {_N} SELECT n.node_id, r.root_id FROM nodes n LEFT JOIN root r ON n.node_id = r.node_id")
def n1(spark, sf_dir):
    return state.roots(_nodes(spark, sf_dir)).select("node_id", "root_id")


@query("N2_N4_effective_state", f"WITH {_N} SELECT * FROM eff")
def n2(spark, sf_dir):
    return state.effective(_nodes(spark, sf_dir))


@query("V33_default_state_filter", f"WITH {_N} SELECT node_id FROM eff WHERE ownership IS DISTINCT FROM 'rejected'")
def v33(spark, sf_dir):
    return state.effective(_nodes(spark, sf_dir)).where(state.shown(F.col("ownership"))).select("node_id")


_NEXT = """CASE WHEN state IS NOT DISTINCT FROM s THEN true WHEN s = 'rejected' THEN state IS NOT DISTINCT FROM 'candidate'
  WHEN s = 'candidate' THEN state IS DISTINCT FROM 'rejected' ELSE o_orderkey % 2 = 0 END"""


@query(
    "N5_ownership_transitions",
    f"""WITH RECURSIVE t AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i,
      CASE o_orderkey % 4 WHEN 0 THEN 'owned' WHEN 1 THEN 'candidate' WHEN 2 THEN 'dependency' ELSE 'rejected' END AS s FROM orders),
    g AS (
      SELECT *, NULL::VARCHAR AS before, {_NEXT} AS allowed FROM (SELECT *, NULL::VARCHAR AS state FROM t WHERE i = 1)
      UNION ALL
      SELECT o_orderkey, o_custkey, i, s, state, state AS before, {_NEXT} AS allowed
      FROM (SELECT t.*, CASE WHEN g.allowed THEN g.s ELSE g.before END AS state FROM g JOIN t ON t.o_custkey = g.o_custkey AND t.i = g.i + 1)
    ) SELECT o_orderkey, before, allowed FROM g""",
)
def n5(spark, sf_dir):
    s = F.element_at(F.array(*[F.lit(x) for x in ("owned", "candidate", "dependency", "rejected")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("seq"), s.alias("after"), (F.col("o_orderkey") % 2 == 0).alias("evidenced"))
    return statescan.accepted_transitions(rows).select(F.col("seq").alias("o_orderkey"), "before", "allowed")


@query("N7_rejection_projection", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'value' ELSE 'method,url' END AS kept, 'unknown' AS \"authorization\", false AS allowlist_scoped FROM supplier")
def n7(spark, sf_dir):
    k = F.col("s_suppkey")
    held = F.when(k % 2 == 0, F.create_map(F.lit("value"), F.col("s_name"), F.lit("wildcard"), F.lit("true"), F.lit("note"), F.lit("x"))).otherwise(
        F.create_map(F.lit("url"), F.col("s_name"), F.lit("method"), F.lit("GET"), F.lit("status"), F.lit("200"))
    )
    nodes = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 2 == 0, "domain").otherwise("endpoint").alias("type"), held.alias("properties"), F.lit("in_scope").alias("authorization"), F.lit(True).alias("allowlist_scoped"))
    left = state.rejected_projection(nodes)
    return left.select("s_suppkey", F.array_join(F.array_sort(F.map_keys("properties")), ",").alias("kept"), "authorization", "allowlist_scoped")


@query(
    "N6_authorization_rules",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'rejected' WHEN c_custkey % 3 = 0 THEN 'evidence required' WHEN c_custkey % 5 = 0 THEN 'allowlist needs in_scope' END AS reason FROM customer""",
)
def n6(spark, sf_dir):
    k = F.col("c_custkey")
    ownership = F.when(k % 4 == 3, "rejected").otherwise("owned")
    reason = state.authorization_reason(ownership, F.lit("unknown"), F.lit("out_of_scope"), k % 5 == 0, k % 5 == 0, k % 3 != 0)
    return table(spark, sf_dir, "customer").select("c_custkey", reason.alias("reason"))


def _scope(spark, sf_dir) -> DataFrame:
    rel = F.concat_ws(">", "parent_id", "node_id").alias("rel_id")
    kind = F.when(F.col("node_id").startswith("o"), "has_order").otherwise("has_line").alias("type")
    return _nodes(spark, sf_dir).where("parent_id is not null").select(rel, kind, F.col("parent_id").alias("source_id"), F.col("node_id").alias("target_id"))


_S = "rels AS (SELECT parent_id || '>' || node_id AS rel_id, CASE WHEN node_id LIKE 'o%' THEN 'has_order' ELSE 'has_line' END AS type, parent_id AS source_id, node_id AS target_id FROM nodes WHERE parent_id IS NOT NULL)"
_GONE = "gone AS (SELECT node_id FROM root WHERE root_id IN (SELECT node_id FROM nodes WHERE ownership = 'rejected'))"


@query("N7_N8_rejection_purge", f"WITH {_N}, {_S}, {_GONE} SELECT (SELECT count(*) FROM eff WHERE node_id NOT IN (SELECT node_id FROM gone) OR state_root_id IS NULL) AS nodes, (SELECT count(*) FROM rels WHERE source_id NOT IN (SELECT node_id FROM gone) AND target_id NOT IN (SELECT node_id FROM gone)) AS relations")
def n8(spark, sf_dir):
    nodes = state.effective(_nodes(spark, sf_dir))
    rejected = nodes.where("state_root_id is null and ownership = 'rejected'").select("node_id")
    left, rels = state.purge(nodes, _scope(spark, sf_dir), rejected)
    return left.agg(F.count(F.lit(1)).alias("nodes")).join(rels.agg(F.count(F.lit(1)).alias("relations")))


@query("N9_delete_admission", f"WITH {_N}, a AS (SELECT 'c' || (c_custkey * 2) AS node_id FROM customer) SELECT a.node_id, CASE WHEN n.node_id IS NULL THEN 'missing' WHEN a.node_id LIKE '%0' THEN 'pending' WHEN p.parent_id IS NOT NULL THEN 'has relations' END AS reason FROM a LEFT JOIN nodes n ON a.node_id = n.node_id LEFT JOIN (SELECT DISTINCT parent_id FROM nodes) p ON a.node_id = p.parent_id")
def n9(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).select("node_id", F.when(F.col("node_id").endswith("0"), "deleting").otherwise("ready").alias("lifecycle"))
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") * 2).cast("string")).alias("node_id"))
    return state.delete_reasons(asked, nodes, _scope(spark, sf_dir), cascade=False)


@query("N10_cascade_delete", f"WITH {_N}, {_S} SELECT type, count(*) AS n FROM rels WHERE source_id NOT LIKE '%7' AND target_id NOT LIKE '%7' GROUP BY type")
def n10(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    deleted = nodes.where(F.col("node_id").endswith("7")).select("node_id")
    rels, _ = state.cascade(_scope(spark, sf_dir), nodes.select("node_id", F.lit("e").alias("evidence_id")), deleted)
    return reports.counts(rels, "type")


@query(
    "N9_N10_delete_requests",
    """WITH ask AS (SELECT s_suppkey % 5 AS request, 's' || (s_suppkey * 2) AS id FROM supplier), ev AS (SELECT 's' || s_suppkey AS id, s_suppkey % 9 <> 0 AS ready FROM supplier),
    links AS (SELECT DISTINCT 'o' || l_orderkey AS node_id, 's' || l_suppkey AS evidence_id FROM lineitem), holders AS (SELECT 'o' || o_orderkey AS node_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 50 <> 0),
    touched AS (SELECT request, node_id, id FROM ask JOIN links ON evidence_id = id JOIN holders USING (node_id)),
    others AS (SELECT DISTINCT t.request, t.node_id FROM (SELECT DISTINCT request, node_id FROM touched) t JOIN links k USING (node_id) JOIN ev ON ev.id = k.evidence_id AND ready LEFT JOIN ask b ON b.request = t.request AND b.id = k.evidence_id WHERE b.id IS NULL),
    bare AS (SELECT DISTINCT request, id FROM touched t WHERE NOT EXISTS (SELECT 1 FROM others o WHERE o.request = t.request AND o.node_id = t.node_id)),
    told AS (SELECT a.request, a.id, CASE WHEN ev.id IS NULL THEN 'missing' WHEN NOT ready THEN 'pending' WHEN bare.id IS NOT NULL THEN 'last evidence' END AS reason
      FROM ask a LEFT JOIN ev ON ev.id = a.id LEFT JOIN bare ON bare.request = a.request AND bare.id = a.id)
    SELECT request, id, reason, count(reason) OVER (PARTITION BY request) = 0 AS accepted FROM told""",
)
def n9_requests(spark, sf_dir):
    """Requests to delete evidence: what is missing or pending, and what is the last ready evidence of a node that asserts something."""
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    suppliers, orders, lines = (table(spark, sf_dir, t) for t in ("supplier", "orders", "lineitem"))
    life = lambda gone: F.when(gone, "deleting").otherwise("ready").alias("lifecycle")
    none = F.lit(None).cast("string")
    tables = {
        "nodes": orders.select(name("o", "o_orderkey").alias("id"), F.lit("domain").alias("type"), life(F.col("o_orderkey") % 50 == 0), F.when(F.col("o_orderstatus") == "F", "owned").alias("ownership"), none.alias("authorization"), none.alias("override")),
        "relations": _scope(spark, sf_dir).withColumnRenamed("rel_id", "id"),
        "evidence": suppliers.select(name("s", "s_suppkey").alias("id"), life(F.col("s_suppkey") % 9 == 0)),
        "node_links": lines.select(name("o", "l_orderkey").alias("node_id"), name("s", "l_suppkey").alias("evidence_id")).distinct(),
        "relation_links": lines.limit(0).select(name("r", "l_orderkey").alias("relation_id"), name("s", "l_suppkey").alias("evidence_id")),
    }
    asked = suppliers.select((F.col("s_suppkey") % 5).alias("request"), F.concat(F.lit("s"), (F.col("s_suppkey") * 2).cast("string")).alias("id"))
    return deletion.admission(asked, "evidence", tables, cascade=True)


@query("N11_pending_relations", f"WITH {_N}, {_S} SELECT rel_id, CASE WHEN source_id LIKE '%3' THEN 'source' WHEN target_id LIKE '%3' THEN 'target' END AS blocker FROM rels")
def n11(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).select("node_id", F.when(F.col("node_id").endswith("3"), "deleting").otherwise("ready").alias("lifecycle"))
    return state.pending_relations(_scope(spark, sf_dir).withColumn("lifecycle", F.lit("ready")), nodes)


@query("V34_ready_visibility", f"WITH {_N}, {_S} SELECT rel_id FROM rels WHERE source_id NOT LIKE '%3' AND target_id NOT LIKE '%3'")
def v34(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).select("node_id", F.when(F.col("node_id").endswith("3"), "deleting").otherwise("ready").alias("lifecycle"))
    return state.ready_relations(_scope(spark, sf_dir).withColumn("lifecycle", F.lit("ready")), nodes).select("rel_id")


@query("J3_scope_relation_count", "WITH n AS (SELECT l_orderkey AS batch_id, l_linenumber AS node_index, count(*) FILTER (WHERE l_quantity > 10) AS n FROM lineitem GROUP BY ALL) SELECT * FROM n WHERE n <> 1")
def j3(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("node_index"), "l_quantity")
    return validation.scope_counts(lines.select("batch_id", "node_index").distinct(), lines.where("l_quantity > 10"))


@query("J1_resolve_references", "SELECT DISTINCT l_orderkey AS batch_id, l_linenumber AS node_index, CASE WHEN l_linenumber <= 3 THEN l_orderkey || '-' || l_linenumber END AS node_id FROM lineitem")
def j1(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("node_index")).distinct()
    nodes = lines.where("node_index <= 3").withColumn("node_id", F.concat_ws("-", "batch_id", "node_index"))
    return validation.resolve(lines.withColumn("id", F.lit(None).cast("string")), nodes).select("batch_id", "node_index", "node_id")


@query("J2_upsert_match", "SELECT c_custkey AS record, c_custkey % 2 = 1 AS created FROM customer WHERE c_custkey % 3 <> 0")
def j2(spark, sf_dir):
    from orrery.operators import merge

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"))
    return merge.acknowledge(c.where("record % 3 <> 0"), c.where("record % 2 = 0")).select("record", "created")


@query("J10_reliance_block", f"WITH {_N}, {_S} SELECT node_id FROM nodes WHERE node_id LIKE 'o%' AND node_id IN (SELECT r.target_id FROM rels r JOIN nodes n ON r.source_id = n.node_id WHERE n.ownership IN ('owned', 'dependency') AND r.type = 'has_order')")
def j10(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return validation.reliance_blocks(nodes.where("node_id like 'o%'").select("node_id"), _scope(spark, sf_dir), nodes.select("node_id", "ownership"), ("has_order",))


@query("J9_rejected_subtree", f"WITH {_N} SELECT node_id FROM eff WHERE state_root_id IS NOT NULL AND ownership = 'rejected'")
def j9(spark, sf_dir):
    return state.under_rejection(state.effective(_nodes(spark, sf_dir)))


@query("A11_job_counts", "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY ALL")
def a11(spark, sf_dir):
    return reports.counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "state"), "state")


@query(
    "W8_retention",
    """WITH j AS (SELECT o_orderkey AS job_id, o_orderstatus AS state, epoch_us(o_orderdate) AS f, o_orderkey % 17 = 0 AS p FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY state, p ORDER BY f DESC, job_id DESC) AS k FROM j)
    SELECT job_id, state, NOT p AND (f < 820454400000000 OR k > 500) AS prune FROM r""",
)
def w8(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("state"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("finished_us"), (F.col("o_orderkey") % 17 == 0).alias("protected"))
    return state.retained(jobs, 500, 820454400000000)


def _supply(spark, sf_dir) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    return pairs.select("ord", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target_id"))


_SUPPLY = "e AS (SELECT DISTINCT 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id FROM lineitem)"


@query(
    "G1_neighbors",
    f"""WITH {_SUPPLY}, l0 AS (SELECT DISTINCT source_id AS node_id FROM e WHERE source_id IN ('p1', 'p2', 'p3')),
    l1 AS (SELECT DISTINCT target_id AS node_id FROM e JOIN l0 ON source_id = node_id),
    l2 AS (SELECT DISTINCT source_id AS node_id FROM e JOIN l1 ON target_id = node_id WHERE source_id NOT IN (SELECT node_id FROM l0))
    SELECT node_id, 0 AS level FROM l0 UNION ALL SELECT node_id, 1 FROM l1 UNION ALL SELECT node_id, 2 FROM l2""",
)
def g1(spark, sf_dir):
    edges = _supply(spark, sf_dir)
    return traverse.reach(edges, edges.where("source_id in ('p1', 'p2', 'p3')").select(F.col("source_id").alias("node_id")), 2)


_G2_NODES, _G2_EDGES = 100, 300


def _g2_sql(levels: int = 3) -> str:
    """Level by level: edges in order, running counts of edges and of new nodes, and the least place that breaks a budget."""
    steps = """c{k} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY place, ord) AS i, far NOT IN (SELECT node_id FROM n{p}) AND row_number() OVER (PARTITION BY far ORDER BY place, ord) = 1 AS fresh
      FROM (SELECT ord, min(place) AS place, arg_min(far, place) AS far FROM (SELECT w.ord, n.place, w.far FROM n{p} n JOIN ways w ON w.owner = n.node_id WHERE n.level = {p} AND (SELECT why IS NULL FROM s{p}))
        WHERE ord NOT IN (SELECT ord FROM t{p}) GROUP BY ord)),
    r{k} AS MATERIALIZED (SELECT *, sum(fresh::INT) OVER (ORDER BY i) AS m, (SELECT count(*) FROM t{p}) AS e0, (SELECT count(*) FROM n{p}) AS n0 FROM c{k}),
    v{k} AS (SELECT min(i) AS i, arg_min(CASE WHEN e0 + i > {edges} THEN 'max_edges' ELSE 'max_nodes' END, i) AS why FROM r{k} WHERE e0 + i > {edges} OR fresh AND n0 + m > {nodes}),
    s{k} AS (SELECT coalesce((SELECT why FROM s{p}), (SELECT why FROM v{k})) AS why),
    g{k} AS (SELECT * FROM r{k} WHERE i < coalesce((SELECT i FROM v{k}), 1000000000)),
    n{k} AS MATERIALIZED (SELECT * FROM n{p} UNION ALL SELECT n0 + m - 1, far, {k} FROM g{k} WHERE fresh),
    t{k} AS MATERIALIZED (SELECT * FROM t{p} UNION ALL SELECT ord FROM g{k})"""
    made = ",\n".join(steps.format(k=k, p=k - 1, nodes=_G2_NODES, edges=_G2_EDGES) for k in range(1, levels + 1))
    return f"""WITH e AS (SELECT DISTINCT (l_suppkey * 7919 + l_partkey) % 1000003 * 10000000 + l_partkey AS ord, 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id FROM lineitem),
    ways AS MATERIALIZED (SELECT ord, source_id AS owner, target_id AS far FROM e UNION ALL SELECT ord, target_id, source_id FROM e),
    n0 AS (SELECT * FROM (VALUES (0::BIGINT, 'p1', 0), (1::BIGINT, 'p2', 0)) x(place, node_id, level)), t0 AS (SELECT 0::BIGINT AS ord WHERE false), s0 AS (SELECT NULL::VARCHAR AS why),
    {made}
    SELECT place, node_id, (SELECT why FROM s{levels}) IS NOT NULL AS truncated, (SELECT why FROM s{levels}) AS reason FROM n{levels}"""


@query("G2_bounded_bfs", _g2_sql())
def g2(spark, sf_dir):
    place = (F.col("l_suppkey") * 7919 + F.col("l_partkey")) % 1000003 * 10000000 + F.col("l_partkey")  # of its own for each edge
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    edges = table(spark, sf_dir, "lineitem").select(place.alias("ord"), name("p", "l_partkey").alias("source_id"), name("s", "l_suppkey").alias("target_id")).distinct()
    found = traverse.bounded(edges, ["p1", "p2"], 3, _G2_NODES, _G2_EDGES)
    return found["nodes"].select("place", "node_id", F.lit(found["truncated"]).alias("truncated"), F.lit(found["reason"]).cast("string").alias("reason"))


@query("G3_missing_seeds", "SELECT 'c' || (c_custkey * 2) AS node_id FROM customer WHERE c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def g3(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    seeds = c.select(F.concat(F.lit("c"), (F.col("c_custkey") * 2).cast("string")).alias("node_id"))
    return reports.missing(seeds, c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id")), "node_id")


@query("G3_refused_seeds", "WITH s AS (SELECT c_custkey * 2 AS k FROM customer) SELECT 'c' || k AS node_id, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'pending' END AS reason FROM s LEFT JOIN customer ON k = c_custkey")
def g3_refused(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = lambda k: F.concat(F.lit("c"), k.cast("string")).alias("node_id")
    nodes = c.select(key(F.col("c_custkey")), F.when(F.col("c_acctbal") < 0, "delete_pending").otherwise("ready").alias("lifecycle"))
    return reports.seed_reasons(c.select(key(F.col("c_custkey") * 2)), nodes)


@query("A8_link_counts", "SELECT l_partkey AS node_id, count(*) AS link_count, count(DISTINCT l_suppkey) AS source_count FROM lineitem GROUP BY ALL")
def a8(spark, sf_dir):
    return reports.link_counts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_suppkey").alias("evidence_id")))


@query("W4_keyset_page", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderkey > 1000) > 50 AS has_more FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def w4(spark, sf_dir):
    from orrery.operators import search

    return search.page(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000, 50)


@query(
    "W5_association_page",
    """WITH l AS (SELECT l_partkey AS owner, l_suppkey AS link, 'node' AS kind FROM lineitem UNION SELECT l_partkey, l_orderkey, 'relation' FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY link, kind) AS place, count(*) OVER (PARTITION BY owner) > 5 AS has_more FROM l WHERE link > 2)
    SELECT owner, link, kind, has_more FROM r WHERE place <= 5""",
)
def w5(spark, sf_dir):
    """The suppliers and orders of every part as its links."""
    from orrery.operators import search

    lines = table(spark, sf_dir, "lineitem")
    links = lines.select(F.col("l_partkey").alias("owner"), F.col("l_suppkey").alias("link"), F.lit("node").alias("kind")).union(lines.select("l_partkey", "l_orderkey", F.lit("relation"))).distinct()
    return search.pages(links.where("link > 2"), "owner", ["link", "kind"], 5)


@query("A15_size_report", "SELECT 'customer' AS name, count(*) AS n, sum(strlen(c_name)) AS text_bytes FROM customer UNION ALL SELECT 'part', count(*), sum(strlen(p_name)) FROM part")
def a15(spark, sf_dir):
    return reports.sizes({"customer": (table(spark, sf_dir, "customer"), ["c_name"]), "part": (table(spark, sf_dir, "part"), ["p_name"])})


@query("T1_T4_string_transforms", "SELECT p_partkey, lower(p_name) AS lower, upper(p_name) AS upper, trim(regexp_replace(lower(p_name), '[^a-z0-9._+]+', '-', 'g'), '-.') AS detector_token, substr(sha256(p_name), 1, 16) AS digest16, sha256(p_name) AS sha256_hex FROM part")
def t1(spark, sf_dir):
    names = ("lower", "upper", "detector_token", "digest16", "sha256_hex")
    return table(spark, sf_dir, "part").select("p_partkey", *[transforms.apply_chain(F.col("p_name"), [n]).alias(n) for n in names])


@query("V12_text_formats", "SELECT p_partkey, length(p_name) BETWEEN 1 AND 200 AS printable_text_200, length(p_brand) BETWEEN 1 AND 64 AND NOT contains(p_brand, ' ') AS tech_version FROM part")
def v12(spark, sf_dir):
    from orrery.functions.grammar import valid

    return table(spark, sf_dir, "part").select("p_partkey", valid("printable_text_200", F.col("p_name")).alias("printable_text_200"), valid("tech_version", F.col("p_brand")).alias("tech_version"))


@query("V13_dates", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS valid FROM orders")
def v13(spark, sf_dir):
    from orrery.functions.grammar import valid

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.substring(day, 1, 5), F.lit("02-30"))).otherwise(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", valid("calendar_date", text).alias("valid"))


@query("V8_numbers", "SELECT l_orderkey, l_linenumber, l_discount, round(l_discount * 10, 1) BETWEEN 0 AND 10 AND round(l_discount, 1) = l_discount AS cvss_score, l_discount BETWEEN 0 AND 1 AS probability FROM lineitem")
def v8(spark, sf_dir):
    d = F.col("l_discount")
    one_decimal = F.round(d, 1) == d
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", (d.between(0, 10) & one_decimal).alias("cvss_score"), d.between(0, 1).alias("probability"))


@query("V9_sorted_sets", "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) = list_sort(list_distinct(list(l_partkey ORDER BY l_linenumber, l_partkey))) AS sorted_set FROM lineitem GROUP BY l_orderkey")
def v9(spark, sf_dir):
    from orrery.functions.grammar import is_sorted_set

    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return lists.select("l_orderkey", is_sorted_set(F.transform("x", lambda p: p["l_partkey"])).alias("sorted_set"))


@query("S2_read_xml", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS region FROM customer")
def s2(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("<host id=\""), F.col("c_custkey").cast("string"), F.lit("\"><name>"), F.col("c_name"), F.lit("</name><region>"), F.col("c_nationkey").cast("string"), F.lit("</region></host>")).alias("x"))
    return nodes.select(F.from_xml("x", "_id int, name string, region int").alias("h")).select(F.col("h._id").alias("id"), "h.name", "h.region")


@query("J12_ip_containment", "SELECT c_custkey, (c_custkey % 250) // 64 = 0 AS inside FROM customer")
def j12(spark, sf_dir):
    ip = F.concat(F.lit("198.51.100."), (F.col("c_custkey") % 250).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", reports.ipv4_inside(ip, F.lit("198.51.100.0/26")).alias("inside"))


@query(
    "I3_scoped_chain",
    """WITH a AS (SELECT 'c' || c_custkey AS ref, 'host' AS type, NULL AS parent, NULL AS parent_id, sha256('{"name":"' || c_name || '","zone":' || c_nationkey || '}') AS key FROM customer),
    an AS (SELECT *, sha256('host:' || key) AS node_id FROM a),
    b AS (SELECT 'o' || o_orderkey AS ref, 'port' AS type, an.ref AS parent, an.node_id AS parent_id, sha256('{"number":' || o_orderkey || ',"parent":"' || an.node_id || '"}') AS key FROM orders JOIN an ON an.ref = 'c' || o_custkey),
    bn AS (SELECT *, sha256('port:' || key) AS node_id FROM b),
    c AS (SELECT 'l' || l_orderkey || '-' || l_linenumber AS ref, 'service' AS type, bn.ref AS parent, bn.node_id AS parent_id, sha256('{"line":' || l_linenumber || ',"parent":"' || bn.node_id || '"}') AS key FROM lineitem JOIN bn ON bn.ref = 'o' || l_orderkey)
    SELECT ref, type, parent_id, key, node_id FROM an UNION ALL SELECT ref, type, parent_id, key, node_id FROM bn UNION ALL SELECT ref, type, parent_id, key, sha256('service:' || key) FROM c""",
)
def i3(spark, sf_dir):
    """Customers as hosts, their orders as ports, and lines as services."""
    text = lambda name: F.col(name).cast("string")
    quoted = lambda name: F.concat(F.lit('"'), F.col(name), F.lit('"'))
    hosts = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), text("c_custkey")).alias("ref"), F.lit("host").alias("type"), F.lit(None).cast("string").alias("parent"), F.create_map(F.lit("name"), quoted("c_name"), F.lit("zone"), text("c_nationkey")).alias("members"))
    ports = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), text("o_orderkey")), F.lit("port"), F.concat(F.lit("c"), text("o_custkey")), F.create_map(F.lit("number"), text("o_orderkey")))
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("l"), text("l_orderkey"), F.lit("-"), text("l_linenumber")), F.lit("service"), F.concat(F.lit("o"), text("l_orderkey")), F.create_map(F.lit("line"), text("l_linenumber")))
    return inventory.scoped(hosts.union(ports).union(lines))


@query(
    "V5_V25_relation_checks",
    """WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderstatus = 'P' AND o_orderkey % 2 = 1 AS contact FROM orders)
    SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'source: missing' WHEN contact AND o_orderkey % 3 = 0 THEN 'role: required' WHEN contact AND o_orderkey % 3 = 1 THEN 'role: not listed'
      WHEN contact THEN 'target: reports are posted' WHEN o_orderstatus = 'P' THEN 'end types' WHEN o_orderstatus = 'O' THEN 'name is not under the other' END AS reason
    FROM r LEFT JOIN customer ON o_custkey = c_custkey""",
)
def v5_v25(spark, sf_dir):
    """A customer's name above the names of its orders; orders in progress are endpoints that take reports."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    name = F.concat(node("o", "o_orderkey"), F.when(F.col("o_orderstatus") == "O", "x").otherwise("."), node("c", "o_custkey"), F.lit(".com"))
    names = c.select(node("c", "c_custkey").alias("node_id"), F.lit("domain").alias("type"), F.to_json(F.struct(F.concat(node("c", "c_custkey"), F.lit(".com")).alias("value"))).alias("p"))
    progress = F.col("o_orderstatus") == "P"
    held = F.when(progress, F.to_json(F.struct(F.concat(F.lit("https://"), name, F.lit("/")).alias("url"), F.lit("GET").alias("method")))).otherwise(F.to_json(F.struct(name.alias("value"))))
    held_by = o.select(node("o", "o_orderkey"), F.when(progress, "endpoint").otherwise("subdomain"), held)
    nodes = names.union(held_by).select("node_id", "type", F.parse_json("p").alias("properties"))
    contact, k = progress & (F.col("o_orderkey") % 2 == 1), F.col("o_orderkey") % 3
    role = F.when(contact & (k == 1), '{"role":"boss"}').when(contact & (k == 2), '{"role":"iodef"}').otherwise("{}")
    relations = o.select("o_orderkey", F.when(contact, "has_contact").otherwise("has_subdomain").alias("type"), node("c", "o_custkey").alias("source_id"), node("o", "o_orderkey").alias("target_id"), F.parse_json(role).alias("properties"))
    return relationchecks.relation_reasons(relations, nodes).select("o_orderkey", "reason")
