"""Queries on events as requests that change the state of users and of what users hold, in the order of their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import statescan
from orrery.plans.book import query, table

_Q = """
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
q AS (
  SELECT event_id AS seq, user_id AS record, event_id % 3 > 0 AS by_id, [NULL, 'owned', 'candidate', 'dependency', 'rejected', 'candidate'][k % 6 + 1] AS ownership,
    CASE event_type WHEN 'view' THEN 'in_scope' WHEN 'click' THEN 'unknown' WHEN 'error' THEN 'out_of_scope' WHEN 'purchase' THEN 'in_scope' END AS authorization_,
    [NULL, true, false][(k // 6) % 3 + 1] AS allowlist, k % 4 > 0 AS evidenced, CASE WHEN user_id % 5 = 0 THEN ['owned', 'candidate', 'rejected'] ELSE ['owned', 'candidate', 'dependency', 'rejected'] END AS allowed,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM k
),"""


def _step(rows: str) -> str:
    """A request against the state (o, a, l) of its row."""
    return f"""
      SELECT seq, record, i, CASE WHEN stays THEN o ELSE after_ END AS o, CASE WHEN stays THEN a ELSE wants END AS a, CASE WHEN stays THEN l ELSE marked END AS l, reason FROM (
        SELECT *, (o IS NOT NULL AND NOT by_id) OR reason IS NOT NULL AS stays FROM (
          SELECT *, CASE WHEN o IS NOT NULL AND NOT by_id THEN NULL WHEN o IS NULL AND by_id THEN 'missing' WHEN after_ IS NULL THEN 'ownership required'
              WHEN ownership IS NOT NULL AND NOT list_contains(allowed, ownership) THEN 'ownership not allowed'
              WHEN after_ IS NOT DISTINCT FROM o THEN rest
              WHEN after_ = 'rejected' THEN CASE WHEN o IS DISTINCT FROM 'candidate' THEN 'only candidates are rejected' ELSE rest END
              WHEN after_ = 'candidate' THEN CASE WHEN o = 'rejected' THEN 'rejected' ELSE rest END
              WHEN NOT evidenced THEN 'evidence required' ELSE rest END AS reason FROM (
            SELECT *, CASE WHEN wants <> was AND after_ = 'rejected' THEN 'rejected' WHEN wants <> was AND wants <> 'unknown' AND NOT evidenced THEN 'evidence required'
                WHEN marked <> listed AND NOT evidenced THEN 'evidence required' WHEN marked AND wants <> 'in_scope' THEN 'allowlist needs in_scope' END AS rest FROM (
              SELECT *, coalesce(authorization_, was) AS wants, coalesce(allowlist, listed) AS marked FROM (
                SELECT *, CASE WHEN rejecting OR o IS NULL THEN 'unknown' ELSE a END AS was, l AND NOT rejecting AS listed FROM (
                  SELECT *, coalesce(after_ = 'rejected' AND o IS DISTINCT FROM 'rejected', false) AS rejecting FROM (
                    SELECT *, coalesce(ownership, o) AS after_ FROM ({rows}))))))))"""


_ROOTS = f"""{_Q}
g AS (
  {_step("SELECT *, NULL::VARCHAR AS o, NULL::VARCHAR AS a, false AS l FROM q WHERE i = 1")}
  UNION ALL
  {_step("SELECT q.*, g.o, g.a, g.l FROM g JOIN q ON q.record = g.record AND q.i = g.i + 1")}
)"""


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


def _root_requests(spark, sf_dir) -> DataFrame:
    of = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    authorization = F.when(F.col("event_type").isin("view", "purchase"), "in_scope").when(F.col("event_type") == "click", "unknown").when(F.col("event_type") == "error", "out_of_scope")
    allowed = F.when(F.col("user_id") % 5 == 0, F.array(F.lit("owned"), F.lit("candidate"), F.lit("rejected")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record"), F.col("event_id").alias("seq"), (F.col("event_id") % 3 > 0).alias("by_id"), of((None, "owned", "candidate", "dependency", "rejected", "candidate"), _k()).alias("ownership"),
        authorization.alias("authorization"), of((None, True, False), F.floor(_k() / 6)).alias("allowlist"), (_k() % 4 > 0).alias("evidenced"), allowed.alias("allowed"),
    )


@query("N5_N7_state_requests", f'WITH RECURSIVE {_ROOTS} SELECT seq, o AS ownership, a AS "authorization", l AS allowlist, reason FROM g')
def n5_n7(spark, sf_dir):
    """Requests of all kinds to a user's own state; a user is a record, found by its id or by its identity."""
    told = statescan.root_requests(_root_requests(spark, sf_dir))
    return told.select("seq", "after.*", "reason")


@query(
    "N6_child_overrides",
    f"""WITH RECURSIVE {_ROOTS},
    c AS (SELECT user_id || '/' || event_type AS record, user_id AS root, event_id + 7 AS seq, event_id % 3 > 0 AS by_id, CASE WHEN k % 10 = 0 THEN 'owned' END AS ownership,
            ['in_scope', 'out_of_scope', 'unknown', NULL][k % 4 + 1] AS wants, k % 5 > 0 AS evidenced, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM k),
    met AS (SELECT c.*, coalesce(r.l, false) AS listed, CASE WHEN wants <> 'unknown' THEN wants END AS after_ FROM c ASOF LEFT JOIN (SELECT record AS root, seq AS at, l FROM g) r ON c.root = r.root AND c.seq >= r.at),
    s AS (
      SELECT record, seq, i, NULL::VARCHAR AS reason, NULL::VARCHAR AS o, true AS start FROM (SELECT record, 0 AS seq, 0 AS i FROM met GROUP BY record)
      UNION ALL
      SELECT record, seq, i, reason, CASE WHEN reason IS NULL AND changes THEN after_ ELSE o END, false FROM (
        SELECT *, CASE WHEN ownership IS NOT NULL THEN 'ownership is inherited' WHEN changes AND after_ IS NOT NULL AND NOT evidenced THEN 'evidence required'
            WHEN changes AND after_ = 'in_scope' AND NOT listed THEN 'root has no allowlist' END AS reason FROM (
          SELECT m.*, s.o, wants IS NOT NULL AND m.after_ IS DISTINCT FROM s.o AND by_id AS changes FROM s JOIN met m ON m.record = s.record AND m.i = s.i + 1))
    ) SELECT record, seq, o AS override, reason FROM s WHERE NOT start""",
)
def n6_children(spark, sf_dir):
    """Overrides of what a user holds (a kind of events), each met by the user's allowlist at that moment."""
    roots = statescan.root_requests(_root_requests(spark, sf_dir)).select("record", "seq", F.col("after.allowlist").alias("allowlist"))
    of = F.element_at(F.array(*[F.lit(v) for v in ("in_scope", "out_of_scope", "unknown", None)]), (_k() % 4 + 1).cast("int"))
    asked = table(spark, sf_dir, "events").select(
        F.concat_ws("/", "user_id", "event_type").alias("record"), F.col("user_id").alias("root"), (F.col("event_id") + 7).alias("seq"), (F.col("event_id") % 3 > 0).alias("by_id"),
        F.when(_k() % 10 == 0, "owned").alias("ownership"), of.alias("authorization"), F.lit(None).cast("boolean").alias("allowlist"), (_k() % 5 > 0).alias("evidenced"),
    )
    return statescan.child_requests(asked, roots).select("record", "seq", F.col("after").alias("override"), "reason")
