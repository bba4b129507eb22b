"""Effective ownership and authorization down the scope chain, rejection, deletion and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.catalog import NODES


def roots(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """nodes (node_id, parent_id, carrying) with root_id: the nearest carrying ancestor, itself included, in `depth` joins."""
    up = nodes.select(F.col("node_id").alias("at"), F.col("parent_id").alias("up"), F.col("carrying").alias("carries"))
    walk = nodes.withColumn("at", F.when(F.col("carrying"), F.col("node_id")).otherwise(F.col("parent_id"))).withColumn("done", F.col("carrying"))
    for _ in range(depth):
        step = walk.join(up, "at", "left")
        stop = F.col("done") | F.coalesce("carries", F.lit(False))
        walk = step.withColumn("at", F.when(stop, F.col("at")).otherwise(F.col("up"))).withColumn("done", stop).drop("up", "carries")
    return walk.withColumn("root_id", F.when(F.col("done"), F.col("at"))).drop("at", "done")


def chain(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """(node_id, member) for every node and each member of its chain below and including itself up to the root, at most depth + 1 long."""
    up = nodes.select(F.col("node_id").alias("member"), "parent_id", "carrying")
    level = nodes.select("node_id", F.col("node_id").alias("member"))
    out = level
    for _ in range(depth):
        level = level.join(up, "member").where("not carrying and parent_id is not null").select("node_id", F.col("parent_id").alias("member"))
        out = out.union(level)
    return out


def effective(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """nodes (node_id, parent_id, carrying, ownership, authorization, allowlist, override) -> node_id, root_id, ownership, authorization.

    Ownership is the root's.  `out_of_scope` anywhere on the chain wins; under an allowlist root
    `in_scope` holds only where a member was widened; otherwise the root's word counts.
    """
    rooted = roots(nodes, depth).select("node_id", "root_id")
    marks = nodes.where("override is not null").select(F.col("node_id").alias("member"), "override")
    said = chain(nodes, depth).join(marks, "member").groupBy("node_id").agg(F.bool_or(F.col("override") == "out_of_scope").alias("narrowed"), F.bool_or(F.col("override") == "in_scope").alias("widened"))
    root = nodes.select(F.col("node_id").alias("root_id"), "ownership", "authorization", "allowlist")
    joined = rooted.join(root, "root_id", "left").join(said, "node_id", "left")
    authorization = (
        F.when(F.coalesce("narrowed", F.lit(False)) | (F.col("authorization") == "out_of_scope"), "out_of_scope")
        .when(F.col("allowlist") & (F.col("node_id") != F.col("root_id")), F.when(F.coalesce("widened", F.lit(False)), "in_scope").otherwise("unknown"))
        .otherwise(F.col("authorization"))
    )
    return joined.select("node_id", F.when(F.col("root_id") != F.col("node_id"), F.col("root_id")).alias("state_root_id"), "ownership", authorization.alias("authorization"))


def shown(ownership: Column, wanted: str | None = None) -> Column:
    """The default state filter hides rejected records and keeps those without a state."""
    return ~ownership.eqNullSafe("rejected") if wanted is None else ownership.eqNullSafe(wanted)


def under_rejection(states: DataFrame) -> DataFrame:
    """Records (node_id) scoped below a rejected root, which take no writes; states as of `effective`."""
    return states.where("state_root_id is not null and ownership = 'rejected'").select("node_id")


def transition_allowed(before: Column, after: Column, evidenced: Column) -> Column:
    """Whether ownership may go from before (null at creation) to after: only candidates are rejected, a
    rejected record becomes no candidate again, and owned or dependency needs evidence in the same write."""
    return (
        F.when(before.eqNullSafe(after), F.lit(True))
        .when(after == "rejected", before.eqNullSafe("candidate"))
        .when(after == "candidate", ~before.eqNullSafe("rejected"))
        .otherwise(evidenced)
    )


STATES = (None, "owned", "candidate", "dependency", "rejected")


def rejected_projection(nodes: DataFrame) -> DataFrame:
    """nodes (type, properties: map, ...) as a rejection leaves them: identity and required properties only, authorization and allowlist reset."""
    kept = F.lit(None).cast("array<string>")
    for name, t in NODES.items():
        own = sorted({*t.identity, *t.required})
        kept = F.when(F.col("type") == name, F.array(*[F.lit(x) for x in own])).otherwise(kept)
    return nodes.withColumns(
        {
            "properties": F.map_filter("properties", lambda k, _: F.array_contains(kept, k)),
            "ownership": F.lit("rejected"),
            "authorization": F.lit("unknown"),
            "allowlist_scoped": F.lit(False),
            "authorization_override": F.lit(None).cast("string"),
        }
    )


def authorization_reason(ownership: Column, before: Column, after: Column, allowlist_before: Column, allowlist_after: Column, evidenced: Column) -> Column:
    """Why a root's authorization or allowlist marker may not change so; null where it may."""
    changed, listed = ~after.eqNullSafe(before), ~allowlist_after.eqNullSafe(allowlist_before)
    return (
        F.when(changed & (ownership == "rejected"), "rejected")
        .when(changed & (after != "unknown") & ~evidenced, "evidence required")
        .when(listed & ~evidenced, "evidence required")
        .when(allowlist_after & (after != "in_scope"), "allowlist needs in_scope")
    )


def purge(nodes: DataFrame, relations: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a rejection of roots (node_id) leaves: nodes without the roots' descendants, relations without either's ends."""
    gone = nodes.join(rejected.select(F.col("node_id").alias("state_root_id")), "state_root_id", "left_semi").select("node_id")
    left = nodes.join(gone, "node_id", "left_anti")
    touched = gone.union(rejected.select("node_id"))
    for end in ("source_id", "target_id"):
        relations = relations.join(touched.select(F.col("node_id").alias(end)).distinct(), end, "left_anti")
    return left, relations


def cascade(relations: DataFrame, links: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations and evidence links that remain after nodes (node_id) are deleted."""
    for end in ("source_id", "target_id"):
        relations = relations.join(deleted.select(F.col("node_id").alias(end)).distinct(), end, "left_anti")
    return relations, links.join(deleted.select("node_id").distinct(), "node_id", "left_anti")


def delete_reasons(asked: DataFrame, nodes: DataFrame, relations: DataFrame, cascade: bool) -> DataFrame:
    """asked (node_id) -> node_id, reason: missing, pending, or (without cascade) has relations."""
    known = nodes.select("node_id", "lifecycle")
    ends = relations.select(F.col("source_id").alias("node_id")).union(relations.select("target_id")).distinct().withColumn("tied", F.lit(True))
    joined = asked.join(known, "node_id", "left").join(ends, "node_id", "left")
    tied = F.col("tied").isNotNull() & F.lit(not cascade)
    return joined.select("node_id", F.when(F.col("lifecycle").isNull(), "missing").when(F.col("lifecycle") == "deleting", "pending").when(tied, "has relations").alias("reason"))


def pending_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """rel_id and what blocks it: its own deletion, its source's, or its target's; null where nothing does."""
    going = nodes.where("lifecycle = 'deleting'").select("node_id")
    joined = relations.join(going.select(F.col("node_id").alias("source_id"), F.lit("source").alias("s")).distinct(), "source_id", "left")
    joined = joined.join(going.select(F.col("node_id").alias("target_id"), F.lit("target").alias("t")).distinct(), "target_id", "left")
    return joined.select("rel_id", F.coalesce(F.when(F.col("lifecycle") == "deleting", "self"), "s", "t").alias("blocker"))


def ready_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ready relations with two ready ends."""
    ready = nodes.where("lifecycle = 'ready'").select("node_id")
    out = relations.where("lifecycle = 'ready'")
    for end in ("source_id", "target_id"):
        out = out.join(ready.select(F.col("node_id").alias(end)), end, "left_semi")
    return out


def retained(jobs: DataFrame, newest: int, expired_before: int, group: str = "state") -> DataFrame:
    """jobs (job_id, <group>, finished_us, protected) with prune: expired, or older than the newest `newest` of its group.

    The place of a job in its group is found in two steps, so that no group is sorted in one task: counts
    for each day, then ranks inside the day that holds the cut.
    """
    day = F.floor(F.col("finished_us") / 86_400_000_000)
    dated = jobs.withColumn("day", day)
    days = dated.where("not protected").groupBy(group, "day").agg(F.count(F.lit(1)).alias("n"))
    later = F.sum("n").over(Window.partitionBy(group).orderBy(F.desc("day")))  # a row for each day
    days = days.withColumn("later", later - F.col("n")).withColumn("through", later)
    cut = days.where((F.col("later") < newest) & (F.col("through") > newest)).select(group, "day", "later")
    inside = dated.where("not protected").join(cut, [group, "day"])
    rank = F.row_number().over(Window.partitionBy(group, "day").orderBy(F.desc("finished_us"), F.desc("job_id"))) + F.col("later")
    over = inside.withColumn("over", rank > newest).select("job_id", "over")
    joined = dated.join(days.select(group, "day", "later"), [group, "day"], "left").join(over, "job_id", "left")
    prune = ~F.col("protected") & ((F.col("finished_us") < expired_before) | F.coalesce("over", F.col("later") >= newest))
    return joined.select("job_id", group, prune.alias("prune"))
