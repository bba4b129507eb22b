"""Merging observations of one record in the order of their arrival.

A write is fresh when it was observed no earlier than every reporting write before it.  Fresh writes overwrite: an object merges into an
object, anything else replaces what stands there, with all below it.  Stale writes only add what is missing, at any depth, and
nothing below a scalar.  Fresh removals take a path with all below it and leave the object around it; stale ones do nothing.

The result is found without going through a record's writes one by one.  Every write is spread over its leaf and the objects above it (nodes);
grouped maxima give each node's last fresh scalar, last fresh mark as an object and last removal, and the last of the scalars and
removals above it.  If the node was set after all of these, that decides; else the first stale write after them that was not stopped on its way.
A stale write is stopped by a scalar above its leaf; that can only be at nodes that are a scalar in one write and an object in another
(few, and none in most data), which are gone through from the top down, a level at a time.

What depends on earlier writes is found in blocks of a record's sequence (one row a block, then inside each block), so a record or path
with a third of all writes is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import jsonwalk
from orrery.sources.storage import written

#: Sequence numbers of a block.
BLOCK = 1 << 20


def greatest_before(rows: DataFrame, keys: list[str], value: Column, block: int = BLOCK, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows (with seq) and __before: the greatest value among the rows of the same keys with a smaller seq; null where there is none.

    Rows of one seq are ordered by the columns `ties`, and without these must not need each other's values.  Rows without seq come before all others.
    """
    marked = rows.withColumn("__block", F.coalesce(F.floor(F.col("seq") / block), F.lit(-(1 << 62)))).withColumn("__value", value)
    ends = marked.groupBy(*keys, "__block").agg(F.max("__value").alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__block", F.max("__end").over(earlier).alias("__earlier"))
    inside = Window.partitionBy(*keys, "__block").orderBy("seq", *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.withColumn("__within", F.max("__value").over(inside)).join(ends, [*keys, "__block"])
    return joined.withColumn("__before", F.greatest("__earlier", "__within")).drop("__block", "__value", "__earlier", "__within")


def with_fresh(writes: DataFrame, block: int = BLOCK, ties: tuple[str, ...] = ()) -> DataFrame:
    """writes (record, seq, observed, and reporting where some writes report nothing) with the column fresh; writes of one seq come in the order of `ties`.

    A write without a record has no place in any order and is left out.
    """
    told = F.when(F.col("reporting"), F.col("observed")) if "reporting" in writes.columns else F.col("observed")
    before = greatest_before(writes.where("record is not null"), ["record"], told, block, ties)
    return before.select(*writes.columns, F.coalesce(F.col("observed") >= F.col("__before"), F.lit(True)).alias("fresh"))


def _above(path: Column) -> Column:
    """The paths of the objects above a path, from the top; none for a name without slashes."""
    steps = F.split(path, "/")
    made = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    return F.filter(F.when(F.size(steps) > 1, made).otherwise(F.array().cast("array<string>")), lambda p: p != "")


def _nodes(leaves: DataFrame) -> DataFrame:
    """Each leaf's row for itself and for every object above it: node, leaf, scalar (whether it sets a value there); removals for themselves only."""
    at = F.when(F.col("removed"), F.array("path")).otherwise(F.concat(F.array("path"), _above(F.col("path"))))
    spread = leaves.select("*", F.explode(at).alias("node"))
    leaf = F.col("node") == F.col("path")
    return spread.select("*", leaf.alias("leaf"), (leaf & ~F.col("removed") & F.coalesce(F.col("value") != "{}", F.lit(True))).alias("scalar"))


def _decided(nodes: DataFrame) -> DataFrame:
    """record, node, and the last fresh events: set_at with value, object_at, covered (scalars above), removed_at (removals here and above); scalar and object: whether any write, stale ones too, has it so."""
    fresh, here = F.col("fresh"), F.col("scalar")
    marks = ~here & ~F.col("removed")
    one = nodes.groupBy("record", "node").agg(
        F.max(F.when(fresh & here, F.struct("seq", "value"))).alias("set"),
        F.max(F.when(fresh & marks, F.col("seq"))).alias("object_at"),
        F.max(F.when(fresh & F.col("removed"), F.col("seq"))).alias("removed_at"),
        F.max(here).alias("scalar"),
        F.max(~F.col("leaf")).alias("object"),
    )
    ends = one.select("record", F.col("node").alias("upper"), F.col("set.seq").alias("set_end"), F.col("removed_at").alias("removed_end")).where("set_end is not null or removed_end is not null")
    below = one.select("record", "node", F.explode(_above(F.col("node"))).alias("upper"))
    gone = below.join(ends, ["record", "upper"]).groupBy("record", "node").agg(F.max("set_end").alias("covered"), F.max("removed_end").alias("removed_above"))
    both = one.join(gone, ["record", "node"], "left")
    removed = F.greatest("removed_at", "removed_above").alias("removed_at")
    return both.select("record", "node", F.col("set.seq").alias("set_at"), F.col("set.value").alias("value"), "object_at", "covered", removed, "scalar", "object")


def _stopped(stale: DataFrame, fresh: DataFrame, mixed: DataFrame, block: int) -> DataFrame:
    """record, seq, path of the stale leaves that a scalar at these nodes (record, node; all of one level) stops.

    A node's time is divided by the fresh events on it: it becomes a scalar, an object, or goes (with what stands above).  While it is gone the first
    stale write that comes through makes it a scalar or an object.
    """
    uppers = mixed.select("record", F.col("node").alias("under"), F.explode(F.concat(F.array("node"), _above(F.col("node")))).alias("node"))
    own = F.col("node") == F.col("under")
    happened = fresh.join(uppers, ["record", "node"]).select("record", F.col("under").alias("node"), "seq", F.when(F.col("removed") | ~own & F.col("scalar"), "gone").when(own & F.col("scalar"), "scalar").when(own, "object").alias("kind"))
    passing = _nodes(stale).join(mixed, ["record", "node"]).select("record", "node", "seq", "path", "leaf", "scalar", F.lit(None).cast("string").alias("kind"))
    both = happened.where("kind is not null").select("record", "node", "seq", F.lit(None).cast("string").alias("path"), F.lit(None).cast("boolean").alias("leaf"), F.lit(None).cast("boolean").alias("scalar"), "kind").unionByName(passing)
    timed = greatest_before(both, ["record", "node"], F.when(F.col("kind").isNotNull(), F.struct("seq", "kind")), block).where("path is not null")
    timed = timed.withColumn("since", F.coalesce("__before.seq", F.lit(-(1 << 63)))).withColumn("state", F.coalesce("__before.kind", F.lit("gone")))
    first = timed.where("state = 'gone'").groupBy("record", "node", "since").agg(F.min(F.struct("seq", "scalar")).alias("first"))
    told = timed.where("not leaf").join(first, ["record", "node", "since"], "left")
    stopped = (F.col("state") == "scalar") | (F.col("state") == "gone") & F.col("first.scalar") & (F.col("first.seq") < F.col("seq"))
    return told.where(stopped).select("record", "seq", "path").distinct()


def merge_leaves(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """leaves (record, path, seq, fresh, removed, value) -> record, path, value of the merged record.

    A path is a JSON Pointer, a value JSON text ({} is an object without members, as a merged one may be left; arrays are values); all leaves of one
    write share its seq, and what it removes goes before what it sets.  Leaves without record, path or seq have no place and are left out.
    """
    known = leaves.where("record is not null and path is not null and seq is not null and (fresh or not removed)")
    known = written(known.select("record", "path", "seq", "fresh", "removed", "value"), "leaves")  # what made it fresh is not done again
    nodes = _nodes(known)
    decided = written(_decided(nodes), "decided")
    stale = known.where("not fresh")
    mixed = decided.where("scalar and object").select("record", "node", F.size(F.split("node", "/")).alias("depth"))
    levels = sorted(r["depth"] for r in mixed.select("depth").distinct().collect())
    if levels:
        fresh = nodes.where("fresh").select("record", "node", "seq", "removed", "scalar")
        for depth in levels:
            stopped = _stopped(stale, fresh, mixed.where(F.col("depth") == depth).select("record", "node"), block)
            stale = written(stale.join(stopped, ["record", "seq", "path"], "left_anti"), "stale")

    set_last = F.coalesce(F.col("set_at") > F.col("object_at"), F.col("set_at").isNotNull())
    last = F.greatest("set_at", "object_at")
    stands = last.isNotNull() & F.coalesce(last > F.col("covered"), F.lit(True)) & F.coalesce(last >= F.col("removed_at"), F.lit(True))
    gone = F.greatest("covered", "removed_at")
    lasting = decided.where(stands).select("record", "node", F.when(set_last, F.struct("value")).alias("held"))
    # what is gone takes its first stale write since: by blocks, and one by one in the block where it went
    open_ = decided.where(~stands).select("record", "node", gone.alias("since"), F.floor(gone / block).alias("in_block"))
    offered = _nodes(stale).select("record", "node", F.floor(F.col("seq") / block).alias("block"), F.struct("seq", "scalar", "value").alias("offer"))
    by_block = offered.groupBy("record", "node", "block").agg(F.min("offer").alias("offer"))
    later = by_block.join(open_, ["record", "node"]).where("since is null or block > in_block").select("record", "node", "offer")
    edge = offered.join(open_.where("since is not null").withColumnRenamed("in_block", "block"), ["record", "node", "block"]).where("offer.seq > since").select("record", "node", "offer")
    first = later.unionByName(edge).groupBy("record", "node").agg(F.min("offer").alias("offer"))
    added = first.select("record", "node", F.when(F.col("offer.scalar"), F.struct("offer.value")).alias("held"))
    alive = lasting.unionByName(added)
    values = alive.where("held is not null").select("record", F.col("node").alias("path"), F.col("held.value").alias("value"))
    parents = alive.select("record", F.try_element_at(_above(F.col("node")), F.lit(-1)).alias("node")).where("node is not null").distinct()
    empty = alive.where("held is null").join(parents, ["record", "node"], "left_anti").select("record", F.col("node").alias("path"), F.lit("{}").alias("value"))
    return values.unionByName(empty)


def last_written(writes: DataFrame, fields: list[str]) -> DataFrame:
    """The last value of each field among writes that name it (<field>_present); an explicit null counts."""
    wrapped = [F.max_by(F.struct(F.col(f).alias("v")), F.when(F.col(f"{f}_present"), F.col("seq")))["v"].alias(f) for f in fields]
    return writes.groupBy("record").agg(*wrapped)


def spans(writes: DataFrame) -> DataFrame:
    """first_seen and last_seen over reporting writes, the ownership given at creation, and how often the record was written."""
    return writes.groupBy("record").agg(
        F.min(F.when(F.col("reporting"), F.col("observed"))).alias("first_seen"),
        F.max(F.when(F.col("reporting"), F.col("observed"))).alias("last_seen"),
        F.min_by("ownership", "seq").alias("ownership"),
        F.count(F.lit(1)).alias("n_writes"),
    )


def _steps(path: str) -> list[str]:
    """Names from the top; the first keeps its slash."""
    first, *rest = path.split("/")
    return [f"/{rest[0]}", *rest[1:]] if not first and rest else [first, *rest]


def applied(state: dict, values: dict[str, str | None], removals: list[str], fresh: bool) -> dict:
    """A record's tree after one more write; values are held as one-tuples."""
    for path in removals if fresh else ():
        *outer, name = _steps(path)
        at: object = state
        for step in outer:
            at = at.get(step) if isinstance(at, dict) else None
        if isinstance(at, dict):
            at.pop(name, None)
    patch: dict = {}
    for path, value in values.items():
        *outer, name = _steps(path)
        at = patch
        for step in outer:
            at = at.setdefault(step, {})
        at[name] = {} if value == "{}" else (value,)
    return jsonwalk.merge(state, patch, missing_only=not fresh)


def leaves_of(state: dict) -> dict[str, str | None]:
    """Values by path, with {} for objects without members."""
    out, left = {}, list(state.items())
    while left:
        at, value = left.pop()
        if isinstance(value, tuple):
            out[at] = value[0]
        elif value:
            left += [(f"{at}/{name}", inner) for name, inner in value.items()]
        else:
            out[at] = "{}"
    return out


def fold(history: list[tuple[int, bool, dict | None, list[str]]]) -> dict:
    """The same merge, one write after another: (observed, reporting, values by path, removals) -> values by path; for tests."""
    latest, state = None, {}
    for observed, reporting, properties, removals in history:
        state = applied(state, properties or {}, removals, latest is None or observed >= latest)
        if reporting:
            latest = observed if latest is None else max(latest, observed)
    return leaves_of(state)


def acknowledge(writes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """record -> created (not in the snapshot before) and number of writes."""
    known = snapshot.select("record").distinct().withColumn("known", F.lit(True))
    return writes.groupBy("record").agg(F.count(F.lit(1)).alias("n_writes")).join(known, "record", "left").select("record", F.col("known").isNull().alias("created"), "n_writes")
