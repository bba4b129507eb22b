"""Writes against a snapshot of records that lies in buckets: only the batch is shuffled.

The snapshot is two tables: records (record, created_at, updated_at, first_seen, last_seen, leaves) in buckets by record, and links (record, evidence) in buckets by
both.  The batch is brought into the same buckets; the records it touches are merged leaf by leaf (merge.merge_leaves), with what stands in
the snapshot as the first write; all others go over as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import merge
from orrery.sources import versions
from orrery.sources.storage import written

RECORDS = "record string, created_at bigint, updated_at bigint, first_seen bigint, last_seen bigint, leaves array<struct<path:string,value:string>>"
LINKS = "record string, evidence string"
#: Before all sequence numbers of a batch.
_BEFORE = -(1 << 60)


def empty(spark: SparkSession, root: str, buckets: int) -> dict[str, versions.Table]:
    """The tables of a snapshot without records."""
    made = lambda ddl, keys: versions.stored(spark.createDataFrame([], ddl), root, keys, buckets)
    return {"records": made(RECORDS, ("record",)), "links": made(LINKS, ("record", "evidence"))}


def touched(records: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """Records of the snapshot that the batch (record) names; the snapshot's side has no exchange."""
    return records.join(batch.select("record").distinct().repartition(buckets, "record"), "record", "left_semi")


def upsert(spark: SparkSession, root: str, snapshot: dict[str, versions.Table], writes: DataFrame, leaves: DataFrame, links: DataFrame, block: int = merge.BLOCK) -> tuple[dict[str, versions.Table], DataFrame]:
    """The snapshot's tables after a batch, and what is told of each write.

    writes (record, seq, at, observed, reporting): seq is unique in a record, `at` is when the write was made; leaves (record, seq, path, removed, value); links (record, seq,
    evidence, added): a write that both adds and removes a link removes it.  Leaves and links of no write count for nothing.  Where leaves have a column merge_seq, they are merged by it
    (so several writes may stand at one place, merge.merge_leaves), and only freshness and links follow seq, in blocks of `block` sequence numbers.

    Told: record, seq, created (the record was not there), updated (it was), links_added and links_removed (those that changed something), and reason where the write has no
    record or seq and so does nothing.  A record's created_at is the time of its first write and stays, updated_at that of its last one.
    """
    n = snapshot["records"].buckets
    records, linked = versions.opened(spark, snapshot["records"]), versions.opened(spark, snapshot["links"])
    placed = F.col("record").isNotNull() & F.col("seq").isNotNull()
    batch = written(writes.where(placed).select("record", "seq", "at", "observed", "reporting").repartition(n, "record"), "batch")
    old = written(touched(records, batch, n), "touched")

    # Freshness: the snapshot's last_seen is that of a write before all others.
    pseudo = old.select("record", F.lit(_BEFORE).alias("seq"), F.lit(None).cast("bigint").alias("at"), F.col("last_seen").alias("observed"), F.col("last_seen").isNotNull().alias("reporting"))
    fresh = merge.with_fresh(batch.unionByName(pseudo), block).where(F.col("seq") > _BEFORE).select("record", "seq", "fresh")
    apart = "merge_seq" in leaves.columns
    new = leaves.join(fresh, ["record", "seq"]).select("record", "path", F.col("merge_seq" if apart else "seq").alias("seq"), "fresh", "removed", "value")
    stood = old.select("record", F.explode("leaves").alias("leaf")).select("record", "leaf.path", F.lit(_BEFORE).alias("seq"), F.lit(True).alias("fresh"), F.lit(False).alias("removed"), "leaf.value")
    merged = merge.merge_leaves(stood.unionByName(new), merge.BLOCK if apart else block).groupBy("record").agg(F.sort_array(F.collect_list(F.struct("path", "value"))).alias("leaves"))
    seen = F.when(F.col("reporting"), F.col("observed"))
    spans = batch.groupBy("record").agg(F.min_by("at", "seq").alias("first_at"), F.max_by("at", "seq").alias("last_at"), F.min(seen).alias("first"), F.max(seen).alias("last"), F.min("seq").alias("first_seq"))
    changed = spans.join(merged, "record", "left").select("record", "first_at", "last_at", "first", "last", F.coalesce("leaves", F.array().cast("array<struct<path:string,value:string>>")).alias("merged"))
    changed = changed.repartition(n, "record")
    both = records.join(changed, "record", "full_outer")
    here = F.col("merged").isNotNull()
    after = both.select(
        "record",
        F.coalesce("created_at", "first_at").alias("created_at"),
        F.when(here, F.col("last_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.least("first_seen", "first").alias("first_seen"),
        F.greatest("last_seen", "last").alias("last_seen"),
        F.when(here, F.col("merged")).otherwise(F.col("leaves")).alias("leaves"),
    )
    tables = {"records": versions.stored(after, root, ("record",), n)}

    events = links.where(placed & F.col("evidence").isNotNull()).join(batch.select("record", "seq"), ["record", "seq"], "left_semi")
    events = events.groupBy("record", "evidence", "seq").agg(F.min("added").alias("added"))
    events = written(merge.greatest_before(events, ["record", "evidence"], F.struct("seq", "added"), block), "links")
    last = events.groupBy("record", "evidence").agg(F.max_by("added", "seq").alias("added")).repartition(n, "record", "evidence")
    joined = linked.withColumn("had", F.lit(True)).join(last, ["record", "evidence"], "full_outer")
    tables["links"] = versions.stored(joined.where(F.coalesce("added", "had")).select("record", "evidence"), root, ("record", "evidence"), n)

    had = linked.join(last.select("record", "evidence"), ["record", "evidence"], "left_semi").withColumn("had", F.lit(True))
    stands = F.coalesce("__before.added", "had", F.lit(False))
    counted = events.join(had, ["record", "evidence"], "left").groupBy("record", "seq").agg(F.count_if(F.col("added") & ~stands).alias("links_added"), F.count_if(~F.col("added") & stands).alias("links_removed"))
    known = old.select("record").withColumn("known", F.lit(True))
    told = batch.join(spans.select("record", "first_seq"), "record").join(known, "record", "left").join(counted, ["record", "seq"], "left")
    created = F.col("known").isNull() & (F.col("seq") == F.col("first_seq"))
    told = told.select("record", "seq", created.alias("created"), (~created).alias("updated"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("links_added", "links_removed")], F.lit(None).cast("string").alias("reason"))
    lost = writes.where(~placed).select("record", "seq", F.lit(False).alias("created"), F.lit(False).alias("updated"), F.lit(0).cast("bigint").alias("links_added"), F.lit(0).cast("bigint").alias("links_removed"), F.lit("no record or seq").alias("reason"))
    return tables, told.unionByName(lost)
