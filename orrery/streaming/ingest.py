"""Continuous ingestion: observations merged by record, evidence by content.

The state of a record (when it was seen, how often, and its leaves) is the last row of each of its paths in a change log, one folder an epoch.  A micro-batch
reads the state of its own records only, merges its writes into it as a whole (merge.with_fresh, merge.merge_leaves: joins and grouped maxima, so no record's writes
are one group), and hands on what it changed.  A replayed epoch reads the log as it was before it and overwrites its folder; a restarted run goes on from the
checkpoint.  `Changes.compact` joins old epochs to one base, in folders by a hash of the record: a batch opens the folders of its records.  A log that is
compacted from time to time is about as large as the table it stands for.

Nothing is ever too late for a merge (an old observation fills gaps and lowers first_seen), so there is no watermark.  Observations from the future are
refused into a folder of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import merge
from orrery.sources import storage

CHANGES = "record string, path string, value string, gone boolean, created boolean, first_seen bigint, last_seen bigint, n bigint"
#: Folders of a base.
BUCKETS = 64
#: Before all sequence numbers of a batch.
_BEFORE = -(1 << 62)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("record"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _spans(batch: DataFrame, before: DataFrame) -> DataFrame:
    """A row without path for each record of a batch: its times and number of rows, and created where it was not known before."""
    seen = F.when(F.col("reporting"), F.col("observed"))
    new = batch.groupBy("record").agg(F.min(seen).alias("first"), F.max(seen).alias("last"), F.count(F.lit(1)).alias("more"))
    known = before.where("path is null").select("record", F.lit(True).alias("known"), "first_seen", "last_seen", "n")
    nothing = F.lit(None).cast("string")
    return new.join(known, "record", "left").select(
        "record",
        nothing.alias("path"),
        nothing.alias("value"),
        F.lit(False).alias("gone"),
        F.col("known").isNull().alias("created"),
        F.least("first_seen", "first").alias("first_seen"),
        F.greatest("last_seen", "last").alias("last_seen"),
        (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"),
    )


def _leaves(batch: DataFrame, before: DataFrame) -> DataFrame:
    """A row for each path of the batch's records that is new, has another value or is gone; what stood counts as the first write."""
    none = lambda kind: F.lit(None).cast(kind)
    ties = [c for c in batch.columns if c == "tie"]
    first = before.where("path is null").select("record", none("string").alias("path"), F.lit(_BEFORE).alias("seq"), F.col("last_seen").alias("observed"), F.col("last_seen").isNotNull().alias("reporting"), F.lit(False).alias("removed"), none("string").alias("value"))
    timed = merge.with_fresh(batch.unionByName(first, allowMissingColumns=True), ties=tuple(ties)).where("path is not null")
    stood = before.where("path is not null").select("record", "path", "value")
    leaves = stood.select("record", "path", F.lit(_BEFORE).alias("seq"), F.lit(True).alias("fresh"), F.lit(False).alias("removed"), "value")
    after = merge.merge_leaves(leaves.unionByName(timed.select(*leaves.columns))).select("record", "path", F.struct("value").alias("new"))
    both = stood.select("record", "path", F.struct("value").alias("old")).join(after, ["record", "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("record", "path", "new.value", F.col("new").isNull().alias("gone"), none("boolean").alias("created"), *[none("bigint").alias(c) for c in ("first_seen", "last_seen", "n")])


class Changes:
    """A change log in a folder: epoch=<n> has the changes of a batch, base-<n> all that stood after epoch n; the last complete base counts."""

    def __init__(self, folder: str):
        self.folder = folder

    def _epochs(self, spark: SparkSession, prefix: str) -> list[int]:
        """Numbers of the complete folders with this prefix."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        made = spark._jvm.org.apache.hadoop.fs.Path
        done = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith(prefix)]
        return sorted(int(p.getName()[len(prefix) :]) for p in done if fs.exists(made(p, "_SUCCESS")))

    def append(self, changes: DataFrame, epoch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def holds(self, spark: SparkSession, epoch: int) -> bool:
        """Whether the epoch is part of a base."""
        return max(self._epochs(spark, "base-"), default=-1) >= epoch

    def read(self, spark: SparkSession, until: int | None = None, records: DataFrame | None = None) -> DataFrame:
        """The last row of each record and path; of epochs before `until` and of these records (record) only, where they are given."""
        base = max(self._epochs(spark, "base-"), default=-1)
        later = [e for e in self._epochs(spark, "epoch=") if e > base and (until is None or e < until)]
        rows = spark.createDataFrame([], CHANGES).withColumn("epoch", F.lit(-1).cast("bigint"))
        if base >= 0:
            old = spark.read.schema(f"{CHANGES}, bucket int").parquet(f"{self.folder}/base-{base}")
            if records is not None:
                old = old.where(F.col("bucket").isin([r.bucket for r in records.select(_bucket()).distinct().collect()]))
            rows = rows.unionByName(old.drop("bucket").withColumn("epoch", F.lit(base).cast("bigint")))
        if later:
            found = spark.read.schema(CHANGES).parquet(*[f"{self.folder}/epoch={e}" for e in later])
            rows = rows.unionByName(found.withColumn("epoch", F.regexp_extract(F.col("_metadata.file_path"), r"epoch(?:=|%3D)(\d+)", 1).cast("bigint")))
        if records is not None:
            rows = rows.join(records, "record", "left_semi")
        held = F.max_by(F.struct("value", "gone", "created", "first_seen", "last_seen", "n"), "epoch").alias("held")
        return rows.groupBy("record", "path").agg(held).select("record", "path", "held.*").where("not gone")

    def compact(self, spark: SparkSession) -> None:
        """One base of all epochs up to now; what it replaces is deleted once the base is complete."""
        epochs, bases = self._epochs(spark, "epoch="), self._epochs(spark, "base-")
        if not epochs or epochs[-1] <= max(bases, default=-1):
            return
        whole = self.read(spark).withColumn("bucket", _bucket()).repartition(BUCKETS, "bucket")
        whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/base-{epochs[-1]}")
        made = spark._jvm.org.apache.hadoop.fs.Path
        for name in [*(f"epoch={e}" for e in epochs), *(f"base-{b}" for b in bases)]:
            old = made(f"{self.folder}/{name}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    def spans(self, spark: SparkSession) -> DataFrame:
        return self.read(spark).where("path is null").select("record", "first_seen", "last_seen", "n")

    def leaves(self, spark: SparkSession) -> DataFrame:
        return self.read(spark).where("path is not null").select("record", "path", "value")


def ingest(stream: DataFrame, folder: str, now_us: int | None = None, skew_s: int = 300, compact_every: int = 50) -> Changes:
    """Run a stream of writes (record, path, seq, observed, reporting, removed, value), in the order of arrival, to its present end; the change log.

    The rows of one record and seq are one write.  Where seq is not unique to a write, a column `tie` (bigint) orders those of one seq for their freshness; the merge takes
    their removals before what they set.  A stream of (record, seq, observed, reporting) has no leaves.  Writes without a record, seq or observed have no place and are
    refused, as are those from the future of now_us; refused ones are written aside.
    """
    spark, log = stream.sparkSession, Changes(f"{folder}/changes")
    future = F.lit(False) if now_us is None else F.col("observed") > now_us + skew_s * 1_000_000
    good = F.col("record").isNotNull() & F.col("seq").isNotNull() & F.col("observed").isNotNull() & F.coalesce(~future, F.lit(False))
    refused = stream.where(~good)
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    leaves = ["path", flag("removed"), "value"] if "path" in stream.columns else []
    ties = [c for c in stream.columns if c == "tie"]
    shaped = stream.where(good).select(F.col("record").cast("string").alias("record"), F.col("seq").cast("bigint").alias("seq"), F.col("observed").cast("bigint").alias("observed"), flag("reporting"), *leaves, *ties)

    def keep(batch: DataFrame, epoch: int) -> None:
        if not log.holds(spark, epoch):
            with storage.scratch(spark, f"{folder}/scratch"):
                path = storage.fresh(spark, "batch")
                batch.write.parquet(path)
                came = spark.read.schema(batch.schema).parquet(path)  # in the caller's session, whose plans adapt
                before = storage.written(log.read(spark, epoch, came.select("record").distinct()), "before")
                changed = _spans(came, before)
                log.append(changed.unionByName(_leaves(came, before)) if leaves else changed, epoch)
        if epoch % compact_every == compact_every - 1:
            log.compact(spark)

    merged = shaped.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    aside = refused.writeStream.format("parquet").option("path", f"{folder}/refused").option("checkpointLocation", f"{folder}/refused-progress").trigger(availableNow=True).start()
    merged.awaitTermination()
    aside.awaitTermination()
    return log


def ingest_spans(stream: DataFrame, folder: str, now_us: int) -> DataFrame:
    """Run a stream of (record, observed) to its present end: record, first_seen, last_seen, n."""
    rows = stream.select("record", F.col("observed").alias("seq"), "observed", F.lit(True).alias("reporting"))
    return ingest(rows, folder, now_us).spans(stream.sparkSession)


def ingest_merge(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream of writes, in the order of arrival, to its present end: the merged leaves (record, path, value)."""
    return ingest(stream, folder).leaves(stream.sparkSession)


def distinct_evidence(stream: DataFrame) -> DataFrame:
    """A stream of (content) reduced to the first of each content: evidence_id, byte_size."""
    named = stream.select(F.concat(F.lit("e_"), F.sha2("content", 256)).alias("evidence_id"), F.octet_length("content").alias("byte_size"))
    return named.dropDuplicates(["evidence_id"])


def replaced(index: DataFrame, changed: DataFrame, owner: str) -> DataFrame:
    """Index rows after a batch: those of touched owners are replaced, all others stay."""
    return index.join(changed.select(owner).distinct(), owner, "left_anti").unionByName(changed)
