"""Versions of all tables under one manifest.

A table is a folder that is written once, under a name of its own, and never changed.  A manifest names the folders of all tables of one version; manifests are
numbered without gaps, and the next one is put in place by one rename that fails where another writer was first.  So all tables move
together: a job that dies between two tables leaves folders that no manifest names, and readers stay on the version they took.

Tables may lie in buckets: rows of one key are in one file, and joins on the key read them without an exchange.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Table(NamedTuple):
    path: str
    schema: str  # DDL
    keys: tuple[str, ...] = ()
    buckets: int = 0


class Conflict(Exception):
    """Another writer made the version that this one wanted to make."""


def _files(spark: SparkSession, root: str):
    """Hadoop's view of the folder: (names, context, path)."""
    fs = spark._jvm.org.apache.hadoop.fs
    return fs, fs.FileContext.getFileContext(fs.Path(root).toUri(), spark._jsc.hadoopConfiguration()), fs.Path


def _listed(context, path) -> list:
    if not context.util().exists(path):
        return []
    return list(context.util().listStatus(path))


def stored(rows: DataFrame, root: str, keys: tuple[str, ...] = (), buckets: int = 0) -> Table:
    """Write a table of a coming version; nobody sees it before `commit`.  With keys, in buckets: rows should come partitioned so, else each task writes to each bucket."""
    path = f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}"
    writer = rows.write.mode("errorifexists").option("compression", "zstd")
    if buckets:
        name = f"bucketed_{uuid.uuid4().hex}"
        writer.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
        rows.sparkSession.sql(f"DROP TABLE {name}")  # its name only: the files lie outside the warehouse
    else:
        writer.parquet(path)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return Table(path, ddl, tuple(keys), buckets)


def opened(spark: SparkSession, table: Table) -> DataFrame:
    """The rows of a table; one in buckets is known as such to the planner."""
    if not table.buckets:
        return spark.read.schema(table.schema).parquet(table.path)
    name = "bucketed_" + table.path.rstrip("/").rsplit("/", 1)[-1]
    keys = ", ".join(f"`{k}`" for k in table.keys)
    location = table.path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({table.schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {table.buckets} BUCKETS LOCATION '{location}'")
    return spark.table(name)


def latest(spark: SparkSession, root: str) -> int | None:
    """The number of the last version; null where there is none."""
    _, context, path = _files(spark, root)
    numbers = [s.getPath().getName().removesuffix(".json") for s in _listed(context, path(f"{root}/manifests"))]
    return max((int(n) for n in numbers if n.isdigit()), default=None)


def manifest(spark: SparkSession, root: str, version: int) -> dict[str, Table]:
    """The tables of a version."""
    text = spark.read.text(f"{root}/manifests/{version:012d}.json", wholetext=True).first()[0]
    return {name: Table(t["path"], t["schema"], tuple(t["keys"]), t["buckets"]) for name, t in json.loads(text).items()}


def commit(spark: SparkSession, root: str, tables: dict[str, Table], base: int | None) -> int:
    """Make the version after `base` (null: the first).  Tables that are not named stay as in base.  `Conflict` where that version is there already, or base is not."""
    whole = {**({} if base is None else manifest(spark, root, base)), **tables}
    version = 0 if base is None else base + 1
    fs, context, path = _files(spark, root)
    text = json.dumps({name: t._asdict() for name, t in sorted(whole.items())}, indent=1)
    gateway = spark.sparkContext._gateway
    none = gateway.new_array(getattr(fs, "Options$CreateOpts"), 0)
    flags = spark._jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE)
    made, place = path(f"{root}/coming/{uuid.uuid4().hex}.json"), path(f"{root}/manifests/{version:012d}.json")
    for folder in (made, place):
        context.mkdir(folder.getParent(), fs.permission.FsPermission.getDirDefault(), True)
    out = context.create(made, flags, none)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        context.rename(made, place, gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Exception as failed:
        context.delete(made, False)
        if context.util().exists(place):
            raise Conflict(f"version {version} is there already") from failed
        raise
    return version


def collect(spark: SparkSession, root: str, keep: int, older_than_ms: int) -> list[str]:
    """Delete manifests before the last `keep`, and tables that none of those names and that were made before a time (folders of jobs that run now are younger)."""
    _, context, path = _files(spark, root)
    last = latest(spark, root)
    first = 0 if last is None else max(0, last + 1 - keep)
    kept = set() if last is None else {t.path.rstrip("/").rsplit("/", 1)[-1] for v in range(first, last + 1) for t in manifest(spark, root, v).values()}
    gone = []
    for status in _listed(context, path(f"{root}/manifests")):
        if int(status.getPath().getName().removesuffix(".json")) < first:
            context.delete(status.getPath(), False)
    for folder in ("tables", "coming"):
        for status in _listed(context, path(f"{root}/{folder}")):
            name = status.getPath().getName()
            if name not in kept and status.getModificationTime() < older_than_ms:
                context.delete(status.getPath(), True)
                gone.append(name)
    return gone
