"""Where tables of a session go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession, folder: str) -> Iterator[None]:
    """New paths lie in this folder meanwhile; it is deleted before and after."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path, True)
    held = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(held)
        fs.delete(path, True)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the whole cluster shares (spark.checkpoint.dir); on one machine without that setting a temporary one."""
    shared = _SCRATCH.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there; survives lost executors."""
    path = fresh(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
