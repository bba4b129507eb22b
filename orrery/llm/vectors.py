"""Rows of vectors that hold numbers only, and their integers as matrices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (double precision) of the rows whose vector is not null, not empty, and holds finite numbers only."""
    vector = F.col("embedding").cast("array<double>")
    whole = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector")).where((F.size("vector") > 0) & whole)


def common_length(vectors: DataFrame) -> int:
    """The length that most vectors have, the greater one of equally frequent ones; 0 where there are none."""
    many = vectors.groupBy(F.size("vector").alias("dim")).count()
    found = many.orderBy(F.desc("count"), F.desc("dim")).first()
    return found["dim"] if found else 0


def floors(column: pa.Array, dim: int, scale: int, limit: int) -> np.ndarray:
    """(rows, dim): floor(scale * component) as 64-bit integers; an error where one lies beyond the limit."""
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * float(scale))
    if scaled.size and np.abs(scaled).max() > limit:
        raise ValueError(f"a component lies beyond {limit / scale:g}: its squares do not fit into 64-bit integers")
    return scaled.astype(np.int64)
