"""Comparing the members of buckets pair by pair, in cells of bounded size.

A bucket of n rows is split into parts of about `size` rows, and of about CELL_BYTES where rows have a
weight, by a hash of the row's id; each pair of parts is a cell, and a row goes to the cells of its part.
So no task ever holds more than two parts of one bucket, whatever its share of all rows, and every pair of
the bucket meets in exactly one cell.  A row is copied once for each part of its bucket: n * n / size rows
for a bucket of n.  Buckets of one row are dropped before anything is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.textblocks import lean


#: Of the weights of one part, and of a table of whole cells.
CELL_BYTES = 4 << 20
TABLE_BYTES = 16 << 20


def cells(rows: DataFrame, bucket: str, row_id: str, size: int, weight: Column | None = None) -> DataFrame:
    """rows with the columns cell, part and cross (whether only rows of different parts are to meet), sorted by cell in each partition."""
    held = F.sum(weight if weight is not None else F.lit(0)).alias("__held")
    many = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("__n"), held).where("__n > 1")
    parts = F.greatest(F.ceil(F.col("__n") / size), F.ceil(F.col("__held") / CELL_BYTES))
    placed = rows.join(many, bucket).withColumn("__parts", parts.cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64(row_id, F.lit(11)), F.col("__parts")).cast("int"))
    spread = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    low, high = F.least("part", "__other"), F.greatest("part", "__other")
    keyed = spread.withColumn("cell", F.xxhash64(bucket, low, high)).withColumn("cross", low != high)
    return keyed.drop("__n", "__held", "__parts", "__other").repartition("cell").sortWithinPartitions("cell")


def whole_cells(batches: Iterator[pa.RecordBatch], least: int = 4096) -> Iterator[pa.Table]:
    """Tables of complete cells, of `least` rows or TABLE_BYTES, or a little more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < least and sum(x.nbytes for x in held) < TABLE_BYTES:
            continue
        table = pa.Table.from_batches(held)
        cell = table.column("cell").to_numpy()
        cut = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def meetings(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows that meet, a bounded number at a time."""
    cell, part = table.column("cell").to_numpy(), table.column("part").to_numpy()
    cross = table.column("cross").to_numpy(zero_copy_only=False)
    edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    longest = int(np.diff(np.append(edge, len(cell))).max(initial=0))
    for lag in range(1, longest):
        left = np.flatnonzero((cell[lag:] == cell[:-lag]) & (~cross[:-lag] | (part[lag:] != part[:-lag])))
        for lo in range(0, len(left), 1 << 15):
            yield left[lo : lo + (1 << 15)], left[lo : lo + (1 << 15)] + lag


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of links between ids: (id, number of its links, least id that it reaches)."""
    ids, end = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = end[: len(a)], end[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return ids, np.bincount(end, minlength=len(ids)), ids[label]


def compare(rows: DataFrame, bucket: str, row_id: str, linked: Callable, size: int = 512, weight: Column | None = None) -> DataFrame:
    """Links inside buckets: id, n (links found, to be summed) and root (a link to follow).

    linked(table) gives two functions (left, right) -> mask: the first sees pairs as they meet, a
    bounded number at a time; the second (or None) sees all that the first let through.
    """

    def run(batches):
        for table in whole_cells(batches):
            ids, (test, settle), found = table.column(row_id).to_numpy(), linked(table), []
            for left, right in meetings(table):
                mask = (ids[left] != ids[right]) & test(left, right)
                if mask.any():
                    found.append((left[mask], right[mask]))
            if found:
                left, right = (np.concatenate(x) for x in zip(*found))
                if settle:
                    mask = settle(left, right)
                    left, right = left[mask], right[mask]
                node, n, root = forest(ids[left], ids[right])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(root)], ["id", "n", "root"])

    return cells(rows, bucket, row_id, size, weight).mapInArrow(lean(run), "id bigint, n bigint, root bigint")
