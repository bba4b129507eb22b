"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.textblocks import trim

#: Bounds of a fitting sample: labelled rows of each class, and bytes of text altogether, half for each class.
ROWS_PER_CLASS = 6000
TEXT_BYTES = 10 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of the documents whose labels no fit may see."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def fitting(sizes: list, text_bytes: int) -> list:
    """Of rows with a size n, in their order, each that still fits into text_bytes."""
    taken, total = [], 0
    for row in sizes:
        if total + row.n <= text_bytes:
            total += row.n
            taken.append(row)
    return taken


def class_share(labels: DataFrame, column: str) -> float | None:
    """The share of class 1 among the labels that are not held out."""
    return labels.where(F.col("doc_id").isNotNull() & ~held_out()).agg(F.avg(F.col(column).cast("double"))).first()[0]


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int = ROWS_PER_CLASS, text_bytes: int = TEXT_BYTES) -> pa.Table:
    """Texts and 0/1 labels (text, y) of documents that are not held out.

    Of each class the `rows` ids with the least hash; of these, in the order of the hash, those whose
    text still fits into the class' share of text_bytes: a half, and what the other class leaves of its own.
    A text that does not fit is skipped.  Null labels and ids are left out; where an id has several labels
    the largest counts; of documents that share an id each row counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("y"))
    order = F.xxhash64("doc_id", F.lit(5))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).withColumn("h", order).orderBy("h").limit(rows)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most 2 * rows ids are broadcast
    sizes = texts.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(picked), "doc_id").groupBy("h", "doc_id", "y").agg(F.sum("n").alias("n")).orderBy("h").collect()
    chosen, left = [], text_bytes
    classes = sorted(([r for r in sizes if r.y == y] for y in (0, 1)), key=lambda part: sum(r.n for r in part))
    for k, part in enumerate(classes):  # the smaller class first
        taken = fitting(part, left // (len(classes) - k))
        left -= sum(r.n for r in taken)
        chosen += [(r.doc_id, r.y) for r in taken]
    ids = docs.sparkSession.createDataFrame(sorted(chosen), "doc_id bigint, y int")
    table = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y").toArrow().sort_by("doc_id").select(["text", "y"])
    trim()
    return table
