"""Counts and checks over the graph's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def link_counts(links: DataFrame) -> DataFrame:
    """links (node_id, evidence_id) -> node_id, link_count, source_count (different evidence)."""
    pairs = links.groupBy("node_id", "evidence_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("node_id").agg(F.sum("n").alias("link_count"), F.count(F.lit(1)).alias("source_count"))


def missing(asked: DataFrame, known: DataFrame, column: str) -> DataFrame:
    return asked.join(known.select(column), column, "left_anti").select(column)


def seed_reasons(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked (node_id) -> node_id, reason: why no traversal starts there (`missing`, `pending`: it is being deleted); null where one may.  nodes (node_id, lifecycle)."""
    joined = asked.select("node_id").distinct().join(nodes.select("node_id", F.coalesce("lifecycle", F.lit("")).alias("lifecycle")), "node_id", "left")
    return joined.select("node_id", F.when(F.col("lifecycle").isNull(), "missing").when(F.col("lifecycle") != "ready", "pending").alias("reason"))


def sizes(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows and text bytes of each table."""
    out = None
    for name, (rows, columns) in tables.items():
        bytes_ = F.sum(sum((F.octet_length(c) for c in columns[1:]), F.octet_length(columns[0])))
        one = rows.agg(F.count(F.lit(1)).alias("n"), bytes_.alias("text_bytes")).select(F.lit(name).alias("name"), "n", "text_bytes")
        out = one if out is None else out.unionByName(one)
    return out


def ipv4_number(address: Column) -> Column:
    part = lambda k: F.split_part(address, F.lit("."), F.lit(k)).cast("long")
    return ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)


def ipv4_inside(address: Column, network: Column) -> Column:
    """Whether a canonical IPv4 address lies in a canonical network."""
    base, bits = F.split_part(network, F.lit("/"), F.lit(1)), F.split_part(network, F.lit("/"), F.lit(2)).cast("int")
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    return F.floor(ipv4_number(address) / size) == F.floor(ipv4_number(base) / size)
