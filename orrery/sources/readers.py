"""Readers of tool output and write requests, writers of the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One variant per line (record); lines that are no JSON give null and keep their text."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.try_parse_json("value").alias("record"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents whose top level is one record or an array of records: one variant per record."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("document"))
    parts = F.coalesce(F.try_variant_get("document", "$", "array<variant>"), F.array("document"))
    return whole.select(F.explode(parts).alias("record"))


def xml_records(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """Elements `row` of XML files; attributes as _name."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def key_values(texts: DataFrame, row_id: str, text: str) -> DataFrame:
    """`Key: value` lines -> owner, key (lower case), values in order; comment and notice lines are skipped."""
    lines = texts.select(F.col(row_id).alias("owner"), F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    pairs = lines.where(F.col("line").rlike(r"\A\s*[A-Za-z][A-Za-z0-9 /_-]*:\s*\S") & ~F.col("line").rlike(r"\A\s*(?:%|#|>>>)"))
    named = pairs.select("owner", "at", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_replace("line", r"\A[^:]*:", "")).alias("value"))
    sorted_values = F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    return named.groupBy("owner", "key").agg(sorted_values.alias("values"))


def evidence_bytes(text: Column | None = None, base64: Column | None = None) -> Column:
    """Bytes of inline text or of strict base64; null where the base64 is none."""
    return F.encode(text, "UTF-8") if text is not None else F.try_to_binary(base64, F.lit("base64"))


#: Fields of a write (fixed names); those of one kind follow.
WRITE = "id string, type string, properties string, source string, observed_at string, remove_properties array<string>, evidence_add array<string>, evidence_remove array<string>"
NODE = "label string, ownership string, authorization string, allowlist_scoped boolean"
RELATION = "source_ref struct<id string, node_index int>, target_ref struct<id string, node_index int>"


def request_items(requests: DataFrame) -> DataFrame:
    """requests (batch_id, request: JSON) -> one row per item: batch_id, kind, item_index, named, and the fields of writes.

    named lists the fields that the item names, also with null; properties stay JSON, so values keep their types; of the
    fields of the other kind all are null.  A request that is no JSON, or names no items, has no rows.
    """
    parsed = requests.select("batch_id", F.from_json("request", "nodes array<string>, relations array<string>").alias("r"))
    of = lambda kind, name: parsed.select("batch_id", F.lit(kind).alias("kind"), F.posexplode(f"r.{name}").alias("item_index", "item"))
    items = of("node", "nodes").unionByName(of("relation", "relations"))
    read = items.withColumn("named", F.array_sort(F.json_object_keys("item"))).withColumn("i", F.from_json("item", ", ".join((WRITE, NODE, RELATION))))
    return read.select("batch_id", "kind", "item_index", "named", "i.*")


def write_table(rows: DataFrame, path: str, by: str = "type") -> None:
    """A graph table as Parquet, a folder for each type; a new version goes to a new path, which the caller then swaps in."""
    rows.write.mode("errorifexists").partitionBy(by).parquet(path)


def quarantine(items: DataFrame, path: str) -> None:
    """Append refused items with their reason."""
    items.where("reason is not null").write.mode("append").parquet(path)


def exported(records: DataFrame, columns: list[str]) -> DataFrame:
    """node_id and its record as canonical JSON."""
    return records.select("node_id", F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("record"))
