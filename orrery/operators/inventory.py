"""From page URLs to endpoint, name and parameter records, their relations, and counts by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import dns, grammar, identity


def endpoints(pages: DataFrame) -> DataFrame:
    """page_id, seen (long), url (canonical), host, query, key, node_id of pages with a valid URL."""
    bare = pages.select("page_id", F.col("page_id").cast("long").alias("seen"), F.regexp_replace("url", "#.*", "").alias("full"))
    parts = grammar.url_parts(F.col("full"))
    clean = bare.where(grammar.is_http_url(F.col("full"))).select("page_id", "seen", grammar.drop_query(F.col("full")).alias("url"), parts["host"].alias("host"), parts["query"].alias("query"))
    key = identity.key(url=F.col("url"), method=F.lit("GET"))
    return clean.withColumn("key", key).withColumn("node_id", identity.node_id(F.lit("endpoint"), F.col("key")))


def seen_span(records: DataFrame) -> DataFrame:
    """One row per node_id: key, first and last seen, number of observations."""
    return records.groupBy("node_id", "key").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count(F.lit(1)).alias("n"))


def _names() -> Column:
    """The distinct names in a query."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce("query", F.lit("")), "&"), lambda pair: F.split_part(pair, F.lit("="), F.lit(1))), lambda name: name != ""))


def _parameter_key() -> Column:
    return identity.key(name=F.col("name"), location=F.lit("query"), parent=F.col("parent"))


def parameters(found: DataFrame) -> DataFrame:
    """Query parameters, scoped to their endpoint: parent, name, key, node_id; one row per record."""
    named = found.where("query <> ''").select(F.col("node_id").alias("parent"), F.explode(_names()).alias("name")).distinct()
    return named.withColumn("key", _parameter_key()).withColumn("node_id", identity.node_id(F.lit("parameter"), F.col("key")))


def host_names(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Domains and subdomains of the hosts, with the registrable domain of each subdomain as a record of its own."""
    kinds = dns.classify(found.select(F.col("host").alias("name")), rules).where("kind is not null")
    above = F.when(F.col("kind") == "subdomain", F.struct(F.col("registrable").alias("name"), F.lit("domain").alias("kind")))
    rows = kinds.select(F.explode(F.array_compact(F.array(F.struct("name", "kind"), above))).alias("r")).select("r.name", "r.kind").distinct()
    return rows.withColumn("key", identity.key(value=F.col("name"))).withColumn("node_id", identity.node_id(F.col("kind"), F.col("key")))


def nodes(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """node_id, type, key of everything that the pages name; pages are read once for endpoints and parameters, once for names."""
    found = endpoints(pages)
    # of each endpoint: itself (no name), and its parameters
    each = found.select(F.col("node_id").alias("parent"), F.col("key").alias("own"), F.explode(F.concat(F.array(F.lit(None).cast("string")), _names())).alias("name"))
    is_own = F.col("name").isNull()
    keyed = each.withColumn("key", F.when(is_own, F.col("own")).otherwise(_parameter_key()))
    node = F.when(is_own, F.col("parent")).otherwise(identity.node_id(F.lit("parameter"), F.col("key")))
    located = keyed.select(node.alias("node_id"), F.when(is_own, "endpoint").otherwise("parameter").alias("type"), "key").distinct()
    return located.union(host_names(found, rules).select("node_id", "kind", "key"))


def relations(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """rel_id, type, source_id, source_type, target_id, target_type, key: has_parameter and has_subdomain."""
    found = endpoints(pages)
    has_parameter = parameters(found).select(F.lit("has_parameter").alias("type"), F.col("parent").alias("source_id"), F.lit("endpoint").alias("source_type"), F.col("node_id").alias("target_id"), F.lit("parameter").alias("target_type"))
    kinds = dns.classify(found.select(F.col("host").alias("name")), rules).where("kind = 'subdomain'")
    of = lambda kind, name: identity.node_id(F.lit(kind), identity.key(value=F.col(name)))
    has_subdomain = kinds.select(F.lit("has_subdomain"), of("domain", "registrable"), F.lit("domain"), of("subdomain", "name"), F.lit("subdomain"))
    both = has_parameter.union(has_subdomain).withColumn("key", F.lit(""))
    return both.withColumn("rel_id", identity.relation_id(F.col("source_id"), F.col("type"), F.col("target_id"), F.col("key")))


def scoped(records: DataFrame, rounds: int = 3) -> DataFrame:
    """records (ref, type, parent, members) -> ref, type, parent_id, key, node_id, parents before what they hold.

    members maps identity properties to JSON values; parent is the ref of the record that scopes this one (null: none).
    A record whose chain of parents is longer than `rounds`, or leads to no record, is left out.  Each round is a join on
    the parent, so no chain is followed row by row.
    """

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumn("key", identity.key_of("members", "parent_id")).select("ref", "type", "parent_id", "key", identity.node_id(F.col("type"), F.col("key")).alias("node_id"))

    level = named(records.where("parent is null").withColumn("parent_id", F.lit(None).cast("string")))
    placed = level
    for _ in range(rounds - 1):
        above = level.select(F.col("ref").alias("parent"), F.col("node_id").alias("parent_id"))
        level = named(records.join(above, "parent"))
        placed = placed.union(level)
    return placed


def counts(records: DataFrame) -> DataFrame:
    return records.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
