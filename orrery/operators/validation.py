"""Reasons why records, relations and batches are refused; null where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import grammar
from orrery.operators import checks
from orrery.operators.catalog import NODES, RELATIONS


#: Checks of whole records, after their properties: type -> reasons from its property columns.
RECORD_CHECKS = {
    "advisory": lambda p: checks.cve_scores(p("value"), p("cvss_score"), p("cvss_vector"), p("epss_score"), p("epss_percentile")),
    "asn": lambda p: checks.assigned(p("value"), "value"),
    "cloud_account": lambda p: checks.account_spelling(p("provider"), p("account_id")),
    "http_fingerprint": lambda p: checks.fingerprint_kind(p("kind"), p("value")),
    "identity_tenant": lambda p: checks.tenant_spelling(p("provider"), p("tenant_id")),
    "ip_address": lambda p: checks.address_version(p("value"), p("version")),
    "ip_cidr": lambda p: checks.network_version(p("value"), p("version")),
    "port": lambda p: checks.assigned(p("number"), "number"),
    "registrar": lambda p: checks.assigned(p("iana_id"), "iana_id"),
    "repository": lambda p: checks.owner_spelling(p("platform"), p("owner")),
    "storage_bucket": lambda p: checks.bucket_spelling(p("provider"), p("name")),
    "technology": lambda p: checks.product_level(p("cpe")),
    "tls_fingerprint": lambda p: checks.fingerprint_length(p("kind"), p("value")),
    "txt_record": lambda p: checks.txt_diversion(p("value")),
    "whois_registration": lambda p: checks.registry_object(p("registry_domain_id")),
}


def node_reason(kind: str, properties: dict[str, Column]) -> Column:
    """Of one node type: the first required property that is missing or wrong, then the first optional one that is wrong, then the check of the whole record.

    Checks that need a table (kinds of names, service names, cloud host names, plaintext keys) are joins of their own: dns.classify, unknown_services, hosts.classify, jsonwalk.
    """
    definition, reasons = NODES[kind], []
    named = lambda rule: rule if isinstance(rule, str) else "not listed"
    for name, rule in definition.required.items():
        value = properties.get(name)
        if value is None:
            reasons.append(F.lit(f"{name}: required"))
            continue
        reasons.append(F.when(value.isNull(), f"{name}: required").when(~grammar.valid(rule, value), f"{name}: {named(rule)}"))
    for name, rule in definition.optional.items():
        if name in properties:
            reasons.append(F.when(~grammar.valid(rule, properties[name]), f"{name}: {named(rule)}"))
    if kind in RECORD_CHECKS:
        reasons.append(RECORD_CHECKS[kind](lambda name: properties.get(name, F.lit(None).cast("string"))))
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def unknown_services(services: DataFrame, names: DataFrame) -> DataFrame:
    """services (name, secure) with the column reason, by the table names (name, secure_required): unknown, or without the flag that it needs."""
    known = names.select("name", F.coalesce("secure_required", F.lit(False)).alias("__secure")).groupBy("name").agg(F.max("__secure").alias("__secure"))
    joined = services.join(known, "name", "left")
    return joined.withColumn("reason", F.when(F.col("__secure").isNull(), "name: unknown service").when(F.col("__secure") & F.col("secure").isNull(), "secure: required")).drop("__secure")


def relation_ends(spark) -> DataFrame:
    """The catalog's accepted ends: type, source_type, target_type, self_edge."""
    rows = [(name, s, t, r.self_edge) for name, r in RELATIONS.items() for s in r.sources for t in r.targets]
    return spark.createDataFrame(rows, "type string, source_type string, target_type string, self_edge boolean")


def end_reasons(relations: DataFrame) -> DataFrame:
    """relations (type, source_id, source_type, target_id, target_type) with the column reason."""
    ends = relation_ends(relations.sparkSession)
    known = ends.select("type").distinct().withColumn("known", F.lit(True))
    joined = relations.join(known, "type", "left").join(ends.withColumn("fits", F.lit(True)), ["type", "source_type", "target_type"], "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown relation type")
        .when(F.col("fits").isNull(), "end types")
        .when((F.col("source_id") == F.col("target_id")) & ~F.col("self_edge"), "self edge")
    )
    return joined.withColumn("reason", reason).drop("known", "fits", "self_edge")


def single_parent(scope_relations: DataFrame) -> DataFrame:
    """Children (target_id, type) that more than one source claims."""
    return scope_relations.groupBy("target_id", "type").agg(F.countDistinct("source_id").alias("parents")).where("parents > 1")


def scope_counts(items: DataFrame, scope_relations: DataFrame) -> DataFrame:
    """New scoped items (batch_id, node_index) without exactly one scope relation in their batch, with their number."""
    n = scope_relations.groupBy("batch_id", "node_index").agg(F.count(F.lit(1)).alias("n"))
    return items.select("batch_id", "node_index").join(n, ["batch_id", "node_index"], "left").select("batch_id", "node_index", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def repeated_identities(items: DataFrame) -> DataFrame:
    """Identities that one batch names more than once: batch_id, type, key, n."""
    return items.groupBy("batch_id", "type", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def atomic(items: DataFrame) -> DataFrame:
    """Items (batch_id, reason) of batches in which no item has a reason."""
    return items.join(items.where("reason is not null").select("batch_id").distinct(), "batch_id", "left_anti")


def refused(items: DataFrame) -> DataFrame:
    """All items of batches with a bad item: their own reason, else that the batch was refused."""
    bad = items.where("reason is not null").select("batch_id").distinct()
    return items.join(bad, "batch_id", "left_semi").withColumn("reason", F.coalesce("reason", F.lit("batch refused")))


def resolve(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """references (batch_id, node_index, id) with node_id: by id, or by place in the batch; null where there is none."""
    by_place = nodes.select("batch_id", "node_index", F.col("node_id").alias("placed"))
    by_id = nodes.select(F.col("node_id").alias("id")).distinct().withColumn("named", F.col("id"))
    joined = references.join(by_place, ["batch_id", "node_index"], "left").join(by_id, "id", "left")
    return joined.withColumn("node_id", F.when(F.col("id").isNotNull(), F.col("named")).otherwise(F.col("placed"))).drop("placed", "named")


def blocked_by_rejection(items: DataFrame, rejected: DataFrame) -> DataFrame:
    """Items whose (type, key) is rejected."""
    return items.join(rejected.select("type", "key").distinct(), ["type", "key"], "left_semi")


def under_rejected_domain(kinds: DataFrame, rejected: DataFrame) -> DataFrame:
    """Names whose registrable domain (another name than theirs) is rejected: kinds as of `dns.classify`, rejected (registrable)."""
    return kinds.where("kind = 'subdomain'").join(rejected.select("registrable").distinct(), "registrable", "left_semi")


def too_new(observed: Column, now_us: int, skew_s: int = 300) -> Column:
    return observed > now_us + skew_s * 1_000_000


def bare_claims(claims: DataFrame, links: DataFrame, ready_evidence: DataFrame) -> DataFrame:
    """Claim-holding nodes (node_id) left without a link to ready evidence."""
    held = links.join(ready_evidence.select("evidence_id"), "evidence_id", "left_semi").select("node_id").distinct()
    return claims.join(held, "node_id", "left_anti")


def reliance_blocks(rejects: DataFrame, relations: DataFrame, states: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Nodes to reject (node_id) that an owned or dependency source relies on through one of the kinds."""
    relied = relations.where(F.col("type").isin(*kinds)).join(states.where("ownership in ('owned', 'dependency')").select(F.col("node_id").alias("source_id")), "source_id", "left_semi")
    return rejects.join(relied.select(F.col("target_id").alias("node_id")).distinct(), "node_id", "left_semi")
