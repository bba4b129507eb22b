"""Whole checks of relations: known type, both ends there and of an accepted type, the relation's own properties with their JSON types, then what the ends' values must be to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import addresses, grammar
from orrery.operators import checks, validation
from orrery.operators.catalog import RELATIONS

#: Registries that a cloud account owns, by host.
REGISTRY_PROVIDERS = {
    r"\A[0-9]{12}\.dkr\.ecr\.[a-z]{2,4}(?:-gov|-iso[a-z]?)?-[a-z]+-[0-9]{1,2}\.amazonaws\.com(?:\.cn)?\z": "aws",
    r"\Apublic\.ecr\.aws\z": "aws",
    r"\A[a-z]+(?:-[a-z]+[0-9]+)?-docker\.pkg\.dev\z": "gcp",
    r"\A(?:(?:us|eu|asia)\.)?gcr\.io\z": "gcp",
    r"\A[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.azurecr\.io\z": "azure",
}

#: Properties of an end that checks of pairs read.
END_VALUES = ("value", "version", "method", "registry", "provider", "service", "purl")

# How a rule's values lie in JSON: the variant's schema, and the type that the rule is asked with.
_INTEGER = (r"\ABIGINT\z", "bigint")
_NUMBER = (r"\A(?:BIGINT|DOUBLE|DECIMAL\(.*\))\z", "double")
_STRING = (r"\ASTRING\z", "string")
_BOOLEAN = (r"\ABOOLEAN\z", "boolean")
_STRINGS = (r"\AARRAY<(?:STRING|VOID)>\z", "array<string>")
_PAIRS = (r"\AARRAY<(?:VOID|OBJECT<name: STRING, value: STRING>)>\z", "array<struct<name:string,value:string>>")
_KINDS = {
    **dict.fromkeys((*grammar.INTEGERS, *grammar.LISTED), _INTEGER),
    **dict.fromkeys(("cvss_score", "probability"), _NUMBER),
    **dict.fromkeys(("epp_status_list", "tag_list", "mx_pattern_list", "alpn_tokens"), _STRINGS),
    "boolean": _BOOLEAN,
    "caa_parameters": _PAIRS,
}


def typed_reason(properties: Column, name: str, rule: str | tuple, required: bool) -> Column:
    """Why a property of a record (a variant) breaks its rule; null where it does not.  A value of another JSON type than the rule's breaks it, also where it could be read as one."""
    held = F.try_variant_get(properties, f'$["{name}"]', "variant")
    shape, kind = _STRING if isinstance(rule, tuple) else _KINDS.get(rule, _STRING)
    sound = F.schema_of_variant(held).rlike(shape) & grammar.valid(rule, F.try_variant_get(properties, f'$["{name}"]', kind))
    told = F.when(~F.coalesce(sound, F.lit(False)), f"{name}: {rule if isinstance(rule, str) else 'not listed'}")
    return F.when(held.isNull(), f"{name}: required" if required else F.lit(None).cast("string")).otherwise(told)


def property_reason(kind: Column, properties: Column) -> Column:
    """The first property of a relation that is missing or wrong, in the catalog's order."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, r in RELATIONS.items():
        own = [typed_reason(properties, p, rule, True) for p, rule in r.required.items()] + [typed_reason(properties, p, rule, False) for p, rule in r.optional.items()]
        if own:
            out = out.when(kind == name, F.coalesce(*own))
    return out


def _account_provider(kind: Column, service: Column, provider: Column, purl: Column) -> Column:
    """The provider that a resource, bucket or image names; null where it names none."""
    host = F.regexp_extract(purl, r"\Apkg:oci/[^?]*\?repository_url=([^/]+)", 1)
    image = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, owner in REGISTRY_PROVIDERS.items():
        image = image.when(host.rlike(pattern), owner)
    return F.when(kind == "cloud_resource", F.split_part(service, F.lit("_"), F.lit(1))).when(kind == "storage_bucket", F.split_part(provider, F.lit("_"), F.lit(1))).otherwise(image)


def pair_reason(kind: Column, role: Column, source: Column, target: Column) -> Column:
    """What the two ends (structs of type and END_VALUES) of one relation must be to each other."""
    held = lambda ok, said: F.when(~F.coalesce(ok, F.lit(False)), said)
    same = source["version"].eqNullSafe(target["version"])
    account = _account_provider(source["type"], source["service"], source["provider"], source["purl"])
    return (
        F.when(kind == "aliases", checks.alias_direction(source["value"], target["value"]))
        .when(kind == "contains_ip", held(same & addresses.contains_ip(source["value"], target["value"]), "address is not in the network"))
        .when(kind == "contains_cidr", held(same & addresses.proper_subnet(source["value"], target["value"]), "network is not inside the other"))
        .when(kind == "has_contact", checks.contact_role(source["type"], target["type"], role, target["method"]))
        .when(kind == "has_registration", checks.registration_suffix(source["value"], target["registry"]))
        .when(kind == "has_subdomain", held(target["value"].endswith(F.concat(F.lit("."), source["value"])), "name is not under the other"))
        .when(kind == "in_account", held(account == target["provider"], "account of another provider"))
    )


def relation_reasons(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """relations (rel_id, type, source_id, target_id, properties: variant) with the column reason: the first thing that is wrong, null where nothing is.

    nodes (node_id, type, properties: variant): one row an id.  Of an end only its type and the few values that checks of pairs read travel with the two joins.
    """
    at = lambda name: F.try_variant_get("properties", f'$["{name}"]', "string").alias(name)
    ends = nodes.where("node_id is not null").select("node_id", F.struct("type", *[at(v) for v in END_VALUES]).alias("end"))
    joined = relations
    for end in ("source", "target"):
        joined = joined.join(ends.select(F.col("node_id").alias(f"{end}_id"), F.col("end").alias(f"__{end}")), f"{end}_id", "left")
    typed = joined.withColumns({"source_type": F.col("__source.type"), "target_type": F.col("__target.type")})
    # types and self edges by the catalog's table, which is small and fixed
    fitted = validation.end_reasons(typed).withColumnRenamed("reason", "__fits")
    missing = F.when(F.col("__source").isNull(), "source: missing").when(F.col("__target").isNull(), "target: missing")
    known = F.when(F.col("__fits") == "unknown relation type", F.col("__fits"))
    role = F.try_variant_get("properties", '$["role"]', "string")
    reason = F.coalesce(known, missing, F.col("__fits"), property_reason(F.col("type"), F.col("properties")), pair_reason(F.col("type"), role, F.col("__source"), F.col("__target")))
    return fitted.select(*relations.columns, reason.alias("reason"))
