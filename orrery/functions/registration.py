"""Registration data as RDAP servers answer it: entities at any depth with their contact cards, events, and the gates on them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import grammar, transforms

_MANY = T.ArrayType(T.StringType())
ENTITY = T.StructType([T.StructField("handle", T.StringType()), T.StructField("card", T.StringType()), *[T.StructField(n, _MANY) for n in ("roles", "kinds", "names", "emails", "phones")]])
#: The lists of an entity and the card property that fills each.
_LISTS = {"kinds": "kind", "names": "fn", "emails": "email", "phones": "tel"}


def _listed(value) -> list:
    return value if isinstance(value, list) else []


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True)


@F.pandas_udf(T.ArrayType(ENTITY))
def entities(answers: pd.Series) -> pd.Series:
    """Entities of each answer (JSON) and of its entities, at any depth; none in what is not an object."""

    def one(entity: dict) -> dict:
        card = entity.get("vcardArray")
        lines = [line for line in _listed(card[1]) if isinstance(line, list) and len(line) > 3] if isinstance(card, list) and len(card) == 2 else []
        handle = entity.get("handle")
        return {
            "handle": handle if isinstance(handle, str) else None,
            "card": None if card is None else _text(card),
            "roles": [_text(role) for role in _listed(entity.get("roles"))],
            **{column: [_text(line[3]) for line in lines if line[0] == name] for column, name in _LISTS.items()},
        }

    def all_of(answer) -> list[dict]:
        try:
            level = [json.loads(answer)]
        except (TypeError, ValueError, RecursionError):
            return []
        found = []
        while level:
            level = [e for held in level if isinstance(held, dict) for e in _listed(held.get("entities")) if isinstance(e, dict)]
            found += [one(e) for e in level]
        return found

    return pd.Series([all_of(a) for a in answers], dtype="object")


def _roles(all_of: Column, card: Column) -> Column:
    """The roles of all entities with this card."""
    return F.flatten(F.transform(F.filter(all_of, lambda e: e["card"] == card), lambda e: e["roles"]))


def _holds(all_of: Column, member: str, value: Column) -> Column:
    """Whether an entity with this card or handle is an organisation that the resource is registered for."""
    return F.exists(all_of, lambda e: (e[member] == value) & F.array_contains(e["roles"], "registrant") & F.array_contains(e["kinds"], "org"))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: F.length(v) > 0), F.lit(0))


def contacts(answers: DataFrame, owner: str, answer: str) -> DataFrame:
    """One row for each entity of an answer: owner, position, and what its card and handle may be used for (else null).

    An answer that is null or no JSON object has no rows.
    """
    told = answers.select(F.col(owner).alias("owner"), entities(answer).alias("all")).select("owner", "all", F.posexplode("all").alias("position", "e"))
    card = F.col("e.card")
    roles = _roles(F.col("all"), card)
    phones = F.transform(F.col("e.phones"), lambda p: F.coalesce(transforms.e164(p), F.lit("")))
    return told.withColumn("roles", roles).select(
        "owner",
        "position",
        F.when(F.array_contains("roles", "registrar"), _first(F.col("e.names"))).alias("rdap_registrar_name"),
        F.when(_holds(F.col("all"), "card", card), _first(F.col("e.names"))).alias("rdap_holder_name"),
        F.when(_holds(F.col("all"), "handle", F.col("e.handle")), F.col("e.handle")).alias("rdap_holder_handle"),
        F.when(F.arrays_overlap("roles", F.array(*[F.lit(r) for r in transforms.REGISTRATION_ROLES])), _first(F.col("e.emails"))).alias("rdap_registration_contact_email"),
        F.when(F.array_contains("roles", "abuse"), _first(F.col("e.emails"))).alias("rdap_abuse_email"),
        F.when(F.array_contains("roles", "abuse"), _first(phones)).alias("rdap_abuse_phone"),
    )


# The event that each property is dated by.
EVENTS = {
    "rdap_event_registration": "registration",
    "rdap_event_last_changed": "last changed",
    "rdap_event_expiration": "expiration",
    "rdap_event_database_update": "last update of RDAP database",
}


def event_date(name: str, value: Column, answer: Column) -> Column:
    """value in UTC where an answer (JSON) dates the event of this transform with it."""
    events = F.from_json(F.get_json_object(answer, "$.events"), "array<struct<eventAction string, eventDate string>>")
    dated = F.exists(events, lambda e: (e["eventAction"] == EVENTS[name]) & (e["eventDate"] == value))
    return F.when(dated, transforms.apply_chain(value, ["rfc3339_utc"]))


def _accepted(identifier: Column, name: Column, kind: Column) -> Column:
    suffix = transforms.public_suffix_of(name, kind)
    return F.coalesce(grammar.valid("registry_domain_id", identifier) & grammar.valid("public_suffix", suffix), F.lit(False))


def rdap_registration_accepted(answer: Column, kind: Column) -> Column:
    """Whether a domain answer (JSON) has a registry's id that it does not list as redacted; kind is that of its ldhName."""
    hidden = F.exists(F.from_json(F.get_json_object(answer, "$.redacted"), "array<struct<prePath string>>"), lambda r: r["prePath"] == "$.handle")
    return _accepted(F.get_json_object(answer, "$.handle"), F.get_json_object(answer, "$.ldhName"), kind) & ~F.coalesce(hidden, F.lit(False))


def whois_registration_accepted(identifier: Column, name: Column, kind: Column) -> Column:
    """Whether a line-based answer's domain id is a registry's; kind is that of its domain name."""
    return _accepted(identifier, name, kind)
