"""Canonical JSON and content-hash identities.

A record's key is the SHA-256 of the canonical JSON of its identity properties (sorted names, no
blanks); an empty identity has the empty key.  Record ids are hashes of type and key, so a
rerun gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(**properties: Column) -> Column:
    """Canonical JSON of the named columns."""
    return F.to_json(F.struct(*[properties[name].alias(name) for name in sorted(properties)]), {"ignoreNullFields": "false"})


def key(**properties: Column) -> Column:
    return F.sha2(canonical(**properties), 256) if properties else F.lit("")


def key_of(members: str, parent: str) -> Column:
    """The key of a record whose identity is a map of names to JSON values, and of its parent's id where it has one."""
    whole = F.when(F.col(parent).isNull(), F.col(members)).otherwise(F.map_concat(F.col(members), F.create_map(F.lit("parent"), F.concat(F.lit('"'), F.col(parent), F.lit('"')))))
    pairs = F.transform(F.array_sort(F.map_keys(whole)), lambda name: F.concat(F.lit('"'), name, F.lit('":'), F.element_at(whole, name)))
    text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return F.when(text == "{}", "").otherwise(F.sha2(text, 256))


def node_id(kind: Column, key: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit(":"), key), 256)


def relation_id(source: Column, kind: Column, target: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, kind, target, key), 256)


def unordered(items: Column) -> Column:
    """Identity member for an array whose order does not count: the hash of its sorted members, duplicates kept."""
    return F.sha2(F.to_json(F.array_sort(items)), 256)
