"""Canonical IP addresses and networks of both versions, and IDNA labels; in Arrow batches, as Spark has no built-in."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _address(text: str | None):
    if not text or "%" in text:
        return None
    try:
        found = ipaddress.ip_address(text)
    except ValueError:
        return None
    if found.version == 6 and found.ipv4_mapped is not None:
        return None
    return found if found.compressed == text else None


def _network(text: str | None):
    if not text or "/" not in text or "%" in text:
        return None
    try:
        found = ipaddress.ip_network(text)
    except ValueError:
        return None
    return found if found.with_prefixlen == text else None


@F.pandas_udf(T.IntegerType())
def ip_version(values: pd.Series) -> pd.Series:
    """4 or 6 of a canonical address, 0 of anything else."""
    return pd.Series([a.version if (a := _address(v)) else 0 for v in values], dtype="int32")


@F.pandas_udf(T.IntegerType())
def cidr_version(values: pd.Series) -> pd.Series:
    """4 or 6 of a canonical network, 0 of anything else."""
    return pd.Series([n.version if (n := _network(v)) else 0 for v in values], dtype="int32")


@F.pandas_udf(T.BooleanType())
def contains_ip(networks: pd.Series, addresses: pd.Series) -> pd.Series:
    pairs = [(_network(n), _address(a)) for n, a in zip(networks, addresses)]
    return pd.Series([n is not None and a is not None and n.version == a.version and a in n for n, a in pairs])


@F.pandas_udf(T.BooleanType())
def proper_subnet(outer: pd.Series, inner: pd.Series) -> pd.Series:
    pairs = [(_network(o), _network(i)) for o, i in zip(outer, inner)]
    return pd.Series([o is not None and i is not None and o.version == i.version and o != i and i.subnet_of(o) for o, i in pairs])


@F.pandas_udf(T.BooleanType())
def idna_round_trip(labels: pd.Series) -> pd.Series:
    """Whether an xn-- label decodes and encodes to itself; other labels pass."""

    def sound(label):
        if not label or not label.startswith("xn--"):
            return label is not None
        try:
            return label.encode("ascii").decode("idna").encode("idna").decode("ascii") == label
        except UnicodeError:
            return False

    return pd.Series([sound(v) for v in labels])


@F.pandas_udf(T.StringType())
def spanned_network(first: pd.Series, last: pd.Series) -> pd.Series:
    """The network from its first to its last address; null where these are no addresses, or no one prefix spans them."""

    def span(low, high):
        try:
            parts = ipaddress.summarize_address_range(ipaddress.ip_address(low), ipaddress.ip_address(high))
            one = next(parts)
            return str(one) if next(parts, None) is None else None
        except (ValueError, TypeError):
            return None

    return pd.Series([span(a, b) for a, b in zip(first, last)], dtype="object")
