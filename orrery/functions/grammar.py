"""Value grammars of the catalog as Column predicates.

Each predicate is true, false, or null for a null value.  Whole-string matches use \\A and \\z,
because Java's $ lets a trailing line break through.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide which spellings are accepted.
SLUG = r"[a-z0-9](?:[a-z0-9._+-]{0,61}[a-z0-9])?"
MEDIA_NAME = r"[a-z0-9][a-z0-9!#$&^_.+-]{0,126}"
PATTERNS = {
    "breach_token_or_empty": rf"(?:{SLUG}:[a-z0-9._/-]{{1,200}})?",
    "cloud_account_id": r"[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?",
    "cloud_region": r"[a-z0-9](?:[a-z0-9-]{0,30}[a-z0-9])?",
    "credential_key_id": r"[A-Za-z0-9._:/+=-]{1,128}",
    "cwe": r"CWE-[0-9]{1,6}",
    "finding_matcher_or_empty": r"[A-Za-z0-9._:/-]{0,400}",
    "finding_rule": rf"{SLUG}:[A-Za-z0-9._/-]{{1,200}}",
    "hex_serial": r"0|[1-9a-f][0-9a-f]{0,39}",
    "html_token": r"[a-z][a-z0-9-]{0,31}",
    "html_token_or_empty": r"(?:[a-z][a-z0-9-]{0,31})?",
    "iso3166_alpha2": r"[A-Z]{2}",
    "media_type": rf"{MEDIA_NAME}/{MEDIA_NAME}",
    "method": r"[A-Z][A-Z0-9!#$%&'*+.^_`|~-]{0,31}",
    "mta_sts": r"v=STSv1(?:[; ][\x20-\x7E]{0,4088})?",
    "dmarc": r"v=DMARC1(?:[; ][\x20-\x7E]{0,4087})?",
    "spf": r"v=spf1(?: [\x20-\x7E]{0,4089})?",
    "parameter_name": r"[\x21-\x7E&&[^&=#]]{1,128}",
    "phone_e164": r"\+[1-9][0-9]{1,14}",
    "registry_domain_id": r"[A-Za-z0-9_]{1,80}-[A-Za-z0-9]{1,8}",
    "repo_name": r"(?=.*[a-z0-9])[a-z0-9._-]{1,100}",
    "rir_handle": r"[A-Za-z0-9][A-Za-z0-9-]{0,62}[A-Za-z0-9]",
    "sha256": r"[0-9a-f]{64}",
    "srv_label": r"_[a-z0-9](?:[a-z0-9-]{0,60}[a-z0-9])?",
    "tech_token": SLUG,
    "tech_version": r"[\x21-\x7E]{1,64}",
    "tenant_id": r"[a-z0-9](?:[a-z0-9._-]{0,126}[a-z0-9])?",
    "tls_cipher_name": r"(?=.{5,128}\z)TLS_[A-Z0-9]+(?:_[A-Z0-9]+)*",
    "tls_fingerprint_value": r"[0-9a-f]{32}|[0-9a-f]{62}",
    "txt_value": r"[\x20-\x7E]{1,4096}",
    "username_or_empty": r"[\x21-\x7E]{0,256}",
    "printable_text_200": r"(?:[^\p{C}\p{Zl}\p{Zp}\p{Zs}]| ){1,200}",
    "printable_text_1024": r"(?:[^\p{C}\p{Zl}\p{Zp}\p{Zs}]| ){1,1024}",
    "multiline_text_4096": r"(?:[^\p{C}\p{Zl}\p{Zp}\p{Zs}]|[ \n\t]){1,4096}",
    "dkim_selector": r"(?=.{1,253}\z)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*",
    "repo_owner": r"(?=.{1,255}\z)[a-z0-9](?:[a-z0-9._-]{0,98}[a-z0-9])?(?:/[a-z0-9](?:[a-z0-9._-]{0,98}[a-z0-9])?)*",
    "bucket_name": r"(?!.*\.\.)(?!(?:[0-9]{1,3}\.){3}[0-9]{1,3}\z)[a-z0-9][a-z0-9._-]{1,220}[a-z0-9]",
    "git_ref_name": r"(?!(?:@|HEAD)\z)(?![-/.])(?!.*(?:\.\.|@\{|//|/\.))(?!.*\.lock(?:/|\z))[\x21-\x7E&&[^~^:?*\[\\]]{1,255}(?<![./])",
}
CPE_PART = r"(?:[*\-]|\?*\*?(?:[a-z0-9._\-~]|\\[!-~])+\*?\?*)"
EPP_STATUSES = (
    "addPeriod", "autoRenewPeriod", "clientDeleteProhibited", "clientHold", "clientRenewProhibited", "clientTransferProhibited", "clientUpdateProhibited",
    "inactive", "ok", "pendingCreate", "pendingDelete", "pendingRenew", "pendingRestore", "pendingTransfer", "pendingUpdate", "redemptionPeriod", "renewPeriod",
    "serverDeleteProhibited", "serverHold", "serverRenewProhibited", "serverTransferProhibited", "serverUpdateProhibited", "transferPeriod",
)
INTEGERS = {
    "asn": (0, 4294967295),
    "http_status": (100, 599),
    "uint8": (0, 255),
    "uint16": (0, 65535),
    "uint32": (0, 4294967295),
    "uint63": (0, (1 << 63) - 1),
}
LISTED = {"ip_version": (4, 6), "redirect_status": (301, 302, 303, 307, 308)}
ADVISORY = {
    "CVE": r"CVE-[0-9]{4}-[0-9]{4,19}",
    "GHSA": r"GHSA(?:-[23456789cfghjmpqrvwx]{4}){3}",
    "PYSEC": r"PYSEC-[0-9]{4}-[1-9][0-9]{0,6}",
    "RUSTSEC": r"RUSTSEC-[0-9]{4}-(?:[0-9]{4}|[1-9][0-9]{4,6})",
    "GO": r"GO-[0-9]{4}-(?:[0-9]{4}|[1-9][0-9]{4,6})",
    "OSV": r"OSV-[0-9]{4}-[1-9][0-9]{0,6}",
    "HSEC": r"HSEC-[0-9]{4}-(?:[0-9]{4}|[1-9][0-9]{4,6})",
    "JLSEC": r"JLSEC-[0-9]{4}-[1-9][0-9]{0,6}",
    "OSEC": r"OSEC-[0-9]{4}-(?:[0-9]{2}|[1-9][0-9]{2,6})",
    "RSEC": r"RSEC-[0-9]{4}-[1-9][0-9]{0,6}",
    "EEF": r"EEF-CVE-[0-9]{4}-[0-9]{4,19}",
    "DRUPAL": r"DRUPAL-(?:CONTRIB|CORE)-[0-9]{4}-(?:[0-9]{3}|[1-9][0-9]{3,6})",
    "MAL": r"MAL-[0-9]{4}-[1-9][0-9]{0,6}",
}
CVSS_BASE = {
    "3.0": ("AV", "AC", "PR", "UI", "S", "C", "I", "A"),
    "3.1": ("AV", "AC", "PR", "UI", "S", "C", "I", "A"),
    "4.0": ("AV", "AC", "AT", "PR", "UI", "VC", "VI", "VA", "SC", "SI", "SA"),
}
PATH = r"(?:[A-Za-z0-9._~!$&'()*+,;=:@/-]|%[0-9A-F]{2})*"
QUERY = r"(?:[A-Za-z0-9._~!$&'()*+,;=:@/?-]|%[0-9A-F]{2})+"
LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
URL = r"(https?)://(\[[^\]]+\]|[^/:?#]+)(?::([0-9]+))?(/[^?#]*)(?:\?([^#]+))?"


def whole(value: Column, pattern: str) -> Column:
    return value.rlike(rf"\A(?:{pattern})\z")


def is_ipv4(value: Column) -> Column:
    return whole(value, rf"{OCTET}(?:\.{OCTET}){{3}}")


def is_hostname(value: Column) -> Column:
    """Plain LDH labels, and underscores in all but the last two."""
    numeric = value.contains(".") & whole(value, r"[0-9.]+")
    return (F.length(value) <= 253) & ~numeric & whole(value, rf"(?:[a-z0-9_](?:[a-z0-9_-]{{0,61}}[a-z0-9_])?\.)*(?:{LABEL}\.)?{LABEL}")


def url_parts(url: Column) -> Column:
    """scheme, host, port, path, query of a URL; empty strings where it does not match."""
    part = lambda k: F.regexp_extract(url, rf"\A(?:{URL})\z", k)
    return F.struct(part(1).alias("scheme"), part(2).alias("host"), part(3).alias("port"), part(4).alias("path"), part(5).alias("query"))


def is_http_url(url: Column) -> Column:
    p = url_parts(url)
    port = F.try_to_number(F.when(p["port"] != "", p["port"]), F.lit("99999"))
    default = F.when(p["scheme"] == "https", 443).otherwise(80)
    port_ok = (p["port"] == "") | (~p["port"].startswith("0") & (F.length(p["port"]) <= 5) & F.coalesce(port.between(1, 65535) & (port != default), F.lit(False)))
    steps = ~F.exists(F.split(p["path"], "/"), lambda s: s.isin(".", ".."))
    return whole(url, r"[\x00-\x7F]{1,8192}") & whole(url, URL) & (is_ipv4(p["host"]) | is_hostname(p["host"])) & port_ok & steps & whole(p["path"], PATH) & ((p["query"] == "") | whole(p["query"], QUERY))


def drop_query(url: Column) -> Column:
    """The URL without its query, where it is valid with it or the query is empty; else as it is."""
    bare = F.split_part(url, F.lit("?"), F.lit(1))
    return F.when(is_http_url(url) | url.endswith("?"), bare).otherwise(url)


def is_date(value: Column) -> Column:
    return whole(value, r"[0-9]{4}-[0-9]{2}-[0-9]{2}") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()


def is_partial_date(value: Column) -> Column:
    missing = F.lit(2) - (F.length(value) - F.length(F.replace(value, F.lit("-"), F.lit(""))))
    return whole(value, r"[0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2})?)?") & F.try_to_date(F.concat(value, F.repeat(F.lit("-01"), missing.cast("int"))), "yyyy-MM-dd").isNotNull()


def is_utc_timestamp(value: Column) -> Column:
    shape = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?Z"
    return whole(value, shape) & F.try_to_timestamp(F.substring(value, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()


def is_cvss_vector(value: Column) -> Column:
    names = F.transform(F.slice(F.split(value, "/"), 2, 64), lambda m: F.split_part(m, F.lit(":"), F.lit(1)))
    version = F.regexp_extract(value, r"\ACVSS:([0-9.]+)/", 1)
    base = F.lit(False)
    for v, metrics in CVSS_BASE.items():
        base = base | ((version == v) & (F.size(F.array_except(F.array(*[F.lit(m) for m in metrics]), names)) == 0))
    return whole(value, r"CVSS:(?:3\.0|3\.1|4\.0)(?:/[A-Z]{1,3}:[A-Za-z]{1,5}){1,40}") & (F.size(names) == F.size(F.array_distinct(names))) & base


def is_advisory(value: Column) -> Column:
    prefix = F.split_part(value, F.lit("-"), F.lit(1))
    ok = F.lit(False)
    for name, pattern in ADVISORY.items():
        ok = ok | ((prefix == name) & whole(value, pattern))
    return ok


def is_fingerprint(value: Column) -> Column:
    number = F.try_to_number(F.when(whole(value, r"0|-?[1-9][0-9]{0,9}"), value), F.lit("S9999999999"))
    return whole(value, PATTERNS["sha256"]) | F.coalesce(number.between(-(1 << 31), (1 << 31) - 1), F.lit(False))


def is_email(value: Column) -> Column:
    atom = r"[a-z0-9!#$%&'*+/=?^_`{|}~-]+"
    return F.length(value).between(3, 254) & whole(value, rf"(?=.{{1,64}}@){atom}(?:\.{atom})*@(?:{LABEL}\.)+{LABEL}")


def is_sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values)) == values


def is_dns_name(value: Column) -> Column:
    """Two labels or more, of which all but the last two may hold underscores; whether a public suffix or a name under one is for dns.classify."""
    return is_hostname(value) & value.contains(".") & ~value.rlike(r"(?:\A|\.)[_-]+(?:\.|\z)")


def is_public_suffix(value: Column) -> Column:
    return (F.length(value) <= 251) & whole(value, rf"{LABEL}(?:\.{LABEL})*")


def _address(value: Column) -> Column:
    from orrery.functions.addresses import ip_version

    return is_ipv4(value) | (value.contains(":") & (ip_version(F.when(value.contains(":"), value)) == 6))


def _network(value: Column) -> Column:
    from orrery.functions.addresses import cidr_version

    return cidr_version(value) > 0


def _purl(value: Column) -> Column:
    from orrery.operators.checks import package_purl

    return package_purl(value).isNull()


def _set_of(values: Column, member, some: bool) -> Column:
    """A sorted array without repeats of sound strings; some: not empty."""
    ok = is_sorted_set(values) & F.forall(values, lambda v: F.coalesce(member(v), F.lit(False)))
    return ok & (F.size(values) > 0) if some else ok


def _parameters(values: Column) -> Column:
    name, content = r"[A-Za-z0-9][A-Za-z0-9-]*", r"[\x21-\x3A\x3C-\x7E]*"
    return F.forall(values, lambda p: F.coalesce(whole(p["name"], name) & whole(p["value"], content), F.lit(False)))


def is_score(value: Column) -> Column:
    """0 to 10 with one decimal at most."""
    return value.between(0, 10) & (F.round(value, 1) == value)


STRUCTURED = {
    "http_url": is_http_url,
    "ip": _address,
    "ipv4": is_ipv4,
    "cidr": _network,
    "dns_name": is_dns_name,
    "dns_or_explicit_empty": lambda v: (v == "") | is_dns_name(v),
    "public_suffix": is_public_suffix,
    "package_purl": _purl,
    # which names are services is an input table (validation.unknown_services)
    "service_name": lambda v: whole(v, r"[a-z0-9](?:[a-z0-9_.+-]{0,61}[a-z0-9])?"),
    "cpe23": lambda v: (F.length(v) <= 512) & whole(v, r"cpe:2\.3:[aho*\-]" + f":{CPE_PART}" * 10),
    "boolean": lambda v: v.try_cast("boolean").isNotNull(),
    "cvss_score": is_score,
    "probability": lambda v: v.between(0, 1),
    "epp_status_list": lambda v: _set_of(v, lambda x: x.isin(*EPP_STATUSES), True),
    "tag_list": lambda v: _set_of(v, lambda x: whole(x, SLUG), True),
    "mx_pattern_list": lambda v: _set_of(v, lambda x: is_dns_name(F.regexp_replace(x, r"\A\*\.", "")), False),
    "alpn_tokens": lambda v: F.forall(v, lambda x: F.coalesce(whole(x, r"[A-Za-z0-9./_-]{1,255}"), F.lit(False))),
    "caa_parameters": _parameters,
    "calendar_date": is_date,
    "partial_date": is_partial_date,
    "utc_timestamp": is_utc_timestamp,
    "cvss_vector": is_cvss_vector,
    "advisory_id": is_advisory,
    "http_fingerprint_value": is_fingerprint,
    "email_address": is_email,
}


def valid(rule: str | tuple, value: Column) -> Column:
    """Whether a value, a column of the rule's own type, obeys a rule: a name, or the tuple of accepted strings."""
    if isinstance(rule, tuple):
        return value.isin(*rule)
    if rule in PATTERNS:
        return whole(value, PATTERNS[rule])
    if rule in INTEGERS:
        return value.between(*INTEGERS[rule])
    if rule in LISTED:
        return value.isin(*LISTED[rule])
    return STRUCTURED[rule](value)
