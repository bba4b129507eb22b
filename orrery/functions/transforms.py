"""Named value transforms from scanner fields to property values: a registry of Column functions.

A null stays null through a chain; a value that a transform cannot read becomes null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import addresses, grammar, hosts

TRANSFORMS: dict[str, Callable[[Column], Column]] = {}
CONDITIONS: dict[str, Callable[[Column], Column]] = {}


def transform(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    TRANSFORMS[function.__name__] = function
    return function


def apply_chain(value: Column, chain: list[str]) -> Column:
    for name in chain:
        value = TRANSFORMS[name](value)
    return value


def _host(url: Column) -> Column:
    """The host of an absolute URL in lower case, without port or brackets; null for any other text."""
    found = F.regexp_extract(url, r"\A(?i:[a-z]+)://(\[[^\]]+\]|[^/:?#]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"[\[\]]", "")), F.lit(""))


def _segment(url: Column, k: int) -> Column:
    """The k-th path segment of an absolute URL, null where there is none."""
    path = F.regexp_extract(url, r"\A(?i:[a-z]+)://[^/]+/([^?#]*)", 1)
    return F.nullif(F.split_part(path, F.lit("/"), F.lit(k)), F.lit(""))


def _named(pairs: dict[str, str]) -> Callable[[Column], Column]:
    """A closed table; an unlisted spelling becomes null."""

    def look(v: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, value in pairs.items():
            out = out.when(v == name, value)
        return out

    return look


def _bare(v: Column) -> Column:
    return F.lower(F.regexp_replace(v, r"\.+\z", ""))


def e164(v: Column) -> Column:
    """A phone number with its country code (tel: URI, dotted, spaced) as + and digits; null without the +."""
    number = F.trim(F.split_part(F.regexp_replace(v, r"\Atel:", ""), F.lit(";"), F.lit(1)))
    digits = F.regexp_replace(number, r"[^0-9]", "")
    return F.when(number.startswith("+") & (digits != ""), F.concat(F.lit("+"), digits))


#: <owner> <ttl> IN <type>, as zone tools print a record.
_RECORD = r"(?s)\A\s*\S+\s+\S+\s+IN\s+"


def _caa(tag: str, part: str) -> Callable[[Column], Column]:
    """A part of a CAA record of this tag (a pattern): its flags, its text without the quotes, the issuer or the parameters."""
    pattern = _RECORD + rf'CAA\s+([0-9]+) (?i:{tag}) "?(.*?)"?\s*\z'

    def read(v: Column) -> Column:
        told = F.regexp_extract(v, pattern, 2)
        pieces = F.transform(F.split(told, ";"), lambda p: F.trim(p))
        pairs = F.transform(
            F.filter(F.slice(pieces, 2, F.size(pieces)), lambda p: p != ""),
            lambda p: F.struct(F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(1)))).alias("name"), F.trim(F.regexp_replace(p, r"\A[^=]*=?", "")).alias("value")),
        )
        parts = {"flags": F.regexp_extract(v, pattern, 1).try_cast("int"), "text": told, "issuer": F.nullif(F.lower(F.get(pieces, F.lit(0))), F.lit("")), "parameters": pairs}
        return F.when(v.rlike(pattern), parts[part])

    return read


def _iodef(scheme: str) -> Callable[[Column], Column]:
    def read(v: Column) -> Column:
        told = _caa("iodef", "text")(v)
        return F.when(F.lower(told).startswith(scheme), told)

    return read


def _canonical(part: str) -> Callable[[Column], Column]:
    """Of a provider's canonical default host name: its service or region; null for any other name."""

    def read(v: Column) -> Column:
        found = hosts.match(_bare(v))
        return F.when(found["canonical"], F.nullif(found[part], F.lit("")))

    return read


# Closed tables of spellings.
TRUFFLEHOG_KINDS = {"AWS": "api_key", "AWSSessionKey": "session_token", "PrivateKey": "private_key", "Twilio": "api_key"}
GITLEAKS_KINDS = {"aws-access-token": "api_key", "generic-api-key": "api_key", "private-key": "private_key"}
RIR_SERVERS = {"whois.arin.net": "arin", "whois.ripe.net": "ripe", "whois.apnic.net": "apnic", "whois.lacnic.net": "lacnic", "whois.afrinic.net": "afrinic"}
REGISTRATION_ROLES = {"registrant": "registrant", "administrative": "admin", "technical": "tech", "billing": "billing"}
KEY_ALGORITHMS = ("ssh-rsa", "ssh-dss", "ssh-ed25519", "ecdsa-sha2-nistp256", "ecdsa-sha2-nistp384", "ecdsa-sha2-nistp521", "sk-ssh-ed25519@openssh.com", "sk-ecdsa-sha2-nistp256@openssh.com")
PUBLIC_PARTS = {"AWS": r"(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}", "AWSSessionKey": r"(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}", "Twilio": r"AC[0-9a-f]{32}"}

for _name, _function in {
    "lower": F.lower,
    "upper": F.upper,
    "strip_trailing_dot": lambda v: F.regexp_replace(v, r"\.+\z", ""),
    "hex_prefix16": lambda v: F.substring(v, 1, 16),
    "detector_token": lambda v: F.regexp_replace(F.regexp_replace(F.lower(v), r"[^a-z0-9._+]+", "-"), r"\A[-.]+|[-.]+\z", ""),
    "wappalyzer_name_slug": lambda v: F.regexp_replace(F.regexp_replace(F.lower(F.split_part(v, F.lit(":"), F.lit(1))), r"[^a-z0-9._+-]+", "-"), r"\A-+|-+\z", ""),
    "wappalyzer_version": lambda v: F.nullif(F.when(v.contains(":"), F.substring_index(v, ":", -1)), F.lit("")),
    "media_type_essence": lambda v: F.lower(F.trim(F.split_part(v, F.lit(";"), F.lit(1)))),
    "http_request_method": lambda v: F.nullif(F.regexp_extract(v, r"\A([A-Z]+) ", 1), F.lit("")),
    "san_base_name": lambda v: F.regexp_replace(v, r"\A\*\.", ""),
    "san_coverage": lambda v: F.when(v.startswith("*."), "wildcard").otherwise("exact"),
    "dmarc_owner_name": lambda v: F.regexp_replace(_bare(v), r"\A_dmarc\.", ""),
    "url_without_query": lambda v: F.split_part(v, F.lit("?"), F.lit(1)),
    "url_host": _host,
    "url_with_path": lambda v: F.when(v.rlike(r"\A[a-z]+://[^/]+\z"), F.concat(v, F.lit("/"))).otherwise(v),
    "repo_url_owner": lambda v: F.lower(_segment(v, 1)),
    "repo_url_name": lambda v: F.lower(F.regexp_replace(_segment(v, 2), r"\.git\z", "")),
    "int_value": lambda v: v.try_cast("bigint"),
    "float_value": lambda v: v.try_cast("double"),
    "asn_number": lambda v: F.regexp_replace(v, r"\A[Aa][Ss]", "").try_cast("bigint"),
    "cvss_one_decimal": lambda v: F.round(v.try_cast("double"), 1),
    "sha256_hex": lambda v: F.sha2(F.replace(v, F.lit("\r\n"), F.lit("\n")), 256),
    "digest16": lambda v: F.substring(F.sha2(v, 256), 1, 16),
    "openssh_b64_to_hex": lambda v: F.lower(F.hex(F.try_to_binary(F.rpad(v, F.ceil(F.length(v) / 4).cast("int") * 4, F.lit("=")), F.lit("base64")))),
    "colon_hex_serial_to_lower_hex": lambda v: F.coalesce(F.nullif(F.ltrim(F.lower(F.replace(v, F.lit(":"), F.lit(""))), F.lit("0")), F.lit("")), F.lit("0")),
    "epoch_utc": lambda v: F.date_format(F.timestamp_seconds(v.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    "rfc3339_utc": lambda v: F.regexp_replace(F.regexp_replace(F.date_format(F.try_to_timestamp(v), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"0+Z\z", "Z"), r"\.Z\z", "Z"),
    "partial_date": lambda v: F.when(grammar.is_partial_date(v), v),
    "cpe22_uri_to_cpe23": lambda v: F.when(
        v.rlike(r"\Acpe:/[aho](:[^:]*){0,6}\z"),
        F.concat(F.lit("cpe:2.3:"), F.array_join(F.slice(F.concat(F.transform(F.split(v.substr(F.lit(6), F.length(v)), ":"), lambda p: F.when(p == "", "*").otherwise(p)), F.array_repeat(F.lit("*"), 11)), 1, 11), ":")),
    ),
    "cpe_product_level": lambda v: F.concat(F.substring_index(v, ":", 5), F.lit(":*:*:*:*:*:*:*:*")),
    "sorted_set": lambda v: F.array_sort(F.array_distinct(v)),
    "scheme_service": lambda v: F.when(v.isin("http", "https"), "http"),
    "scheme_secure": lambda v: F.when(v == "https", F.lit(True)).when(v == "http", F.lit(False)),
    "whois_dnssec_bool": lambda v: F.when(v == "signedDelegation", F.lit(True)).when(v == "unsigned", F.lit(False)),
    "whois_phone_e164": e164,
    "mta_sts_mx_lines": lambda v: F.transform(v, lambda line: F.regexp_replace(line, r"\A\s+|\s+\z", "")),
    "rr_mx_preference": lambda v: F.nullif(F.regexp_extract(v, _RECORD + r"MX\s+([0-9]+)\s", 1), F.lit("")).try_cast("int"),
    "rr_caa_issue_flags": _caa("issue", "flags"),
    "rr_caa_issue_parameters": _caa("issue", "parameters"),
    "rr_caa_issuewild_flags": _caa("issuewild", "flags"),
    "rr_caa_issuewild_parameters": _caa("issuewild", "parameters"),
    "rr_caa_issuer": _caa("issue|issuewild", "issuer"),
    "rr_caa_iodef_email": lambda v: F.lower(F.regexp_replace(_iodef("mailto:")(v), r"\A(?i:mailto):", "")),
    "rr_caa_iodef_url": _iodef("https://"),
    "cloud_service": _canonical("service"),
    "cloud_service_or_none": _canonical("service"),
    "cloud_region": _canonical("region"),
    "if_cloud_hostname": lambda v: F.when(_canonical("service")(v).isNotNull(), _bare(v)),
    "if_spf_record": lambda v: F.when(grammar.valid("spf", v), v),
    "if_dmarc_record": lambda v: F.when(grammar.valid("dmarc", v), v),
    "if_txt_record": lambda v: F.when(grammar.valid("txt_value", v) & ~grammar.valid("spf", v) & ~grammar.valid("dmarc", v) & ~v.startswith("v=DKIM1") & ~grammar.valid("mta_sts", v), v),
    "if_ip_input": lambda v: of_address(v, v),
    "if_name_input": lambda v: of_name(v, v),
    "ip_version": lambda v: F.when(v.contains(":"), 6).when(v.isNotNull(), 4),
    "pypi_name_to_purl": lambda v: F.concat(F.lit("pkg:pypi/"), F.regexp_replace(F.lower(v), r"[-_.]+", "-")),
    "openid_tenant_id": lambda v: F.nullif(F.regexp_extract(F.lower(v), r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", 1), F.lit("")),
    "arn_account": lambda v: F.nullif(F.split_part(v, F.lit(":"), F.lit(5)), F.lit("")),
    "whois_status_to_epp": lambda v: F.split_part(F.trim(v), F.lit(" "), F.lit(1)),
    "dast_location": _named({k: k for k in ("query", "body", "header", "cookie", "path")}),
    "cdncheck_protection_kind": _named({"cdn": "cdn", "waf": "waf"}),
    "nmap_tunnel_secure": lambda v: F.when(v == "ssl", F.lit(True)),
    "ssh_host_key_algorithm": lambda v: F.when(v.isin(*KEY_ALGORITHMS), v),
    "nmap_ssh_hostkey_sha256": lambda v: F.when(F.size(F.regexp_extract_all(v, F.lit(r"(SHA256:[A-Za-z0-9+/]+)"), F.lit(1))) == 1, F.get(F.regexp_extract_all(v, F.lit(r"(SHA256:[A-Za-z0-9+/]+)"), F.lit(1)), F.lit(0))),
    "rir_from_whois_server": lambda v: _named(RIR_SERVERS)(F.lower(F.regexp_replace(v, r"\.+\z", ""))),
    "rdap_registration_role": _named(REGISTRATION_ROLES),
    "rdap_abuse_role": lambda v: F.when(v == "abuse", v),
    "trufflehog_secret_kind": _named(TRUFFLEHOG_KINDS),
    "gitleaks_secret_kind": _named(GITLEAKS_KINDS),
    "go_time_string_utc": lambda v: TRANSFORMS["rfc3339_utc"](F.regexp_replace(v, r"\A(\S+) (\S+?)(\.[0-9]{1,6})?[0-9]* ([+-][0-9]{2})([0-9]{2}).*\z", "$1T$2$3$4:$5")),
    "bbot_rule": lambda v: F.concat(F.lit("bbot:"), v),
    "bbot_nuclei_template": lambda v: F.concat(F.lit("nuclei:"), F.nullif(F.regexp_extract(v, r"template: \[([^\]]+)\]", 1), F.lit(""))),
    "bbot_nuclei_template_id": lambda v: F.nullif(F.regexp_extract(v, r"template: \[([^\]]+)\]", 1), F.lit("")),
    "bbot_nuclei_matcher": lambda v: F.regexp_extract(v, r"name: \[([^\]]*)\]", 1),
    "bbot_without_extracted_data": lambda v: F.regexp_replace(v, r"(?s) Extracted Data: \[.*\]\z", ""),
    "bbot_trufflehog_secret_part": lambda v: trufflehog_secret_part(F.coalesce(_quoted("Detector Type", v), F.lit("")), _quoted("Raw result", v), F.coalesce(_quoted("RawV2 result", v), F.lit(""))),
    "bbot_trufflehog_detector": lambda v: F.concat(F.lit("trufflehog:"), F.lower(F.trim(F.regexp_replace(v, r"\ATruffleHog - ", "")))),
    "bbot_dns_name": lambda v: F.regexp_replace(_bare(v), r"\A_wildcard\.", ""),
    "leakcheck_breach_token": lambda v: F.concat(F.lit("leakcheck:"), F.regexp_replace(F.regexp_replace(F.lower(v), r"[^a-z0-9._/-]+", "-"), r"\A-+|-+\z", "")),
    "pypi_email_address": lambda v: F.nullif(F.lower(F.regexp_extract(v, r"\A[^,]*?([^\s<>,]+@[^\s<>,]+)>?\s*\z", 1)), F.lit("")),
    "nuclei_rule": lambda v: F.concat(F.lit("nuclei:"), v),
    "rdap_status_to_epp": lambda v: F.when(v == "active", "ok").when(v == "associated", "linked").otherwise(F.concat(F.split_part(v, F.lit(" "), F.lit(1)), F.replace(F.initcap(F.substring(v, F.length(F.split_part(v, F.lit(" "), F.lit(1))) + 1, F.length(v))), F.lit(" "), F.lit("")))),
}.items():
    TRANSFORMS[_name] = _function

# Conditions on a record: of the template type of a result, of a written name, or of the kind of a name
# (dns.with_kinds).  What is null fails them, but for a type other than ssl.
CONDITIONS.update(
    {
        "nuclei_http_result": lambda v: F.coalesce(v.isin("http", "headless"), F.lit(False)),
        "nuclei_ssl_result": lambda v: v.eqNullSafe("ssl"),
        "nuclei_not_ssl_result": lambda v: ~v.eqNullSafe("ssl"),
        "bbot_not_wildcard_placeholder": lambda v: ~F.coalesce(F.lower(v).startswith("_wildcard."), F.lit(False)),
        "host_is_domain": lambda kind: kind.eqNullSafe("domain"),
        "host_is_subdomain": lambda kind: kind.eqNullSafe("subdomain"),
        "bbot_names_domain": lambda kind: kind.eqNullSafe("domain"),
        "bbot_names_subdomain": lambda kind: kind.eqNullSafe("subdomain"),
    }
)


def of_kind(name: Column, kind: Column, wanted: str) -> Column:
    """A name in lower case without the root dot where its kind (dns.with_kinds) is the wanted one."""
    return F.when(kind == wanted, _bare(name))


def public_suffix_of(name: Column, kind: Column) -> Column:
    """The zone that a registrable domain is registered in; null for any other name."""
    return F.when(kind == "domain", F.regexp_replace(_bare(name), r"\A[^.]*\.", ""))


def of_address(value: Column, asked: Column) -> Column:
    """value where a tool was asked about an address of either version."""
    return F.when(addresses.ip_version(asked) > 0, value)


def of_name(value: Column, asked: Column) -> Column:
    """value where a tool was asked about a name."""
    return F.when(addresses.ip_version(asked) == 0, value)


def single_autnum(first: Column, last: Column) -> Column:
    """The number of a block of one autonomous system."""
    return F.when(first == last, first)


def _quoted(label: str, text: Column) -> Column:
    """What follows `label: [` up to the bracket before the next label or the end; null without the label."""
    pattern = rf"(?s){label}: \[(.*?)\](?= [A-Z][A-Za-z0-9 ]*: \[|\z)"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def nuclei_matcher(matcher: Column, extractor: Column) -> Column:
    """The matcher's name, else the extractor's, else empty."""
    return F.coalesce(F.nullif(matcher, F.lit("")), F.nullif(extractor, F.lit("")), F.lit(""))


def sni_matcher(matcher: Column, host: Column) -> Column:
    """<host>:<matcher> on a named host, the bare matcher on an address."""
    name = F.lower(F.regexp_replace(host, r"\.+\z", ""))
    return F.when(grammar.is_ipv4(name) | name.contains(":"), F.coalesce(matcher, F.lit(""))).otherwise(F.concat(name, F.lit(":"), F.coalesce(matcher, F.lit(""))))


def trufflehog_secret_part(detector: Column, raw: Column, raw_v2: Column) -> Column:
    """What must stay secret of a detector's finding."""
    return F.when(detector.isin("AWS", "AWSSessionKey"), F.split_part(raw_v2, F.lit(":"), F.lit(2))).when(detector == "Twilio", F.substring(raw_v2, F.length(raw) + 1, F.length(raw_v2))).otherwise(raw)


def trufflehog_public_part(detector: Column, raw: Column) -> Column:
    """The public half of a two-part credential, null where it is not spelled as one."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in PUBLIC_PARTS.items():
        out = out.when((detector == name) & grammar.whole(raw, pattern), raw)
    return out


def located(file: Column, line: Column) -> Column:
    """<file>:<line>, as secret scanners' results are located; null without either."""
    return F.concat(file, F.lit(":"), line.cast("string"))


def trufflehog_git_location(file: Column, result: Column) -> Column:
    """Of a git result (JSON): the file and the line of its metadata."""
    return located(file, F.get_json_object(result, "$.SourceMetadata.Data.Git.line"))


def gitleaks_location(file: Column, finding: Column) -> Column:
    """Of a finding (JSON): the file and its first line."""
    return located(file, F.get_json_object(finding, "$.StartLine"))


def wildcard_answer(name: Column, tags: Column) -> Column:
    """Of a real name: true where tagged wildcard, false where wildcard-possible, else null."""
    return F.when(F.lower(name).startswith("_wildcard."), F.lit(None).cast("boolean")).when(F.array_contains(tags, "wildcard"), F.lit(True)).when(F.array_contains(tags, "wildcard-possible"), F.lit(False))


def wildcard_zone(name: Column, tags: Column) -> Column:
    """Of a stand-in for a wildcard hit: true where it is tagged so, else null."""
    return F.when(F.lower(name).startswith("_wildcard.") & F.array_contains(tags, "wildcard"), F.lit(True))


def status_tag(tags: Column) -> Column:
    """The HTTP status in a status-<code> tag."""
    return F.get(F.filter(tags, lambda t: t.rlike(r"\Astatus-[1-5][0-9]{2}\z")), F.lit(0)).substr(8, 3).cast("int")


def preferred_cvss(value: Column, metrics: Column) -> Column:
    """value where the preferred metric carries it: metrics is an array of (type, score, vector), newest family first; the first Primary, else the first."""
    chosen = F.coalesce(F.get(F.filter(metrics, lambda m: m["type"] == "Primary"), F.lit(0)), F.get(metrics, F.lit(0)))
    return F.when((value.try_cast("double") == F.round(chosen["score"], 1)) | (value == chosen["vector"]), value)


# Families of scores in two advisory formats, newest first.
NVD_FAMILIES = ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30")
GITHUB_FAMILIES = ("cvss_v4", "cvss_v3")


def nvd_preferred_cvss(value: Column, answer: Column) -> Column:
    """value where the preferred metric of an answer (JSON) about one vulnerability carries it; null for answers about several."""
    entry = "array<struct<type string, cvssData struct<baseScore double, vectorString string>>>"
    found = F.from_json(F.get_json_object(answer, "$.vulnerabilities[0].cve.metrics"), "struct<" + ", ".join(f"{f} {entry}" for f in NVD_FAMILIES) + ">")
    metrics = F.transform(
        F.concat(*[F.coalesce(found[f], F.array().cast(entry)) for f in NVD_FAMILIES]),
        lambda m: F.struct(m["type"].alias("type"), m["cvssData"]["baseScore"].alias("score"), m["cvssData"]["vectorString"].alias("vector")),
    )
    return F.when(F.json_array_length(F.get_json_object(answer, "$.vulnerabilities")) == 1, preferred_cvss(value, metrics))


def github_preferred_cvss(value: Column, advisory: Column) -> Column:
    """value where the newest family with a vector carries it, in an advisory (JSON); a family without one has no score."""
    found = F.from_json(F.get_json_object(advisory, "$.cvss_severities"), "struct<" + ", ".join(f"{f} struct<score double, vector_string string>" for f in GITHUB_FAMILIES) + ">")
    families = F.filter(F.array(*[found[f] for f in GITHUB_FAMILIES]), lambda m: F.length(m["vector_string"]) > 0)
    return preferred_cvss(value, F.transform(families, lambda m: F.struct(F.lit("Primary").alias("type"), m["score"].alias("score"), m["vector_string"].alias("vector"))))
