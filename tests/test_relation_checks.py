"""Whole relations against literal verdicts."""

import json

from pyspark.sql import functions as F

from orrery.operators import relationchecks

NODES = {
    "cve": ("advisory", {"value": "CVE-2024-1000"}),
    "ghsa": ("advisory", {"value": "GHSA-2345-cfgh-jmpq"}),
    "net4": ("ip_cidr", {"value": "192.0.2.0/24", "version": 4}),
    "half4": ("ip_cidr", {"value": "192.0.2.0/25", "version": 4}),
    "net6": ("ip_cidr", {"value": "2001:db8::/32", "version": 6}),
    "in4": ("ip_address", {"value": "192.0.2.9", "version": 4}),
    "out4": ("ip_address", {"value": "198.51.100.1", "version": 4}),
    "in6": ("ip_address", {"value": "2001:db8::1", "version": 6}),
    "wrong": ("ip_address", {"value": "192.0.2.9", "version": 6}),
    "dom": ("domain", {"value": "example.com"}),
    "sub": ("subdomain", {"value": "www.example.com"}),
    "other": ("subdomain", {"value": "wwwexample.com"}),
    "post": ("endpoint", {"url": "https://example.com/r", "method": "POST"}),
    "get": ("endpoint", {"url": "https://example.com/r", "method": "GET"}),
    "reg": ("whois_registration", {"registry": "com"}),
    "bucket": ("storage_bucket", {"provider": "aws_s3", "name": "b"}),
    "image": ("package", {"purl": "pkg:oci/app?repository_url=eu.gcr.io/p/app"}),
    "npm": ("package", {"purl": "pkg:npm/a"}),
    "aws": ("cloud_account", {"provider": "aws"}),
    "gcp": ("cloud_account", {"provider": "gcp"}),
}
CASES = [
    ("aliases", "ghsa", "cve", {}, None),
    ("aliases", "cve", "ghsa", {}, "alias direction"),
    ("contains_ip", "net4", "in4", {}, None),
    ("contains_ip", "net4", "out4", {}, "address is not in the network"),
    ("contains_ip", "net6", "in6", {}, None),
    ("contains_ip", "net4", "wrong", {}, "address is not in the network"),
    ("contains_cidr", "net4", "half4", {}, None),
    ("contains_cidr", "half4", "net4", {}, "network is not inside the other"),
    ("contains_cidr", "net4", "net4", {}, "self edge"),
    ("has_subdomain", "dom", "sub", {}, None),
    ("has_subdomain", "dom", "other", {}, "name is not under the other"),
    ("has_registration", "dom", "reg", {}, None),
    ("has_contact", "dom", "post", {"role": "iodef"}, None),
    ("has_contact", "dom", "get", {"role": "iodef"}, "target: reports are posted"),
    ("has_contact", "dom", "post", {}, "role: required"),
    ("has_contact", "dom", "post", {"role": "boss"}, "role: not listed"),
    ("in_account", "bucket", "aws", {}, None),
    ("in_account", "bucket", "gcp", {}, "account of another provider"),
    ("in_account", "image", "gcp", {}, None),
    ("in_account", "npm", "aws", {}, "account of another provider"),
    ("redirects_to", "get", "get", {"status": 301}, None),
    ("redirects_to", "get", "post", {"status": 300}, "status: redirect_status"),
    ("redirects_to", "get", "post", {"status": "301"}, "status: redirect_status"),
    ("redirects_to", "get", "post", {"status": True}, "status: redirect_status"),
    ("redirects_to", "get", "post", {"status": None}, "status: redirect_status"),
    ("caa_issue", "dom", "sub", {"flags": 0, "parameters": [{"name": "a", "value": "b"}]}, None),
    ("caa_issue", "dom", "sub", {"flags": 0, "parameters": []}, None),
    ("caa_issue", "dom", "sub", {"flags": 256, "parameters": []}, "flags: uint8"),
    ("caa_issue", "dom", "sub", {"flags": 0, "parameters": ["a"]}, "parameters: caa_parameters"),
    ("has_svcb_binding", "dom", "dom", {"record_type": "https", "priority": 1, "alpn": ["h2"]}, None),
    ("has_svcb_binding", "dom", "dom", {"record_type": "https", "priority": 1, "alpn": [2]}, "alpn: alpn_tokens"),
    ("resolves_to", "dom", "sub", {}, "end types"),
    ("resolves_to", "dom", "nobody", {}, "target: missing"),
    ("resolves_to", None, "in4", {}, "source: missing"),
    ("likes", "dom", "sub", {}, "unknown relation type"),
]


def test_relations(spark):
    nodes = spark.createDataFrame([(k, t, json.dumps(p)) for k, (t, p) in NODES.items()], "node_id string, type string, p string").withColumn("properties", F.parse_json("p")).drop("p")
    rows = [(i, t, s, g, json.dumps(p)) for i, (t, s, g, p, _) in enumerate(CASES)]
    relations = spark.createDataFrame(rows, "rel_id long, type string, source_id string, target_id string, p string").withColumn("properties", F.parse_json("p")).drop("p")
    got = {r.rel_id: r.reason for r in relationchecks.relation_reasons(relations, nodes).select("rel_id", "reason").collect()}
    assert {i: (CASES[i], r) for i, r in got.items() if r != CASES[i][4]} == {}
    assert len(got) == len(CASES)
    assert relationchecks.relation_reasons(relations.limit(0), nodes).collect() == []
