"""Operators against sequential or plain versions, and golden cases."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import dns, grammar, jsonwalk, transforms
from orrery.operators import checks, evidence, merge, properties, state, statescan, traverse, validation
from orrery.operators.catalog import METHODS_OF_SCOPE, NODES, RELATIONS
from orrery.streaming import ingest

GOLDEN = {
    "cwe": (["CWE-79", "CWE-1"], ["cwe-79", "CWE-", "CWE-79\n"]),
    "hex_serial": (["0", "a1", "1" + "f" * 39], ["00", "A1", "1" + "f" * 40]),
    "media_type": (["text/html", "application/vnd.api+json"], ["text", "Text/html", "text/html; x"]),
    "phone_e164": (["+14155550100"], ["14155550100", "+0123", "+1"]),
    "git_ref_name": (["main", "feature/x-1"], ["@", "HEAD", "-x", "a..b", "a.lock", "a/.b", "x/", "a b", "x."]),
    "bucket_name": (["my-bucket", "a.b.c"], ["ab", "a..b", "192.168.1.1", "-abc", "Abc"]),
    "tls_cipher_name": (["TLS_AES_128_GCM_SHA256"], ["TLS_", "tls_AES", "TLS__A"]),
    "spf": (["v=spf1", "v=spf1 -all"], ["v=spf1-all", "spf"]),
    "dmarc": (["v=DMARC1", "v=DMARC1; p=none"], ["v=DMARC1p"]),
    "repo_name": (["a.b", "x"], ["..", ".", "A"]),
    "printable_text_200": (["a b", "é"], ["", "a\n", "x" * 201, "a b"]),
    "calendar_date": (["2024-02-29"], ["2023-02-29", "2024-2-1", "2024-02-30"]),
    "partial_date": (["2024", "2024-02", "2024-02-03"], ["24", "2024-13", "2024-02-30"]),
    "utc_timestamp": (["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456Z"], ["2024-01-02T03:04:60Z", "2024-01-02T03:04:05+00:00", "2024-01-02 03:04:05Z"]),
    "http_url": (["https://a.example/", "http://a.example:8080/x?y=1", "http://192.0.2.1/", "http://localhost/"], ["https://a.example", "https://a.example:443/", "http://a.example/../x", "http://a.example/#f", "ftp://a/", "http://a.example:080/"]),
    "http_fingerprint_value": (["-123", "0", "a" * 64], ["-0", "+1", "01", "2147483648", "A" * 64]),
    "email_address": (["a.b@example.com"], ["A@example.com", "a..b@example.com", "a@", "@example.com"]),
    "advisory_id": (["CVE-2024-1234", "RUSTSEC-2024-0001", "EEF-CVE-2024-12345"], ["CVE-24-1", "RUSTSEC-2024-001", "cve-2024-1234"]),
}


def test_golden_formats(spark):
    for rule, (good, bad) in GOLDEN.items():
        rows = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, ok boolean")
        wrong = rows.where(F.coalesce(grammar.valid(rule, F.col("v")), F.lit(False)) != F.col("ok")).collect()
        assert not wrong, (rule, wrong)


def test_catalog_is_whole():
    assert len(NODES) == 35 and len(RELATIONS) == 52
    assert {t for r in RELATIONS.values() for t in (*r.sources, *r.targets)} <= set(NODES)
    assert {k for k, v in NODES.items() if v.inventory == "inherits"} == set(METHODS_OF_SCOPE)


def test_names(spark):
    want = {"example.com": ("example.com", "domain"), "a.b.example.co.uk": ("example.co.uk", "subdomain"), "x.foo.ck": ("x.foo.ck", "domain"), "www.ck": ("www.ck", "domain"), "a.www.ck": ("www.ck", "subdomain"), "com": (None, None), "a.unknown": ("a.unknown", "domain")}
    got = dns.classify(spark.createDataFrame([(n,) for n in want], "name string"), dns.sample_rules(spark)).collect()
    assert {r.name: (r.registrable, r.kind) for r in got} == want


def test_merge_equals_the_fold(spark):
    rng, writes = random.Random(11), []
    for record in range(120):
        for seq in range(rng.randrange(1, 9)):
            writes.append((record, seq, rng.randrange(6), f"p{rng.randrange(3)}", rng.random() < 0.3, str(rng.randrange(100)), rng.random() < 0.8))
    df = spark.createDataFrame(writes, "record int, seq int, observed int, path string, removed boolean, value string, reporting boolean")
    got = {(r.record, r.path): r.value for r in merge.merge_leaves(merge.with_fresh(df)).collect()}
    # blocks of two sequence numbers lead to the same
    assert {(r.record, r.path): r.value for r in merge.merge_leaves(merge.with_fresh(df, block=2)).collect()} == got
    want = {}
    for record in range(120):
        own = sorted(w for w in writes if w[0] == record)
        for path, value in merge.fold([(w[2], w[6], None if w[4] else {w[3]: w[5]}, [w[3]] if w[4] else []) for w in own]).items():
            want[record, path] = value
    assert got == want


def test_merged_trees_equal_the_fold(spark):
    rng, writes = random.Random(3), []
    paths = ["/a", "/a/b", "/a/c", "/a/b/d", "/a/b/e", "/f", "/f/g", "/h~1i", "/f/g/x/y"]
    histories = {}
    for record in range(400):
        own = []
        for seq in range(rng.randrange(1, 12)):
            observed, reporting, chosen, gone = rng.randrange(6), rng.random() < 0.8, {}, []
            for p in rng.sample(paths, rng.randrange(1, 4)):
                if any(p == q or p.startswith(q + "/") or q.startswith(p + "/") for q in [*chosen, *gone]):
                    continue
                if rng.random() < 0.25:
                    gone.append(p)
                else:
                    chosen[p] = "{}" if rng.random() < 0.15 else str(rng.randrange(100))
            own.append((observed, reporting, chosen, gone))
            writes += [(record, seq, observed, p, False, v, reporting) for p, v in chosen.items()] + [(record, seq, observed, p, True, None, reporting) for p in gone]
        histories[record] = own
    df = spark.createDataFrame(writes, "record int, seq int, observed int, path string, removed boolean, value string, reporting boolean")
    want = {(r, p): v for r, h in histories.items() for p, v in merge.fold(h).items()}
    for block in (1 << 20, 3):
        got = {(r.record, r.path): r.value for r in merge.merge_leaves(merge.with_fresh(df, block), block).collect()}
        assert got == want


def test_objects_and_scalars_in_turn(spark):
    leaf = lambda seq, path, value, fresh=True, removed=False: ("r", path, seq, fresh, removed, value)
    cases = [
        ([leaf(0, "/a", "{}"), leaf(1, "/a/b", "1"), leaf(2, "/a", "5")], {"/a": "5"}),
        ([leaf(0, "/a", "5"), leaf(1, "/a/b", "1")], {"/a/b": "1"}),
        ([leaf(0, "/a/b", "1"), leaf(1, "/a/b", None, removed=True)], {"/a": "{}"}),
        ([leaf(0, "/a", "5"), leaf(1, "/a/b", "1", fresh=False)], {"/a": "5"}),
        ([leaf(0, "/a/b", "1"), leaf(1, "/a", "5", fresh=False), leaf(2, "/a/c/d", "2", fresh=False)], {"/a/b": "1", "/a/c/d": "2"}),
        ([leaf(0, "/a", "5", fresh=False), leaf(1, "/a/b", "1", fresh=False), leaf(2, "/a/q", "3")], {"/a/q": "3"}),
        ([leaf(0, "/a", "5"), leaf(1, "/a", None, removed=True), leaf(2, "/a/b", "1", fresh=False), leaf(3, "/a", "7", fresh=False)], {"/a/b": "1"}),
        ([leaf(0, "/a/b", "[1]"), leaf(1, "/a/b", "{}"), leaf(2, "/a", "{}")], {"/a/b": "{}"}),
    ]
    rows = [(str(k), *row[1:]) for k, (own, _) in enumerate(cases) for row in own] + [(None, "/a", 0, True, False, "1"), ("x", None, 0, True, False, "1")]
    df = spark.createDataFrame(rows, "record string, path string, seq int, fresh boolean, removed boolean, value string")
    got = {(r.record, r.path): r.value for r in merge.merge_leaves(df).collect()}
    assert got == {(str(k), path): value for k, (_, want) in enumerate(cases) for path, value in want.items()}
    assert merge.merge_leaves(df.limit(0)).count() == 0


def test_bounded_traversal(spark):
    rng = random.Random(12)
    edges = [(k, rng.randrange(30), rng.randrange(30)) for k in range(120)]
    df = spark.createDataFrame(edges, "ord bigint, source_id bigint, target_id bigint")

    def plain(seeds, depth, max_nodes, max_edges):
        nodes, taken, level = list(seeds), [], dict.fromkeys(seeds, 0)
        for owner in nodes:
            if level[owner] == depth:
                continue
            for k, a, b in edges:
                if owner not in (a, b) or k in taken:
                    continue
                far = b if a == owner else a
                why = "max_edges" if len(taken) + 1 > max_edges else "max_nodes" if far not in level and len(nodes) + 1 > max_nodes else None
                if why:
                    return nodes, taken, why, [n for n in nodes[nodes.index(owner) :] if level[n] < depth]
                taken.append(k)
                if far not in level:
                    nodes.append(far)
                    level[far] = level[owner] + 1
        return nodes, taken, None, []

    listed = lambda rows, name: [r[name] for r in rows.orderBy("place").collect()]
    for budget in ((1, 100, 300), (2, 10, 300), (2, 100, 15), (3, 100, 300), (3, 2, 300), (3, 100, 0), (3, 29, 300), (0, 9, 9)):
        got = traverse.bounded(df, [3, 7, 3], *budget)
        nodes, taken, reason, frontier = plain([3, 7], *budget)
        assert (listed(got["nodes"], "node_id"), listed(got["edges"], "ord"), got["reason"]) == (nodes, taken, reason), budget
        assert listed(got["frontier"], "node_id") == frontier and got["truncated"] == (reason is not None)
        assert listed(got["nodes"], "place") == list(range(len(nodes)))


def test_retention_equals_one_ranking(spark):
    rng = random.Random(13)
    jobs = [(k, rng.choice("ab"), rng.randrange(20) * 43_200_000_000 + rng.randrange(3), rng.random() < 0.1) for k in range(300)]
    df = spark.createDataFrame(jobs, "job_id bigint, state string, finished_us bigint, protected boolean")
    for newest in (0, 1, 40, 1000):
        got = {r.job_id: r.prune for r in state.retained(df, newest, 3 * 86_400_000_000).collect()}
        for group in "ab":
            own = sorted((j for j in jobs if j[1] == group and not j[3]), key=lambda j: (-j[2], -j[0]))
            for place, j in enumerate(own):
                assert got[j[0]] == (j[2] < 3 * 86_400_000_000 or place >= newest)
        assert not any(got[j[0]] for j in jobs if j[3])


def test_pointers_and_redaction():
    doc = {"a/b": {"~": [1, {"x": None}]}, "e": [], "o": {}}
    assert {p: v for p, v, _, _ in jsonwalk.leaves(doc)} == {"/a~1b/~0/0": 1, "/a~1b/~0/1/x": None, "/e": [], "/o": {}}
    assert jsonwalk.resolve(doc, "/a~1b/~0/1/x") == (True, None) and jsonwalk.resolve(doc, "/a~1b/~0/01")[0] is False
    assert jsonwalk.redact({"k": ["s", "t"], "n": 1}, {"/k"}) == {"k": ["[REDACTED]"] * 2, "n": 1}
    assert jsonwalk.secret_key({"a": [{"Password": 1}]}) == "/a/0/Password" and jsonwalk.secret_key({"a": 1}) is None
    assert jsonwalk.merge({"a": {"b": 1}}, {"a": {"b": 2, "c": 3}}, missing_only=True) == {"a": {"b": 1, "c": 3}}


def test_predicates_match_plain_evaluation(spark):
    docs = ['{"p": 443}', '{"p": "443"}', '{"p": null}', "{}", '{"p": true}', '{"p": [1, 2]}', '{"p": 443.5}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, d string").withColumn("v", F.parse_json("d"))
    for op, value, want in (("eq", 443, {0}), ("eq", "443", {1}), ("eq", None, {2}), ("eq", True, {4}), ("ne", 443, {1, 2, 4, 5, 6}), ("gt", 443, {6}), ("lte", 443, {0}), ("gte", "4", {1}), ("in", [443, "443"], {0, 1}), ("exists", True, {0, 1, 2, 4, 5, 6}), ("exists", False, {3})):
        assert {r.id for r in df.where(properties.predicate(F.col("v"), op, "/p", value)).collect()} == want, (op, value)
    assert {r.id for r in df.where(properties.predicate(F.col("v"), "eq", "/p/1", 2)).collect()} == {5}


def test_index_budget(spark):
    leaves = spark.createDataFrame([(1, f"/x{k:04}", "number", "1", k % 2 == 0, 1) for k in range(600)] + [(1, "/must", "string", '"' + "é" * 600 + '"', True, 1)], "owner bigint, path string, kind string, value string, in_array boolean, depth int")
    kept = properties.indexed(leaves, ["/must"]).collect()
    assert len(kept) == 512 and {r.materialized for r in kept if r.path == "/must"} == {False}
    assert sum(int(r.path[2:]) % 2 for r in kept if r.path != "/must") == 300


@pytest.mark.parametrize("size", [40, 64])
def test_chunks_cover_the_text(size):
    rng = random.Random(14)
    text = " ".join("".join(rng.choice("abéß") for _ in range(rng.randrange(1, 9))) for _ in range(60))
    parts, at = list(evidence.chunked(text, size, 12)), 0
    for _, start, end, owned, _, body in parts:
        assert body.encode() == text.encode()[start:end] and start <= owned <= at or owned == at
        at = end
    assert at == len(text.encode())


def test_transforms_keep_null(spark):
    row = spark.createDataFrame([(None,)], "v string").select(*[transforms.apply_chain(F.col("v"), [n]).cast("string").alias(n) for n in transforms.TRANSFORMS if n not in ("sorted_set", "mta_sts_mx_lines")]).first()
    assert not [k for k, v in row.asDict().items() if v is not None and k not in ("colon_hex_serial_to_lower_hex", "san_coverage")]


def test_effective_state_by_walking(spark):
    rng = random.Random(15)
    nodes = {0: (None, True), 1: (None, True)}
    for k in range(2, 40):
        parents = [n for n, (p, c) in nodes.items() if c or nodes[p][1]]
        nodes[k] = (rng.choice(parents), False)
    marks = {k: rng.choice([None, None, "in_scope", "out_of_scope"]) for k in nodes}
    roots = {0: ("owned", "in_scope", True), 1: ("candidate", "unknown", False)}
    rows = [(k, p, c, *(roots[k] if c else (None, None, None)), None if c else marks[k]) for k, (p, c) in nodes.items()]
    df = spark.createDataFrame(rows, "node_id int, parent_id int, carrying boolean, ownership string, authorization string, allowlist boolean, override string")
    got = {r.node_id: (r.ownership, r.authorization) for r in state.effective(df).collect()}
    for k in nodes:
        chain, at = [k], k
        while not nodes[at][1]:
            at = nodes[at][0]
            chain.append(at)
        own, said, listed = roots[at]
        held = {marks[x] for x in chain[:-1]}
        want = "out_of_scope" if "out_of_scope" in held or said == "out_of_scope" else ("in_scope" if "in_scope" in held else "unknown") if listed and k != at else said
        assert got[k] == (own, want)


def test_relation_ends(spark):
    rows = [("has_open_port", 1, "ip_address", 2, "port"), ("has_open_port", 1, "domain", 2, "port"), ("cname_to", 1, "domain", 1, "domain"), ("has_subdomain", 1, "subdomain", 1, "subdomain"), ("no_such", 1, "a", 2, "b")]
    got = validation.end_reasons(spark.createDataFrame(rows, "type string, source_id int, source_type string, target_id int, target_type string"))
    assert {(r.type, r.source_type): r.reason for r in got.collect()} == {("has_open_port", "ip_address"): None, ("has_open_port", "domain"): "end types", ("cname_to", "domain"): None, ("has_subdomain", "subdomain"): "self edge", ("no_such", "a"): "unknown relation type"}


def test_alias_direction(spark):
    rows = [("GHSA-2345-cfgh-jmpq", "CVE-2024-1234", True), ("CVE-2024-1234", "GHSA-2345-cfgh-jmpq", False), ("CVE-2024-1234", "CVE-2024-1235", False), ("GO-2024-0001", "OSV-2024-1", True), ("OSV-2024-1", "GO-2024-0001", False)]
    got = spark.createDataFrame(rows, "a string, b string, ok boolean").where(checks.alias_direction(F.col("a"), F.col("b")).isNull() != F.col("ok"))
    assert got.count() == 0


def test_epochs_apply_once(spark, tmp_path):
    """A batch whose end was not recorded runs again, on the state before it, and replaces its own changes."""
    rows = spark.createDataFrame([("a", 5), ("a", 9), ("b", 3), ("b", 10**12), (None, 4), ("c", None)], "record string, observed bigint")
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    want = [("a", 5, 9, 2), ("b", 3, 3, 1)]
    assert sorted(map(tuple, ingest.ingest_spans(stream(), f"{tmp_path}/out", 1000).collect())) == want
    for name in ("0", ".0.crc"):
        os.remove(f"{tmp_path}/out/progress/commits/{name}")
    assert sorted(map(tuple, ingest.ingest_spans(stream(), f"{tmp_path}/out", 1000).collect())) == want
    assert sorted(r.record or "" for r in spark.read.parquet(f"{tmp_path}/out/refused").collect()) == ["", "b", "c"]


def test_every_type_validates(spark):
    from orrery.functions import grammar
    from orrery.operators import catalog, validation

    lists = {"epp_status_list", "tag_list", "mx_pattern_list", "alpn_tokens"}
    numbers = {*grammar.INTEGERS, *grammar.LISTED, "cvss_score", "probability"}

    def column(rule):
        kind = "array<string>" if rule in lists else "array<struct<name:string,value:string>>" if rule == "caa_parameters" else "double" if rule in ("cvss_score", "probability") else "bigint" if rule in numbers else "boolean" if rule == "boolean" else "string"
        return F.lit(None).cast(kind)

    row = spark.range(1)
    for kind, t in catalog.NODES.items():
        rules = {**t.required, **t.optional}
        got = row.select(validation.node_reason(kind, {name: column(rule) for name, rule in rules.items()})).first()[0]
        assert got == (f"{next(iter(t.required))}: required" if t.required else None), kind
    for t in catalog.RELATIONS.values():
        row.select(*[grammar.valid(rule, column(rule)).alias(f"c{i}") for i, rule in enumerate((*t.required.values(), *t.optional.values()))]).collect()


def test_formats(spark):
    from orrery.functions import grammar

    cases = {
        "dns_name": (("example.com", "my_service.example.com", "xn--bcher-kva.example"), ("example", "example.com.", "192.0.2.1", "a..b", "Example.com", "_.example.com", "")),
        "ip": (("192.0.2.1", "2001:db8::1"), ("192.0.2.256", "2001:DB8::1", "::ffff:192.0.2.1", "fe80::1%1")),
        "cidr": (("192.0.2.0/24", "2001:db8::/32"), ("192.0.2.1/24", "192.0.2.0", "2001:db8::1/32")),
        "cpe23": (("cpe:2.3:a:f5:nginx:1.25:*:*:*:*:*:*:*",), ("cpe:2.3:a:f5:nginx", "cpe:/a:f5:nginx", "cpe:2.3:x:f5:nginx:1:*:*:*:*:*:*:*")),
        "package_purl": (
            ("pkg:npm/JSONStream", "pkg:npm/%40scope/name", "pkg:golang/github.com/a/b", "pkg:cargo/serde_json", "pkg:nuget/newtonsoft.json", "pkg:oci/app?repository_url=ghcr.io/acme/app"),
            ("pkg:cargo/Serde", "pkg:cargo/serde-json", "pkg:nuget/Newtonsoft.Json", "pkg:golang/single", "pkg:oci/app?repository_url=index.docker.io/acme/app", "pkg:docker/app", "pkg:pypi/" + "a" * 600),
        ),
        "service_name": (("http", "http-proxy"), ("HTTP", "")),
        "public_suffix": (("com", "co.uk"), ("COM", "a..b")),
        "dns_or_explicit_empty": (("", "example.com"), ("example",)),
    }
    for rule, (good, bad) in cases.items():
        df = spark.createDataFrame([(v,) for v in (*good, *bad)], "v string")
        got = {r.v: r.ok for r in df.select("v", grammar.valid(rule, F.col("v")).alias("ok")).collect()}
        assert got == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False)}, rule
    lists = {
        "tag_list": ((["a"], ["a", "b"]), ([], ["b", "a"], ["a", "a"], ["A"])),
        "mx_pattern_list": (([], ["*.example.com", "mx.example.com"]), (["mx"], ["b.example.com", "a.example.com"])),
        "epp_status_list": ((["clientHold", "ok"],), ([], ["ok", "clientHold"], ["OK"])),
        "alpn_tokens": (([], ["h2", "http/1.1"]), (["h 2"], [""])),
    }
    for rule, (good, bad) in lists.items():
        for value, want in [*((v, True) for v in good), *((v, False) for v in bad)]:
            assert spark.createDataFrame([(value,)], "v array<string>").select(grammar.valid(rule, F.col("v"))).first()[0] is want, (rule, value)
    for rule, value, want in (("cvss_score", 9.8, True), ("cvss_score", 9.81, False), ("cvss_score", 10.1, False), ("probability", 0.5, True), ("probability", 1.5, False)):
        assert spark.range(1).select(grammar.valid(rule, F.lit(value))).first()[0] is want


def test_predicates_by_type(spark):
    from orrery.operators import properties

    def holds(document, op, path, value=None):
        return spark.createDataFrame([(document,)], "d string").select(properties.predicate(F.parse_json("d"), op, path, value)).first()[0]

    deep = '{"a": {"0": 5, "01": 6}, "b": [7, {"c": 8}], "n": 1e-10, "big": 1e30, "s": "443", "i": 9007199254740993, "z": null, "t": true, "it\'s": 1}'
    for op, path, value, want in (
        ("eq", "/a/0", 5, True), ("eq", "/a/01", 6, True), ("eq", "/b/0", 7, True), ("eq", "/b/1/c", 8, True), ("eq", "/b/01", 7, False), ("eq", "/n", 0, False), ("gt", "/n", 0, True),
        ("gt", "/big", 1, True), ("eq", "/s", 443, False), ("eq", "/s", "443", True), ("ne", "/s", 443, True), ("eq", "/i", 9007199254740993, True), ("eq", "/i", 9007199254740992, False),
        ("eq", "/z", None, True), ("ne", "/gone", 1, False), ("exists", "/z", True, True), ("exists", "/gone", False, True), ("eq", "/t", True, True), ("eq", "/t", 1, False), ("gt", "/s", 1, False),
        ("lt", "/s", "5", True), ("eq", "/it's", 1, True), ("in", "/b/0", [1, 7], True), ("eq", "/a", 5, False), ("gt", "/t", False, False), ("eq", "/n", 1e-10, True),
    ):
        assert holds(deep, op, path, value) is want, (op, path, value)


def test_chunks_of_wide_letters():
    from orrery.operators.evidence import chunked

    rng = random.Random(5)
    texts = ["", "a", "仲" * 5000, "é" * 9000, "😀" * 3000, "".join(rng.choice("ab é仲😀\n.") for _ in range(20000)), "word " * 4000, "x" * 10000]
    for text in texts:
        data = text.encode()
        for size, overlap in ((4096, 256), (64, 8), (65536, 2048)):
            parts = list(chunked(text, size, overlap))
            assert parts[0][1] == 0 and parts[-1][2] == len(data)
            owned = b"".join(data[p[3] : p[2]] for p in parts)
            assert owned == data
            for (_, start, end, owner, line, body), following in zip(parts, [*parts[1:], None]):
                assert data[start:end].decode() == body and line == data[:start].count(b"\n") + 1 and start <= owner <= end and end - start <= size
                if following:
                    assert following[3] == end and end - overlap - 4 <= following[1] <= end


def test_tokens_lose_their_marks(spark):
    from orrery.operators import search

    df = spark.createDataFrame([("Éléphant naïve e\u0301a Straße Ωμέγα Ελλάς 你好 a1_b2",)], "t string")
    assert df.select(search.tokens(F.col("t"))).first()[0] == ["elephant", "naive", "ea", "straße", "ωμεγα", "ελλας", "你好", "a1", "b2"]


def test_secret_keys_in_order():
    from orrery.functions.jsonwalk import secret_key

    assert secret_key({"b": {"KEY": 1}, "a": [{"x": 1}, {"Value": 2}]}) == "/a/1/Value"
    assert secret_key({"keys": 1, "tokens": [1]}) is None


def test_url_hosts(spark):
    from orrery.functions import transforms

    cases = {"HTTPS://Example.COM:8443/x": "example.com", "http://[2001:DB8::1]/": "2001:db8::1", "no url": None}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.h for r in df.select("u", transforms.apply_chain(F.col("u"), ["url_host"]).alias("h")).collect()} == cases


def test_streams_go_on_after_a_restart(spark, tmp_path):
    rng, writes = random.Random(13), []
    for seq in range(300):
        writes.append((f"r{rng.randrange(20)}", rng.choice(["/p", "/p/q", "/p/q/r", "s", None]), seq, rng.randrange(40), rng.random() < 0.8, rng.random() < 0.3, rng.choice(["{}", str(seq)])))
    schema = "record string, path string, seq bigint, observed bigint, reporting boolean, removed boolean, value string"
    changed = []
    for k in range(3):  # three runs, each with new arrivals, on the state of the last
        spark.createDataFrame(writes[k * 100 : (k + 1) * 100], schema).write.mode("append").parquet(f"{tmp_path}/in")
        log = ingest.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", compact_every=10 if k else 1)
        changed.append({r.record for r in log.read(spark).collect()})
    own = lambda record: [w for w in writes if w[0] == record]
    want = {}
    for record in {w[0] for w in writes}:
        history = [(w[3], w[4], None if w[5] or w[1] is None else {w[1]: w[6]}, [w[1]] if w[5] and w[1] else []) for w in own(record)]
        want.update({(record, path): value for path, value in merge.fold(history).items()})
    assert {(r.record, r.path): r.value for r in log.leaves(spark).collect()} == want
    times = {r: [w[3] for w in own(r) if w[4]] for r in {w[0] for w in writes}}
    seen = {r.record: (r.first_seen, r.last_seen, r.n) for r in log.spans(spark).collect()}
    assert seen == {r: (min(t, default=None), max(t, default=None), len(own(r))) for r, t in times.items()}
    before = sorted(map(str, log.read(spark).collect()))
    log.compact(spark)
    assert sorted(map(str, log.read(spark).collect())) == before and len(os.listdir(f"{tmp_path}/out/changes")) == 1


def test_a_batch_changes_its_own_records(spark, tmp_path):
    schema = "record string, path string, seq bigint, observed bigint, reporting boolean, removed boolean, value string"
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: ingest.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out")
    write([(f"r{k}", "/a", k, 100, True, False, "1") for k in range(50)])
    run()
    write([("r7", "/a", 60, 90, True, False, "2"), ("r7", "/b", 60, 90, True, False, "3"), ("new", "/a", 61, 5, True, False, "4")])  # one late, one new
    log = run()
    second = spark.read.parquet(f"{tmp_path}/out/changes/epoch=1").collect()
    assert sorted((r.record, r.path or "", r.value, r.created) for r in second) == [("new", "", None, True), ("new", "/a", "4", None), ("r7", "", None, False), ("r7", "/b", "3", None)]
    assert {(r.first_seen, r.last_seen, r.n) for r in log.spans(spark).where("record = 'r7'").collect()} == {(90, 100, 3)}


def test_a_stream_merges_a_batch_as_a_whole(spark, tmp_path):
    """Records are merged by joins and grouped maxima, not one by one in Python: no keyed state, and several writes of one seq have an order of their own."""
    schema = "record string, path string, seq bigint, tie bigint, observed bigint, reporting boolean, removed boolean, value string"
    late = [("a", "/p", 5, 2, 10, True, False, "late"), ("a", "/p", 5, 1, 20, True, False, "on time")]  # the tie, not the order of rows, decides
    both = [("b", "/q", 5, 1, 10, True, False, "set"), ("b", "/q", 5, 2, 10, True, True, None)]  # what goes at a seq goes before what is set
    spark.createDataFrame(late + both, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    log = ingest.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", compact_every=1)
    assert {(r.record, r.path): r.value for r in log.leaves(spark).collect()} == {("a", "/p"): "on time", ("b", "/q"): "set"}
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["changes", "progress", "refused", "refused-progress"] and not os.path.exists(f"{tmp_path}/out/progress/state")
    os.remove(f"{tmp_path}/out/progress/commits/0")  # the epoch runs again, and is part of the base already
    os.remove(f"{tmp_path}/out/progress/commits/.0.crc")
    spark.createDataFrame([("a", "/p", 6, 1, 15, True, False, "stale"), ("a", "/p/x", 7, 1, 30, True, False, "1")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    log = ingest.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", compact_every=1)
    assert {(r.record, r.path): r.value for r in log.leaves(spark).collect()} == {("a", "/p/x"): "1", ("b", "/q"): "set"}
    assert {r.record: (r.first_seen, r.last_seen, r.n) for r in log.spans(spark).collect()} == {"a": (10, 30, 4), "b": (10, 10, 2)}


def test_spans_of_a_stream_are_one_aggregate(spark, tmp_path):
    """Times of records need no leaves and no keyed state: many records cost one grouping a batch."""
    rows = spark.range(20000).selectExpr("concat('r', id % 5000) as record", "id as observed")
    for k in range(2):
        rows.where(f"id % 2 = {k}").write.mode("append").parquet(f"{tmp_path}/in")
        got = ingest.ingest_spans(spark.readStream.schema("record string, observed bigint").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", 10**9)
    assert not os.path.exists(f"{tmp_path}/out/progress/state")
    assert got.where("n != 4 or last_seen - first_seen != 15000 or first_seen != cast(substr(record, 2) as bigint)").count() == 0 and got.count() == 5000


def test_rules_with_qualifiers(spark):
    from orrery.operators import mapping

    leaves = spark.createDataFrame([(1, "/a/b", "a.b"), (2, "/a/b", "a.b"), (1, "/c", "c")], "owner bigint, path string, field string")
    rules = spark.createDataFrame([("a.b", "plain"), ("a.b{type=x}", "typed"), ("a.b{type=x,module=m}", "both"), ("*.b", "wild"), ("c{type=z}", "none")], "pattern string, sink string")
    records = spark.createDataFrame([(1, {"type": "x", "module": "m"}), (2, {"type": "y"})], "owner bigint, fields map<string,string>")
    got = sorted((r.owner, r.sink) for r in mapping.match(leaves, rules, records).collect())
    assert got == [(1, "both"), (2, "plain")]


def test_redaction_in_arrays(spark):
    from orrery.operators import mapping

    df = spark.createDataFrame([(1, '{"a": [{"k": "s1"}, {"k": "s2", "n": 1}], "t": ["x1", "x2"], "o": {"p": {"q": "z9"}}}')], "id bigint, d string")
    row = mapping.redacted(df, "id", "d", ["a[].k", "t", "o.*.q"]).first()
    assert row.document == '{"a":[{"k":"[REDACTED]"},{"k":"[REDACTED]","n":1}],"o":{"p":{"q":"[REDACTED]"}},"t":["[REDACTED]","[REDACTED]"]}'
    assert sorted(row.secrets) == ["s1", "s2", "x1", "x2", "z9"]


def test_references_across_chunks(spark):
    from orrery.operators import evidence, search

    rng = random.Random(6)
    texts = [(i, "".join(rng.choice(["ab ", "ab", " a", "é ", "ab ab ", "\n", "b-ab "]) for _ in range(400))) for i in range(6)] + [(9, "aa aa aa"), (10, None)]
    df = spark.createDataFrame(texts, "id bigint, t string")
    for phrase in ("ab", "ab ab", "é", "aa aa"):
        want = set()
        for i, t in texts:
            for a, z in search.places(t or "", phrase):
                want.add((i, len(t[:a].encode()), len(t[:z].encode()), t[:a].count("\n") + 1, t[:z].count("\n") + 1))
        got = [tuple(r) for r in search.references(evidence.chunks(df, "id", "t", 256, 32), phrase).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert list(search.places("aa aa aa", "aa aa")) == [(0, 5), (3, 8)]


def test_transitions_follow_accepted_states(spark):
    rng, rows = random.Random(3), []
    for record in range(15):
        for seq in range(rng.randrange(1, 40)):
            rows.append((record, seq, rng.choice(["owned", "candidate", "dependency", "rejected"]), rng.random() < 0.5))
    df = spark.createDataFrame(rows, "record bigint, seq bigint, after string, evidenced boolean")
    now, want = {}, {}
    for record, seq, after, evidenced in rows:
        before = now.get(record)
        ok = before == after or {"rejected": before == "candidate", "candidate": before != "rejected"}.get(after, evidenced)
        want[record, seq] = (before, ok)
        if ok:
            now[record] = after
    for block in (4, 1024):
        assert {(r.record, r.seq): (r.before, r.allowed) for r in statescan.accepted_transitions(df, block).collect()} == want


def test_registration_entities_at_any_depth(spark):
    from orrery.functions import registration

    card = lambda *lines: ["vcard", [[n, {}, "text", v] for n, v in lines]]
    person, desk = card(("kind", "individual"), ("fn", ""), ("fn", "Ann"), ("email", "ann@example.com")), card(("fn", "Desk"), ("tel", "tel:555"), ("tel", "tel:+1.415-555;ext=1"), ("email", ""))
    holder = card(("kind", "org"), ("fn", "Org"))
    answer = {
        "entities": [
            {"handle": "P", "roles": ["technical"], "vcardArray": person, "entities": [{"roles": ["abuse"], "vcardArray": desk, "entities": [{"handle": "Q", "roles": ["registrar"], "vcardArray": person}]}]},
            {"handle": "O", "roles": ["registrant"], "vcardArray": holder},
            {"roles": ["sponsor"], "vcardArray": "broken"},
            "no entity",
        ]
    }
    rows = registration.contacts(spark.createDataFrame([(1, json.dumps(answer)), (2, None), (3, "[1]"), (4, "{")], "id int, answer string"), "id", "answer").collect()
    told = {r.position: r for r in rows}
    assert {r.owner for r in rows} == {1} and len(rows) == 5
    # the technical contact's card is also the registrar's, so both roles hold for either entity
    assert [(told[k].rdap_registrar_name, told[k].rdap_registration_contact_email) for k in (0, 4)] == [("Ann", "ann@example.com")] * 2
    assert (told[1].rdap_holder_name, told[1].rdap_holder_handle, told[1].rdap_registration_contact_email) == ("Org", "O", None)
    assert (told[3].rdap_abuse_phone, told[3].rdap_abuse_email, told[3].rdap_holder_name) == ("+1415555", None, None)
    assert set(told[2][2:]) == {None}


def test_networks_that_ranges_span(spark):
    from orrery.functions import addresses

    cases = [("192.0.2.0", "192.0.2.255", "192.0.2.0/24"), ("192.0.2.1", "192.0.2.2", None), ("192.0.2.9", "192.0.2.1", None), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "2001:db8::/32"), ("192.0.2.0", "2001:db8::", None), (None, "192.0.2.1", None), ("x", "y", None), ("0.0.0.0", "255.255.255.255", "0.0.0.0/0")]
    rows = spark.createDataFrame(cases, "a string, b string, want string").select("want", addresses.spanned_network("a", "b").alias("got")).collect()
    assert all(r.got == r.want for r in rows), rows


def test_kinds_of_names_and_gates(spark):
    cases = {"Example.COM.": "domain", "a.example.com": "subdomain", "com": None, "192.0.2.1": None, "2001:db8::1": None, "": None, None: None, "x y.com": None, "a.example.co.uk": "subdomain", "example.co.uk": "domain"}
    rows = dns.with_kinds(spark.createDataFrame([(n,) for n in cases] + [("com",)], "n string"), F.col("n"), dns.sample_rules(spark))
    got = rows.select("n", "kind", transforms.public_suffix_of(F.col("n"), F.col("kind")).alias("suffix")).collect()
    assert len(got) == len(cases) + 1 and {r.n: r.kind for r in got} == cases
    assert {r.n: r.suffix for r in got if r.suffix} == {"Example.COM.": "com", "example.co.uk": "co.uk"}


def test_records_in_presentation_form(spark):
    cases = {
        "example. 300 IN MX 10 mail.example.": {"rr_mx_preference": "10"},
        "example. 300 IN A 192.0.2.1": {},
        'example. 300 IN CAA 128 issue ";"': {"rr_caa_issue_flags": "128", "rr_caa_issue_parameters": "[]"},
        'example. 300 IN CAA 0 ISSUEWILD "CA.example; A = b=c; ;d"': {"rr_caa_issuewild_flags": "0", "rr_caa_issuer": "ca.example", "rr_caa_issuewild_parameters": '[{"name":"a","value":"b=c"},{"name":"d","value":""}]'},
        'example. 300 IN CAA 0 iodef "MAILTO:A@Example.com"': {"rr_caa_iodef_email": "a@example.com"},
        'example. 300 IN CAA 0 iodef "HTTPS://Example.com/R"': {"rr_caa_iodef_url": "HTTPS://Example.com/R"},
        '0 issue "ca.example"': {},
    }
    names = ["rr_mx_preference", "rr_caa_issue_flags", "rr_caa_issuewild_flags", "rr_caa_issuer", "rr_caa_iodef_email", "rr_caa_iodef_url"]
    listed = ["rr_caa_issue_parameters", "rr_caa_issuewild_parameters"]
    go = lambda n: transforms.apply_chain(F.col("v"), [n])
    rows = spark.createDataFrame([(v,) for v in cases], "v string").select("v", *[go(n).cast("string").alias(n) for n in names], *[F.to_json(go(n)).alias(n) for n in listed]).collect()
    for r in rows:
        assert {n: r[n] for n in names + listed if r[n] is not None} == cases[r.v]


def test_inputs_of_both_address_versions(spark):
    rows = spark.createDataFrame([("192.0.2.1",), ("2001:db8::1",), ("example.com",), (None,)], "v string")
    got = [tuple(r) for r in rows.select(*[transforms.apply_chain(F.col("v"), [n]).alias(n) for n in ("if_ip_input", "if_name_input", "ip_version")]).collect()]
    assert got == [("192.0.2.1", None, 4), ("2001:db8::1", None, 6), (None, "example.com", 4), (None, None, None)]


def test_scoped_identities_parents_first(spark):
    import hashlib

    from orrery.operators import inventory

    rows = [
        ("a", "ip_address", None, {"version": "4", "value": '"192.0.2.1"'}),
        ("p", "port", "a", {"transport": '"tcp"', "number": "443"}),
        ("s", "service", "p", {"name": '"http"'}),
        ("x", "technology", "s", {"name": '"deeper"'}),
        ("o", "port", "nowhere", {"number": "1"}),
        ("e", "marker", None, {}),
    ]
    got = {r.ref: r for r in inventory.scoped(spark.createDataFrame(rows, "ref string, type string, parent string, members map<string,string>")).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    address = sha("ip_address:" + sha('{"value":"192.0.2.1","version":4}'))
    port = sha("port:" + sha('{"number":443,"parent":"%s","transport":"tcp"}' % address))
    service = sha("service:" + sha('{"name":"http","parent":"%s"}' % port))
    assert {k: r.node_id for k, r in got.items()} == {"a": address, "p": port, "s": service, "e": sha("marker:")}
    assert got["s"].parent_id == port and got["e"].key == ""


def test_property_patches():
    from orrery.operators.patches import patch

    now = {"a": {"b": 1, "c": {"d": 2}}, "l": [1, {"x": 1}], "s": 3, "t/~": 4}
    cases = [
        ({"a": {"b": 5}}, [], {**now, "a": {"b": 5, "c": {"d": 2}}}),
        ({"a": {}}, [], now),
        ({"l": [2]}, ["/a/c", "/t~1~0"], {"a": {"b": 1}, "l": [2], "s": 3}),
        ({"s": {"new": 1}}, ["/gone/far"], {**now, "s": {"new": 1}}),
        ({"a": {"b": 5}}, ["/a"], "remove and set conflict"),
        ({"a": {}}, ["/a"], "remove and set conflict"),
        ({"a": {"b": 5}}, ["/a/c/d"], {**now, "a": {"b": 5, "c": {}}}),
        ({"s": 1}, ["/s/x"], "remove and set conflict"),
        ({"n": {"m": {}}}, ["/n/m"], "remove and set conflict"),
        ({"n": {"m": {}}}, ["/n/m/k"], {**now, "n": {"m": {}}}),
        ({}, ["/l/0"], "array element removal"),
        ({}, ["/l/1/x"], "array element removal"),
        ({}, ["a"], "invalid pointer"),
        ({}, ["/a~2"], "invalid pointer"),
        ({"x": 1 << 63}, [], "integer out of range"),
        ({"x": float("nan")}, [], "number not finite"),
        ({"x": "y" * 65536}, [], "too large"),
    ]
    for change, removals, want in cases:
        got, reason = patch(now, change, removals)
        assert (reason or got) == want, (change, removals)
    deep = {}
    for _ in range(17):
        deep = {"k": deep}
    assert patch({}, deep, []) == (None, "too deep") and patch({}, deep["k"], [])[1] is None


def test_patched_rows_and_limits(spark):
    from orrery.operators import patches

    rows = spark.createDataFrame([(1, None, '{"a":1}', None, False), (2, '{"a":1}', None, ["/a"], False), (3, "{", "{}", [], True), (4, '{"a":1}', '{"a":2,"b":3}', ["/a"], True), (5, '{"a":1,"b":2}', "{}", ["/a", None], False)], "id int, c string, p string, r array<string>, s boolean")
    got = {r.owner: (r.document, r.reason) for r in patches.patched(rows, "id", "c", "p", "r", "s").collect()}
    assert got == {1: ('{"a":1}', None), 2: (None, "no object"), 3: (None, "no JSON"), 4: ('{"a":1,"b":3}', None), 5: ('{"b":2}', None)}
    told = {r.owner: (r.depth, r.bytes, r.secret, r.reason) for r in patches.limits(rows, "id", "p").collect()}
    assert told[2] == (None, None, None, "no object") and told[1] == (1, 7, None, None)


def test_bm25_takes_the_best_row_of_each_word(spark):
    import math

    from orrery.operators import search

    texts = [(1, "red fox"), (1, "red red hen and more words"), (2, "red only"), (3, "fox and red and fox"), (4, "nothing here"), (5, None)]
    got = {r.unit: r.score for r in search.bm25(spark.createDataFrame(texts, "unit int, text string"), ["red", "fox"]).collect()}
    split = [(u, (t or "").split()) for u, t in texts]
    mean = sum(len(w) for _, w in split if w) / sum(1 for _, w in split if w)
    want = {}
    for word in ("red", "fox"):
        df = sum(word in w for _, w in split)
        idf = max(1e-6, math.log((len(split) - df + 0.5) / (df + 0.5)))
        for unit, w in split:
            tf = w.count(word)
            if tf:
                score = -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
                want.setdefault(unit, {})[word] = min(score, want.get(unit, {}).get(word, 0))
    want = {u: sum(s.values()) for u, s in want.items() if len(s) == 2}
    assert got == pytest.approx(want)


def test_reindexing_marks_what_does_not_decode(spark):
    from orrery.operators import reindex

    items = [(1, b"plain", "text/plain", None, 1), (2, b"\xff\xfea\x00", "text/html", None, 1), (3, b"\xc3", "text/plain", None, 4), (4, b"x", "image/png", None, 1), (5, "é".encode(), "text/plain", "latin-1", 1), (6, None, "text/plain", None, 1), (7, b"x", "text/plain", "no-such", 1), (8, b"\xff\xfe\x00\x00", "text/plain", None, 1), (9, b"x", None, None, 1)]
    frame = spark.createDataFrame(items, "owner long, content binary, media string, encoding string, generation int")
    named = spark.createDataFrame([(4, "text/plain", None), (1, None, "utf-16-le")], "owner long, media string, encoding string")
    states, units = reindex.rebuilt(reindex.overridden(frame, named))
    got = {r.owner: (r.generation, r.index_state, r.incomplete) for r in states.collect()}
    assert got == {1: (2, "index_failed", True), 2: (1, "indexed", False), 3: (4, "index_failed", True), 4: (2, "indexed", False), 5: (1, "indexed", False), 6: (1, "index_failed", True), 7: (1, "index_failed", True), 8: (1, "index_failed", True), 9: (1, "not_applicable", False)}
    assert {r.owner: r.text for r in reindex.current(units, states).collect()} == {2: "a", 4: "x", 5: "Ã©"}
    assert reindex.rebuilt(frame.limit(0))[0].count() == 0


def test_snippets_hold_whole_characters(spark):
    from orrery.operators import search

    rows = spark.createDataFrame([("x the 仲仲仲",), ("the é",), ("the",), ("thé the " + "😀" * 9,), (None,)], "t string")
    got = [r[0] for r in rows.select(search.snippet(F.col("t"), F.instr("t", "the"), 8)).collect()]
    assert got == ["the 仲", "the é", "the", "the 😀", None]


def test_write_requests_and_their_refusals(spark):
    from orrery.sources import readers

    e = "e_" + "a" * 64
    nodes = [
        ({"type": "t", "properties": {"n": 1, "big": 12345678901234567890, "s": "1"}}, None),
        ({"type": "t"}, "creation needs type and properties"),
        ({"id": "x"}, None),
        ({"id": "x", "observed_at": None}, "observed_at: null"),
        ({"id": "x", "properties": {"ownership": "owned"}}, "properties: reserved name"),
        ({"id": "x", "properties": [1]}, "properties: no object"),
        ({"id": "x", "source_ref": {"id": "a"}}, "unknown field"),
        ({"id": "x", "evidence_add": [e], "evidence_remove": [e]}, "evidence: added and removed"),
        ({"id": "x", "evidence_add": [e, e]}, "evidence: repeated"),
        ({"id": "x", "evidence_add": ["e_1"]}, "evidence_add: no evidence id"),
        ({"id": "x", "source": "é" * 129}, "source: too long"),
        ("text", "no object"),
    ]
    relations = [
        ({"type": "r", "properties": {}, "source_ref": {"node_index": 0}, "target_ref": {"id": "a"}}, None),
        ({"type": "r", "properties": {}, "source_ref": {"node_index": 0}}, "creation needs both endpoints"),
        ({"id": "x", "source_ref": {}}, "source_ref: one of id and node_index"),
        ({"id": "x", "label": "l"}, "unknown field"),
    ]
    request = json.dumps({"nodes": [n for n, _ in nodes], "relations": [r for r, _ in relations]})
    items = readers.request_items(spark.createDataFrame([(1, request), (2, "{"), (3, None), (4, "{}")], "batch_id int, request string"))
    rows = items.select("*", checks.write_reason().alias("reason")).collect()
    got = {(r.kind, r.item_index): r.reason for r in rows}
    want = {("node", k): reason for k, (_, reason) in enumerate(nodes)} | {("relation", k): reason for k, (_, reason) in enumerate(relations)}
    assert got == want
    first = next(r for r in rows if (r.kind, r.item_index) == ("node", 0))
    assert json.loads(first.properties) == nodes[0][0]["properties"] and first.named == ["properties", "type"]


def test_filters_and_combined_search(spark):
    from orrery.operators import search

    records = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 7), (4, None, 9)], "id int, type string, byte_size int")
    ids = lambda df: sorted(r[0] for r in df.select("id").collect())
    assert ids(search.filtered(records, {"type": "a"})) == [1, 2] and ids(search.filtered(records, {"byte_size_min": 5, "byte_size_max": 7})) == [1, 3]
    assert ids(search.filtered(records, {"type": None})) == [1, 2, 3, 4]
    sources = spark.createDataFrame([(3, "x"), (3, "x"), (3, "y"), (1, "y")], "id int, source string")
    assert ids(search.filtered(records, {"source": "x"}, sources)) == [3]
    with pytest.raises(ValueError):
        search.filtered(records, {"colour": "red"})
    units = spark.createDataFrame([(1, "red fox and much else"), (3, "red"), (9, "red"), (8, "fox")], "unit int, text string")
    links = spark.createDataFrame([(1, 9), (1, 9), (3, 9), (2, 8), (7, 9)], "owner int, unit int")
    found = {r.id: (r.unit, r.is_evidence) for r in search.combined(records, None, units, ["red"], links).collect()}
    assert found == {1: (9, True), 3: (3, False)}  # of equal scores the record's own text goes first
    assert ids(search.combined(records, records.where("id > 2"))) == [3, 4]
