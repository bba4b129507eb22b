"""Queries on value rules, record checks and the remaining transforms; inputs are spelled from the tables' columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import addresses, grammar, hosts, jsonwalk, registration, transforms
from orrery.operators import checks, mapping, merge, patches, validation
from orrery.plans.book import query, table
from orrery.plans.events import _A1
from orrery.sources import storage
from orrery.streaming import ingest


def _pick(column: str, *values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


@query(
    "V14_cvss_vector",
    """SELECT p_partkey, p_partkey % 4 = 0 AS valid FROM part""",
)
def v14(spark, sf_dir):
    whole = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    v = _pick("p_partkey", whole, whole + "/AV:L", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H", "CVSS:2.0/AV:N")
    return table(spark, sf_dir, "part").select("p_partkey", grammar.valid("cvss_vector", v).alias("valid"))


@query(
    "V15_advisory_ids",
    """WITH a AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'CVE-2024-' || (1000 + p_partkey) WHEN 1 THEN 'GHSA-2345-cfgh-jmpq' WHEN 2 THEN 'GO-2024-' || p_partkey ELSE 'XYZ-2024-1' END AS v FROM part)
    SELECT p_partkey, v, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN regexp_full_match(v, 'GO-[0-9]{4}-([0-9]{4}|[1-9][0-9]{4,6})') ELSE false END AS valid, split_part(v, '-', 1) AS prefix FROM a""",
)
def v15(spark, sf_dir):
    k = F.col("p_partkey")
    v = F.when(k % 4 == 0, F.concat(F.lit("CVE-2024-"), (k + 1000).cast("string"))).when(k % 4 == 1, "GHSA-2345-cfgh-jmpq").when(k % 4 == 2, F.concat(F.lit("GO-2024-"), k.cast("string"))).otherwise("XYZ-2024-1")
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", "v", grammar.valid("advisory_id", F.col("v")).alias("valid"), F.split_part("v", F.lit("-"), F.lit(1)).alias("prefix"))


@query(
    "V16_package_purl",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'purl' END AS reason FROM part",
)
def v16(spark, sf_dir):
    k = _text("p_partkey")
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("pkg:pypi/name-"), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("pkg:npm/%40scope/name"), k)).otherwise(F.concat(F.lit("pkg:pypi/Name_"), k))
    return table(spark, sf_dir, "part").select("p_partkey", checks.package_purl(v).alias("reason"))


@query(
    "V17_ip_addresses",
    "SELECT c_custkey, c_custkey % 3 = 0 AND c_custkey % 300 <= 255 AS valid, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 300 <= 255 THEN 4 ELSE 0 END AS version FROM customer",
)
def v17(spark, sf_dir):
    n = (F.col("c_custkey") % 300).cast("string")
    ip = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("203.0.113."), n)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("203.0.113.0"), n)).otherwise(F.concat(F.lit("203.0."), n))
    return table(spark, sf_dir, "customer").select("c_custkey", grammar.valid("ipv4", ip).alias("valid"), F.when(grammar.valid("ipv4", ip), transforms.apply_chain(ip, ["ip_version"])).otherwise(0).alias("version"))


@query(
    "V20_email_address",
    "SELECT c_custkey, c_custkey % 3 = 0 AS valid FROM customer",
)
def v20(spark, sf_dir):
    k = _text("c_custkey")
    v = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("user."), k, F.lit("@mail.example.com"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("User"), k, F.lit("@example.com"))).otherwise(F.concat(k, F.lit("..x@example.com")))
    return table(spark, sf_dir, "customer").select("c_custkey", grammar.valid("email_address", v).alias("valid"))


@query(
    "V22_account_and_tenant",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN 'account_id: not the provider''s spelling' END AS account, CASE WHEN s_suppkey % 2 = 1 THEN 'tenant_id: not the provider''s spelling' END AS tenant,
    CASE WHEN s_suppkey % 4 = 3 THEN 'owner: not the platform''s spelling' END AS owner FROM supplier""",
)
def v22(spark, sf_dir):
    account = F.lpad(_text("s_suppkey"), 12, "0")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        checks.account_spelling(_pick("s_suppkey", "aws", "gcp", "azure"), account).alias("account"),
        checks.tenant_spelling(_pick("s_suppkey", "okta", "entra_id"), F.concat(F.lit("t"), _text("s_suppkey"))).alias("tenant"),
        checks.owner_spelling(_pick("s_suppkey", "github", "gitlab", "gitea", "bitbucket"), F.when(F.col("s_suppkey") % 4 == 3, "-x").otherwise(F.concat(F.lit("o"), _text("s_suppkey")))).alias("owner"),
    )


@query(
    "V22_record_checks",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'port: not assigned' END AS port, CASE WHEN p_partkey % 3 = 0 THEN 'registry_domain_id: placeholder' END AS roid,
    CASE WHEN p_partkey % 2 = 1 THEN 'value: length does not fit the kind' END AS tls, CASE WHEN p_partkey % 2 = 0 THEN 'scores describe CVE ids only' END AS scores,
    CASE WHEN p_partkey % 2 = 0 THEN 'value: a type of its own' END AS txt, CASE WHEN p_partkey % 2 = 1 THEN 'cpe: not product level' END AS cpe,
    CASE WHEN p_partkey % 2 = 1 THEN 'version: does not fit the address' END AS ip, CASE WHEN p_partkey % 2 = 0 THEN 'secure: required' END AS secure FROM part""",
)
def v22b(spark, sf_dir):
    k = "p_partkey"
    return table(spark, sf_dir, "part").select(
        k,
        checks.assigned(F.col(k) % 5, "port").alias("port"),
        checks.registry_object(F.when(F.col(k) % 3 == 0, "REDACTED-COM").otherwise(F.concat(F.lit("D"), _text(k), F.lit("-COM")))).alias("roid"),
        checks.fingerprint_length(_pick(k, "jarm", "ja3s"), F.repeat(F.lit("a"), F.lit(62))).alias("tls"),
        checks.cve_scores(_pick(k, "GO-2024-1000", "CVE-2024-1000"), F.lit(0.5), F.lit(None).cast("double")).alias("scores"),
        checks.txt_diversion(_pick(k, "v=spf1 -all", "hello")).alias("txt"),
        checks.product_level(_pick(k, "cpe:2.3:a:f5:nginx:*:*:*:*:*:*:*:*", "cpe:2.3:a:f5:nginx:1.2:*:*:*:*:*:*:*")).alias("cpe"),
        checks.address_version(F.lit("192.0.2.1"), _pick(k, 4, 6)).alias("ip"),
        checks.secure_flag(F.lit("http"), ("http",), F.when(F.col(k) % 2 == 1, F.lit(True))).alias("secure"),
    )


@query(
    "V25_end_values",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN 'alias direction' END AS alias, CASE WHEN s_suppkey % 2 = 1 THEN 'role: packages only' END AS contact,
    CASE WHEN s_suppkey % 2 = 1 THEN 'registry is not the domain''s suffix' END AS registration, CASE WHEN s_suppkey % 2 = 1 THEN 'account of another provider' END AS provider FROM supplier""",
)
def v25(spark, sf_dir):
    k = "s_suppkey"
    return table(spark, sf_dir, "supplier").select(
        k,
        checks.alias_direction(_pick(k, "GO-2024-1000", "GHSA-2345-cfgh-jmpq", "CVE-2024-1000"), _pick(k, "GHSA-2345-cfgh-jmpq", "CVE-2024-1000", "GO-2024-1000")).alias("alias"),
        checks.contact_role(_pick(k, "package", "organization"), F.lit("email_address"), F.lit("maintainer")).alias("contact"),
        checks.registration_suffix(_pick(k, "example.com", "example.net"), F.lit("com")).alias("registration"),
        checks.provider_match(F.lit("aws_s3"), _pick(k, "aws", "gcp")).alias("provider"),
    )


@query(
    "V4_V10_caa_parameters",
    "SELECT s_suppkey, lower(s_name) AS name, s_name AS value FROM supplier",
)
def v4(spark, sf_dir):
    pairs = F.array(F.struct(F.col("s_name").alias("name"), F.col("s_name").alias("value")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(checks.caa_parameters(pairs)))


@query(
    "V26_batch_rules",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'label: too long' WHEN 1 THEN 'evidence: repeated' WHEN 2 THEN 'evidence: added and removed' END AS reason FROM orders",
)
def v26(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, F.repeat(F.lit("é"), F.lit(257))).otherwise("x")
    added = F.when(k == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    removed = F.when(k == 2, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.batch_rules(label, F.lit("tool"), added, removed).alias("reason"))


@query(
    "V31_strict_types",
    "SELECT c_custkey, c_custkey % 3 = 0 AS is_number, c_custkey % 3 = 1 AS is_text, c_custkey % 3 <> 2 AS differs FROM customer",
)
def v31(spark, sf_dir):
    from orrery.operators import properties

    document = F.when(F.col("c_custkey") % 3 == 0, '{"port": 443}').when(F.col("c_custkey") % 3 == 1, '{"port": "443"}').otherwise("{}")
    d = F.parse_json(document)
    return table(spark, sf_dir, "customer").select("c_custkey", properties.predicate(d, "eq", "/port", 443).alias("is_number"), properties.predicate(d, "eq", "/port", "443").alias("is_text"), properties.predicate(d, "ne", "/port", 80).alias("differs"))


@query(
    "J8_rejected_registrable_domain",
    "WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages) SELECT host FROM h WHERE len(string_split(host, '.')) > 2 AND host LIKE '%.example.org'",
)
def j8(spark, sf_dir):
    from orrery.functions import dns

    hosts = table(spark, sf_dir, "pages").select(transforms.apply_chain(F.col("url"), ["url_host"]).alias("name"))
    rejected = spark.createDataFrame([("example.org",)], "registrable string")
    return validation.under_rejected_domain(dns.classify(hosts, dns.sample_rules(spark)), rejected).select(F.col("name").alias("host"))


@query("V1_X4_document_limits", "SELECT event_id AS owner, 1 AS depth, '/token' AS secret, CASE WHEN event_id % 3 = 0 THEN 'integer out of range' END AS reason FROM events")
def v1(spark, sf_dir):
    number = F.when(F.col("event_id") % 3 == 0, "9223372036854775808").otherwise("-9223372036854775808")
    document = F.concat(F.substring_index("props", "}", 1), F.lit(', "token": "x", "n": '), number, F.lit("}"))
    return patches.limits(table(spark, sf_dir, "events").select("event_id", document.alias("document")), "event_id", "document").select("owner", "depth", "secret", "reason")


@query(
    "A2_X3_property_patch",
    """SELECT event_id AS owner, CASE WHEN event_id % 4 <> 3 THEN CAST(json_extract(props, '$.k') AS INT) END AS k, CASE WHEN event_id % 4 <> 3 THEN event_type END AS kind,
    CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN 'new' ELSE 'old' END AS tag, CASE WHEN event_id % 4 IN (0, 2) THEN 'x' END AS gone, CASE WHEN event_id % 4 = 3 THEN 'remove and set conflict' END AS reason FROM events""",
)
def a2(spark, sf_dir):
    """Every second change only adds what is missing; the others remove a property, every fourth one that it also sets."""
    r = F.col("event_id") % 4
    current = F.concat(F.substring_index("props", "}", 1), F.lit(', "tag": "old", "a/b": {"gone": "x"}}'))
    change = F.to_json(F.struct(F.col("event_type").alias("kind"), F.lit("new").alias("tag")))
    removals = F.when(r == 3, F.array(F.lit("/tag"))).otherwise(F.array(F.lit("/a~1b/gone"), F.lit("/absent/x")))
    rows = table(spark, sf_dir, "events").select("event_id", current.alias("current"), change.alias("change"), removals.alias("removals"), (r % 2 == 0).alias("stale"))
    merged = patches.patched(rows, "event_id", "current", "change", "removals", "stale")
    get = lambda p: F.get_json_object("document", p)
    return merged.select("owner", get("$.k").cast("int").alias("k"), get("$.kind").alias("kind"), get("$.tag").alias("tag"), get("$['a/b'].gone").alias("gone"), "reason")


@query("M4_each", "SELECT o_orderkey AS owner, list(DISTINCT lower(l_returnflag) ORDER BY lower(l_returnflag)) AS values FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def m4(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    each = flags.select("l_orderkey", F.transform("flags", lambda v: transforms.apply_chain(v, ["lower"])).alias("v"))
    joined = each.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_orderkey").alias("owner"), transforms.apply_chain(F.col("v"), ["sorted_set"]).alias("values"))


@query("M11_redaction_policy", "SELECT c_name AS pattern, 'finding.title' AS sink FROM customer WHERE c_custkey % 4 = 1")
def m11(spark, sf_dir):
    sink = _pick("c_custkey", "non_storable", "finding.title", "secret.value_sha256", "finding.title")
    rules = table(spark, sf_dir, "customer").select(F.col("c_name").alias("pattern"), sink.alias("sink"), (F.col("c_custkey") % 4 != 3).alias("redact"))
    return mapping.policy_breaches(rules, ["secret.value_sha256"])


@query(
    "T6_T13_spelled_transforms",
    """SELECT p_partkey, 'cpe:2.3:a:f5:nginx:' || p_partkey || ':*:*:*:*:*:*:*' AS cpe, 'cpe:2.3:a:f5:nginx:*:*:*:*:*:*:*:*' AS product, 'pkg:pypi/my-' || p_partkey AS purl,
    CAST(p_partkey % 100 AS INT) AS mx, 'ca' || p_partkey || '.example' AS issuer, '+1415' || (1000000 + p_partkey) AS phone, 'nuclei:rule-' || p_partkey AS rule, lpad(p_partkey::VARCHAR, 12, '0') AS account,
    'clientTransferProhibited' AS epp, 'exact' AS coverage, 'text/html' AS media, '1' || 'f' AS serial FROM part""",
)
def t6(spark, sf_dir):
    k = _text("p_partkey")
    go = lambda v, *names: transforms.apply_chain(v, list(names))
    uri = F.concat(F.lit("cpe:/a:f5:nginx:"), k)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        go(uri, "cpe22_uri_to_cpe23").alias("cpe"),
        go(uri, "cpe22_uri_to_cpe23", "cpe_product_level").alias("product"),
        go(F.concat(F.lit("My_."), k), "pypi_name_to_purl").alias("purl"),
        go(F.concat(F.lit("example. 300 IN MX "), (F.col("p_partkey") % 100).cast("string"), F.lit(" mail.example.")), "rr_mx_preference").alias("mx"),
        go(F.concat(F.lit('example. 300 IN CAA 0 issue "CA'), k, F.lit('.example; a=b"')), "rr_caa_issuer").alias("issuer"),
        go(F.concat(F.lit("+1.415"), (F.col("p_partkey") + 1000000).cast("string")), "whois_phone_e164").alias("phone"),
        go(F.concat(F.lit("rule-"), k), "nuclei_rule").alias("rule"),
        go(F.concat(F.lit("arn:aws:iam::"), F.lpad(k, 12, "0"), F.lit(":root")), "arn_account").alias("account"),
        go(F.lit("client transfer prohibited"), "rdap_status_to_epp").alias("epp"),
        go(F.concat(F.lit("a"), k, F.lit(".example")), "san_coverage").alias("coverage"),
        go(F.lit("Text/HTML; charset=x"), "media_type_essence").alias("media"),
        go(F.lit("00:1F"), "colon_hex_serial_to_lower_hex").alias("serial"),
    )


@query(
    "T11_T12_record_gates",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'v=spf1 -all' END AS spf, CASE WHEN s_suppkey % 3 = 1 THEN 'v=DMARC1; p=none' END AS dmarc, CASE WHEN s_suppkey % 3 = 2 THEN 'hello' END AS txt,
    CASE WHEN s_suppkey % 2 = 0 THEN '192.0.2.1' END AS ip, CASE WHEN s_suppkey % 2 = 1 THEN 'a.example' END AS name FROM supplier""",
)
def t11(spark, sf_dir):
    record, host = _pick("s_suppkey", "v=spf1 -all", "v=DMARC1; p=none", "hello"), _pick("s_suppkey", "192.0.2.1", "a.example")
    go = lambda v, n: transforms.apply_chain(v, [n])
    return table(spark, sf_dir, "supplier").select("s_suppkey", go(record, "if_spf_record").alias("spf"), go(record, "if_dmarc_record").alias("dmarc"), go(record, "if_txt_record").alias("txt"), go(host, "if_ip_input").alias("ip"), go(host, "if_name_input").alias("name"))


@query("R4_stream_distinct_evidence", "SELECT DISTINCT 'e_' || sha256(text) AS evidence_id, strlen(text)::INT AS byte_size FROM documents")
def r4(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(d.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    out = storage.fresh(spark, "evidence")
    found = ingest.distinct_evidence(stream.select(F.encode("text", "UTF-8").alias("content")))
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("R5_F13_reindex_changed", "SELECT doc_id AS owner, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS generation FROM documents")
def r5(spark, sf_dir):
    owners = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner"))
    index = owners.withColumn("generation", F.lit("old"))
    changed = owners.where("owner % 5 = 0").withColumn("generation", F.lit("new"))
    return ingest.replaced(index, changed, "owner")


_TREES = """[['/a'], ['/a/b'], ['/a/c', '/e'], ['/a/b/d'], ['/a/b/d', '/a/f'], ['/e'], ['/e/g/h', '/a/b']]"""


@query(
    "A1_fold_fallback",
    f"""WITH RECURSIVE t AS (SELECT event_id, user_id || ':' || event_type AS record, (event_id * 7919) % 1000003 AS seq, epoch_us(ts) AS observed, event_id % 5 <> 0 AS reporting,
      {_TREES}[event_id % 7 + 1] AS paths, event_id % 11 = 0 AS removed, CASE WHEN event_id % 13 = 0 THEN '{{}}' ELSE json_extract_string(props, '$.k') END AS value FROM events),
    w AS (SELECT *, coalesce(observed >= max(CASE WHEN reporting THEN observed END) OVER (PARTITION BY record ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh,
      row_number() OVER (PARTITION BY record ORDER BY seq) AS k,
      '{{' || CASE WHEN paths[1] = '/a' THEN '"a":' || value WHEN paths[1] = '/e' THEN '"e":' || value WHEN paths[1] = '/a/b' THEN '"a":{{"b":' || value || '}}' WHEN paths = ['/a/c', '/e'] THEN '"a":{{"c":' || value || '}},"e":' || value
        WHEN paths = ['/a/b/d'] THEN '"a":{{"b":{{"d":' || value || '}}}}' WHEN paths = ['/a/b/d', '/a/f'] THEN '"a":{{"b":{{"d":' || value || '}},"f":' || value || '}}' ELSE '"e":{{"g":{{"h":' || value || '}}}},"a":{{"b":' || value || '}}' END || '}}' AS patch FROM t),
    gone AS (SELECT *, '$' || replace(paths[1], '/', '.') AS p1, '$' || replace(paths[2], '/', '.') AS p2, CASE WHEN removed THEN '{{' || CASE paths[1] WHEN '/a' THEN '"a":null' WHEN '/e' THEN '"e":null' WHEN '/a/b' THEN '"a":{{"b":null}}' WHEN '/a/c' THEN '"a":{{"c":null}}' WHEN '/a/b/d' THEN '"a":{{"b":{{"d":null}}}}' ELSE '"e":{{"g":{{"h":null}}}}' END || '}}' END AS g1,
      CASE paths[2] WHEN '/e' THEN '{{"e":null}}' WHEN '/a/f' THEN '{{"a":{{"f":null}}}}' WHEN '/a/b' THEN '{{"a":{{"b":null}}}}' END AS g2 FROM w),
    state(record, k, doc) AS (
      SELECT DISTINCT record, 0::BIGINT, '{{}}'::JSON FROM t
      UNION ALL SELECT s.record, g.k, CASE WHEN removed AND NOT fresh THEN s.doc
        WHEN removed THEN CASE WHEN p2 IS NOT NULL AND json_exists(CASE WHEN json_exists(s.doc, p1) THEN json_merge_patch(s.doc, g1) ELSE s.doc END, p2)
          THEN json_merge_patch(CASE WHEN json_exists(s.doc, p1) THEN json_merge_patch(s.doc, g1) ELSE s.doc END, g2) WHEN json_exists(s.doc, p1) THEN json_merge_patch(s.doc, g1) ELSE s.doc END
        WHEN fresh THEN json_merge_patch(s.doc, patch) ELSE json_merge_patch(patch, s.doc) END
      FROM state s JOIN gone g ON g.record = s.record AND g.k = s.k + 1)
    SELECT record, replace(substr(n.fullkey, 2), '.', '/') AS path, n.value::VARCHAR AS value FROM (SELECT record, arg_max(doc, k) AS doc FROM state GROUP BY record) s, json_tree(s.doc) n
    WHERE n.fullkey <> '$' AND (n.type <> 'OBJECT' OR n.value::VARCHAR = '{{}}')""",
)
def a1_fold(spark, sf_dir):
    """Writes of one or two leaves whose paths are scalars in one write and objects in another; the SQL folds a record's writes one after another.

    Its order leaves writes of one seq open (seq repeats after 1,000,003 events); here they follow in the order of their events.
    """
    from orrery.plans.events import _writes

    paths = F.element_at(F.expr(f"array({_TREES[1:-1].replace('[', 'array(').replace(']', ')')})"), (F.col("event_id") % 7 + 1).cast("int"))
    value = F.when(F.col("event_id") % 13 == 0, "{}").otherwise(F.col("value"))
    one_by_one, block = F.shiftleft("seq", 40) + F.col("event_id"), 1 << 56
    timed = merge.with_fresh(_writes(spark, sf_dir).withColumn("value", value).withColumn("seq", one_by_one), block)
    return merge.merge_leaves(timed.withColumn("path", F.explode(paths)), block)


@query(
    "V23_cloud_hosts",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'aws_elb' WHEN 1 THEN 'azure_app_service' WHEN 2 THEN 'gcp_app_engine' END AS service,
    CASE WHEN c_custkey % 4 = 0 THEN 'eu-west-1' END AS region, c_custkey % 4 IN (0, 2) AS canonical FROM customer""",
)
def v23(spark, sf_dir):
    k = _text("c_custkey")
    host = _pick("c_custkey", "lb-x{}.eu-west-1.elb.amazonaws.com", "app{}.scm.azurewebsites.net", "project-x{}.appspot.com", "www{}.example.com")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.replace(host, F.lit("{}"), k).alias("host"))
    found = hosts.classify(rows.select("host").distinct())
    return rows.join(found, "host").select("c_custkey", "service", "region", F.coalesce("canonical", F.lit(False)).alias("canonical"))


@query("V21_service_names", "SELECT e.event_id, e.event_type IN ('view', 'click') AS known, e.event_type = 'view' AS secure_required FROM events e")
def v21(spark, sf_dir):

    names = spark.createDataFrame([("view", True), ("click", False)], "name string, secure_required boolean")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), F.lit(None).cast("boolean").alias("secure"))
    told = validation.unknown_services(rows, names)
    return told.select("event_id", (~F.col("reason").eqNullSafe("name: unknown service")).alias("known"), F.col("reason").eqNullSafe("secure: required").alias("secure_required"))


@query(
    "F6_query_compile",
    r"""WITH t AS (SELECT item_id, text, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\pL\pN\p{Co}]+')) AS w FROM benchmark),
    q AS (SELECT *, CASE WHEN strlen(text) > 2048 THEN 'too long' WHEN len(w) = 0 THEN 'no tokens' WHEN len(w) > 32 THEN 'too many tokens' END AS reason FROM t)
    SELECT item_id, CASE WHEN reason IS NULL THEN array_to_string(list_sort(w), ' ') END AS words, reason FROM q""",
)
def f6(spark, sf_dir):
    from orrery.operators import search

    told = table(spark, sf_dir, "benchmark").select("item_id", search.compiled(F.col("text")).alias("q"))
    return told.select("item_id", F.array_join(F.array_sort("q.tokens"), " ").alias("words"), "q.reason")


@query(
    "F10_F11_match_references",
    r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^\pL\pN]*[\pL\pN]+') AS l FROM documents),
    t AS (SELECT doc_id, unnest(l) AS seg, generate_subscripts(l, 1) AS i FROM s),
    p AS (SELECT doc_id, seg, sum(strlen(seg)) OVER w AS e, 1 + sum(length(seg) - length(replace(seg, chr(10), ''))) OVER w AS line FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id AS owner, (e - 3)::BIGINT AS byte_start, e::BIGINT AS byte_end, line::BIGINT AS line_start, line::BIGINT AS line_end FROM p WHERE regexp_extract(seg, '[\pL\pN]+$') = 'the'""",
)
def f10(spark, sf_dir):
    from orrery.operators import evidence, search

    return search.references(evidence.chunks(table(spark, sf_dir, "documents"), "doc_id", "text"), "the")



@query(
    "T7_T9_closed_tables",
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'api_key' WHEN 1 THEN 'private_key' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'arin' END AS rir, CASE s_suppkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'tech' END AS role,
    CASE WHEN s_suppkey % 3 = 0 THEN 'secret' || s_suppkey ELSE 'AKIA' END AS secret, 'src/app.py:' || s_suppkey AS location, CASE WHEN s_suppkey % 2 = 0 THEN 'a.example:m' ELSE 'm' END AS matcher FROM supplier""",
)
def t7(spark, sf_dir):
    k = _text("s_suppkey")
    detector = _pick("s_suppkey", "AWS", "PrivateKey", "Other")
    go = lambda v, n: transforms.apply_chain(v, [n])
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        go(detector, "trufflehog_secret_kind").alias("kind"),
        go(_pick("s_suppkey", "whois.ARIN.net.", "whois.example"), "rir_from_whois_server").alias("rir"),
        go(_pick("s_suppkey", "administrative", "technical", "sponsor"), "rdap_registration_role").alias("role"),
        transforms.trufflehog_secret_part(detector, F.lit("AKIA"), F.concat(F.lit("AKIA:secret"), k)).alias("secret"),
        transforms.located(F.lit("src/app.py"), F.col("s_suppkey")).alias("location"),
        transforms.sni_matcher(F.lit("m"), _pick("s_suppkey", "A.example.", "192.0.2.1")).alias("matcher"),
    )


@query(
    "T8_T13_lifted_values",
    """SELECT p_partkey, 'nuclei:t-' || p_partkey AS template, 'trufflehog:aws' AS detector, 'leakcheck:big-breach-' || p_partkey AS breach, 'user' || p_partkey || '@example.com' AS email,
    '2024-01-02T01:04:05.5Z' AS go_time, CASE WHEN p_partkey % 2 = 0 THEN 'SHA256:abc' END AS fingerprint, 400 + p_partkey % 50 AS status, CASE WHEN p_partkey % 2 = 0 THEN '9.8' END AS score FROM part""",
)
def t8(spark, sf_dir):
    k = _text("p_partkey")
    go = lambda v, n: transforms.apply_chain(v, [n])
    metrics = F.array(F.struct(F.lit("Secondary").alias("type"), F.lit(7.1).alias("score"), F.lit("v1").alias("vector")), F.struct(F.lit("Primary").alias("type"), F.lit(9.8).alias("score"), F.lit("v2").alias("vector")))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        go(F.concat(F.lit("template: [t-"), k, F.lit("] name: [x]")), "bbot_nuclei_template").alias("template"),
        go(F.lit("TruffleHog - AWS"), "bbot_trufflehog_detector").alias("detector"),
        go(F.concat(F.lit("Big Breach! "), k), "leakcheck_breach_token").alias("breach"),
        go(F.concat(F.lit("Name <User"), k, F.lit("@Example.com>")), "pypi_email_address").alias("email"),
        go(F.lit("2024-01-02 03:04:05.500000000 +0200 CEST m=+1"), "go_time_string_utc").alias("go_time"),
        go(_pick("p_partkey", "2048 SHA256:abc x", "SHA256:a SHA256:b"), "nmap_ssh_hostkey_sha256").alias("fingerprint"),
        transforms.status_tag(F.array(F.lit("in-scope"), F.concat(F.lit("status-"), (F.col("p_partkey") % 50 + 400).cast("string")))).cast("long").alias("status"),
        transforms.preferred_cvss(_pick("p_partkey", "9.8", "7.1"), metrics).alias("score"),
    )


@query(
    "V17_J12_ipv6_and_networks",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 6 ELSE 0 END AS version, 6 AS network, c_custkey % 3 = 0 AS inside, true AS subnet, c_custkey % 2 = 0 AS idna FROM customer""",
)
def v17b(spark, sf_dir):
    from orrery.functions import addresses

    k = F.col("c_custkey") + 1
    groups = [F.lower(F.hex(F.shiftright(k, bits) % 65536)) for bits in (32, 16, 0)]  # a group of an address has 16 bits
    tail = F.when(k < 1 << 16, groups[2]).when(k < 1 << 32, F.concat_ws(":", *groups[1:])).otherwise(F.concat_ws(":", *groups))
    ip = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("2001:db8::"), tail)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("2001:DB8::"), tail)).otherwise(F.concat(F.lit("2001:db8:0::"), tail))
    net = F.lit("2001:db8::/32")
    rows = table(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip"), net.alias("net"), F.lit("2001:db8:1::/48").alias("inner"), _pick("c_custkey", "xn--mnchen-3ya", "xn--a").alias("label"))
    return rows.select("c_custkey", addresses.ip_version("ip").alias("version"), addresses.cidr_version("net").alias("network"), addresses.contains_ip("net", "ip").alias("inside"), addresses.proper_subnet("net", "inner").alias("subnet"), addresses.idna_round_trip("label").alias("idna"))


@query(
    "T10_registration_contacts",
    """WITH a AS (SELECT c_custkey AS owner, c_name, '+1' || lpad(c_custkey::VARCHAR, 4, '0') || '555' AS phone, c_custkey % 2 = 0 AS org FROM customer)
    SELECT owner, 0 AS position, NULL AS rdap_registrar_name, CASE WHEN org THEN c_name END AS rdap_holder_name, CASE WHEN org THEN 'H' || owner END AS rdap_holder_handle,
    'c' || owner || '@example.com' AS rdap_registration_contact_email, NULL AS rdap_abuse_email, NULL AS rdap_abuse_phone FROM a
    UNION ALL SELECT owner, 1, 'Registrar ' || owner, NULL, NULL, NULL, NULL, NULL FROM a
    UNION ALL SELECT owner, 2, NULL, NULL, NULL, NULL, 'abuse@example.com', phone FROM a""",
)
def t10(spark, sf_dir):
    card = '["vcard",[["version",{},"text","4.0"],["kind",{},"text","%s"],["fn",{},"text","%s"],["email",{},"text","%s"],["tel",{},"uri","%s"]]]'
    layout = '{"entities":[{"handle":"H%s","roles":["registrant"],"vcardArray":' + card + '},{"handle":"R","roles":["registrar"],"vcardArray":' + card + ',"entities":[{"roles":["abuse"],"vcardArray":' + card + "}]}]}"
    k = _text("c_custkey")
    kind = F.when(F.col("c_custkey") % 2 == 0, "org").otherwise("individual")
    parts = [k, kind, F.col("c_name"), F.concat(F.lit("c"), k, F.lit("@example.com")), F.lit("")]
    parts += [F.lit("org"), F.concat(F.lit("Registrar "), k), F.lit(""), F.lit("555")]
    parts += [F.lit("group"), F.lit("Desk"), F.lit("abuse@example.com"), F.concat(F.lit("tel:+1 ("), F.lpad(k, 4, "0"), F.lit(") 555;ext=1"))]
    return registration.contacts(table(spark, sf_dir, "customer").select("c_custkey", F.format_string(layout, *parts).alias("answer")), "c_custkey", "answer")


@query(
    "T3_T5_T14_registration_records",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS registered, NULL AS expires, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS autnum,
    CASE o_orderkey % 3 WHEN 0 THEN '10.' || (o_orderkey % 256) || '.0.0/16' WHEN 1 THEN '10.0.' || (o_orderkey % 256) || '.7/32' END AS network,
    o_orderkey % 3 = 0 AS accepted, o_orderkey % 3 <> 2 AS whois FROM orders""",
)
def t3b(spark, sf_dir):
    r, n = F.col("o_orderkey") % 3, (F.col("o_orderkey") % 256).cast("string")
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    handle = F.when(r == 2, "no id").otherwise(F.concat(_text("o_orderkey"), F.lit("_DOMAIN-EX")))
    layout = '{"handle":"%s","ldhName":"example.com","redacted":[{"prePath":"%s"}],"events":[{"eventAction":"registration","eventDate":"%s"},{"eventAction":"transfer","eventDate":"%s"}]}'
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        date.alias("date"),
        handle.alias("handle"),
        F.format_string(layout, handle, F.when(r == 1, "$.handle").otherwise("$.entities"), date, date).alias("answer"),
        F.col("o_custkey").alias("first"),
        F.when(r == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("last"),
        F.when(r == 0, F.concat(F.lit("10."), n, F.lit(".0.0"))).when(r == 1, F.concat(F.lit("10.0."), n, F.lit(".7"))).otherwise("10.0.0.1").alias("low"),
        F.when(r == 0, F.concat(F.lit("10."), n, F.lit(".255.255"))).when(r == 1, F.concat(F.lit("10.0."), n, F.lit(".7"))).otherwise("10.0.0.4").alias("high"),
    )
    return rows.select(
        "o_orderkey",
        registration.event_date("rdap_event_registration", F.col("date"), F.col("answer")).alias("registered"),
        registration.event_date("rdap_event_expiration", F.col("date"), F.col("answer")).alias("expires"),
        transforms.single_autnum(F.col("first"), F.col("last")).alias("autnum"),
        addresses.spanned_network("low", "high").alias("network"),
        registration.rdap_registration_accepted(F.col("answer"), F.lit("domain")).alias("accepted"),
        registration.whois_registration_accepted(F.col("handle"), F.lit("example.com"), F.lit("domain")).alias("whois"),
    )


@query(
    "T11_caa_records",
    """WITH a AS (SELECT s_suppkey, s_suppkey % 4 AS r FROM supplier)
    SELECT s_suppkey, CASE WHEN r = 0 THEN s_suppkey % 256 END AS flags, CASE WHEN r = 1 THEN s_suppkey % 256 END AS wild_flags, CASE WHEN r < 2 THEN 'ca' || s_suppkey || '.example' END AS issuer,
    CASE WHEN r = 0 THEN 'validationmethods=dns-01|account=' || s_suppkey END AS parameters, CASE WHEN r = 1 THEN '' END AS wild_parameters,
    CASE WHEN r = 2 THEN 'sec' || s_suppkey || '@example.com' END AS email, CASE WHEN r = 3 THEN 'https://Example.com/r' || s_suppkey END AS url FROM a""",
)
def t11b(spark, sf_dir):
    k, flags = _text("s_suppkey"), (F.col("s_suppkey") % 256).cast("string")
    told = _pick("s_suppkey", 'issue "CA{}.example; ValidationMethods=dns-01; account = {}"', 'issuewild "ca{}.example"', 'iodef "mailto:Sec{}@Example.com"', 'iodef "https://Example.com/r{}"')
    record = F.concat(F.lit("example. 300 IN CAA "), flags, F.lit(" "), F.replace(told, F.lit("{}"), k))
    go = lambda n: transforms.apply_chain(F.col("record"), [n])
    flat = lambda v: F.array_join(F.transform(v, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "|")
    return table(spark, sf_dir, "supplier").select("s_suppkey", record.alias("record")).select(
        "s_suppkey",
        go("rr_caa_issue_flags").alias("flags"),
        go("rr_caa_issuewild_flags").alias("wild_flags"),
        go("rr_caa_issuer").alias("issuer"),
        flat(go("rr_caa_issue_parameters")).alias("parameters"),
        flat(go("rr_caa_issuewild_parameters")).alias("wild_parameters"),
        go("rr_caa_iodef_email").alias("email"),
        go("rr_caa_iodef_url").alias("url"),
    )


@query(
    "T9_T13_advisory_scores",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '9.8' END AS nvd, CASE WHEN p_partkey % 3 < 2 THEN 'V3-' || p_partkey END AS nvd_vector, CASE WHEN p_partkey % 3 = 1 THEN '9.8' END AS github,
    CASE WHEN p_partkey % 2 = 0 THEN 'secret' || p_partkey ELSE 'raw' || p_partkey END AS secret, 'src/a.py:' || p_partkey AS git, 'src/a.py:' || (p_partkey + 1) AS leak,
    CASE WHEN p_partkey % 2 = 0 THEN true END AS zone, CASE WHEN p_partkey % 3 = 1 THEN 'lb-' || p_partkey || '.eu-west-1.elb.amazonaws.com' END AS cloud, CASE WHEN p_partkey % 3 = 1 THEN 'eu-west-1' END AS region FROM part""",
)
def t9b(spark, sf_dir):
    k, r = _text("p_partkey"), F.col("p_partkey") % 3
    # an older metric that the answer's own publisher calls primary goes before a newer one that another calls secondary
    answer = F.format_string(
        '{"vulnerabilities":[{"cve":{"metrics":{"cvssMetricV40":[{"type":"Secondary","cvssData":{"baseScore":5.0,"vectorString":"V4"}}],"cvssMetricV31":[{"type":"%s","cvssData":{"baseScore":%s,"vectorString":"V3-%s"}}]}}}%s]}',
        F.lit("Primary"), F.when(r == 0, "9.8").otherwise("7.5"), k, F.when(r == 2, ',{"cve":{}}').otherwise(""),
    )
    advisory = F.format_string('{"cvss_severities":{"cvss_v4":{"score":%s,"vector_string":%s},"cvss_v3":{"score":9.8,"vector_string":"W3"}}}', F.when(r == 1, "0.0").otherwise("3.0"), F.when(r == 1, "null").otherwise('"W4"'))
    even = F.col("p_partkey") % 2 == 0
    told = F.format_string("Verified secret. Detector Type: [%s] Raw result: [%s] RawV2 result: [%s] Other: [x]", F.when(even, "AWS").otherwise("Other"), F.when(even, F.lit("AKIA")).otherwise(F.concat(F.lit("raw"), k)), F.concat(F.lit("AKIA:secret"), k))
    file, host = F.lit("src/a.py"), F.when(r == 1, F.format_string("LB-%s.eu-west-1.elb.amazonaws.com.", k)).otherwise(F.format_string("www%s.example.com", k))
    go = lambda v, n: transforms.apply_chain(v, [n])
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        transforms.nvd_preferred_cvss(F.lit("9.8"), answer).alias("nvd"),
        transforms.nvd_preferred_cvss(F.concat(F.lit("V3-"), k), answer).alias("nvd_vector"),
        transforms.github_preferred_cvss(F.lit("9.8"), advisory).alias("github"),
        go(told, "bbot_trufflehog_secret_part").alias("secret"),
        transforms.trufflehog_git_location(file, F.format_string('{"SourceMetadata":{"Data":{"Git":{"line":%s}}}}', k)).alias("git"),
        transforms.gitleaks_location(file, F.format_string('{"StartLine":%s}', (F.col("p_partkey") + 1).cast("string"))).alias("leak"),
        transforms.wildcard_zone(F.lit("_wildcard.example.com"), F.when(even, F.array(F.lit("wildcard"))).otherwise(F.array(F.lit("x")))).alias("zone"),
        go(host, "if_cloud_hostname").alias("cloud"),
        go(host, "cloud_region").alias("region"),
    )
