"""Queries on pages: endpoints, names, parameters, their identities and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import dns, grammar, identity, transforms
from orrery.operators import catalog, inventory, traverse, validation
from orrery.plans.book import query, table

# The endpoint records of pages, in SQL.
_EP = r"""
full_url AS (SELECT page_id, regexp_replace(url, '#.*', '') AS f FROM pages),
ep AS (
  SELECT page_id, page_id::BIGINT AS seen, split_part(f, '?', 1) AS url,
         regexp_extract(f, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(f, '\?([^#]+)$', 1) AS query,
         sha256(to_json({'method': 'GET', 'url': split_part(f, '?', 1)})) AS key
  FROM full_url WHERE regexp_full_match(f, 'https?://[a-z0-9.-]+/[A-Za-z0-9._~!$&''()*+,;=:@/%-]*(\?[A-Za-z0-9._~!$&''()*+,;=:@/?%-]+)?')
),
ended AS (SELECT *, sha256('endpoint:' || key) AS node_id FROM ep),
param AS (
  SELECT DISTINCT node_id AS parent, split_part(pair, '=', 1) AS name
  FROM (SELECT node_id, unnest(string_split(query, '&')) AS pair FROM ended WHERE query <> '') WHERE split_part(pair, '=', 1) <> ''
),
pkey AS (SELECT *, sha256(to_json({'location': 'query', 'name': name, 'parent': parent})) AS key FROM param),
pnode AS (SELECT *, sha256('parameter:' || key) AS node_id FROM pkey),
host AS (SELECT DISTINCT host AS name, string_split(host, '.') AS l FROM ended),
kind AS (
  SELECT name, CASE WHEN len(l) = 2 THEN 'domain' WHEN len(l) > 2 THEN 'subdomain' END AS kind,
         CASE WHEN len(l) >= 2 THEN l[-2] || '.' || l[-1] END AS registrable FROM host
),
hnode AS (SELECT DISTINCT name, kind FROM (SELECT name, kind FROM kind WHERE kind IS NOT NULL UNION ALL SELECT registrable, 'domain' FROM kind WHERE kind = 'subdomain')),
hkey AS (SELECT *, sha256(to_json({'value': name})) AS key FROM hnode),
nodes AS (
  SELECT DISTINCT node_id, 'endpoint' AS type, key FROM ended
  UNION SELECT node_id, 'parameter', key FROM pnode
  UNION SELECT sha256(kind || ':' || key), kind, key FROM hkey
),
rels AS (
  SELECT 'has_parameter' AS type, parent AS source_id, 'endpoint' AS source_type, node_id AS target_id, 'parameter' AS target_type FROM pnode
  UNION ALL SELECT 'has_subdomain', sha256('domain:' || sha256(to_json({'value': registrable}))), 'domain',
                   sha256('subdomain:' || sha256(to_json({'value': name}))), 'subdomain' FROM kind WHERE kind = 'subdomain'
)
"""


def _rules(spark):
    return dns.sample_rules(spark)


@query("V3_endpoint_url_drop_query", f"WITH {_EP} SELECT page_id, url FROM ep")
def v3(spark, sf_dir):
    return inventory.endpoints(table(spark, sf_dir, "pages")).select("page_id", "url")


@query(
    "V19_http_url",
    r"""SELECT page_id, regexp_full_match(url, 'https?://[a-z0-9.-]+/[A-Za-z0-9._~!$&''()*+,;=:@/%-]*(\?[A-Za-z0-9._~!$&''()*+,;=:@/?%-]+)?') AS valid,
        CASE WHEN contains(url, '#') THEN '' ELSE regexp_extract(url, '^(https?)://', 1) END AS scheme,
        CASE WHEN contains(url, '#') THEN '' ELSE regexp_extract(url, '^https?://([^/:?#]+)', 1) END AS host,
        CASE WHEN contains(url, '#') THEN '' ELSE regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) END AS path FROM pages""",
)
def v19(spark, sf_dir):
    p = grammar.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", grammar.is_http_url(F.col("url")).alias("valid"), p["scheme"].alias("scheme"), p["host"].alias("host"), p["path"].alias("path"))


@query(
    "T2_url_transforms",
    r"""SELECT page_id, split_part(url, '?', 1) AS url_without_query, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS url_host,
        CASE WHEN regexp_full_match(url, '[a-z]+://[^/]+') THEN url || '/' ELSE url END AS url_with_path,
        nullif(lower(regexp_replace(split_part(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/', 2), '\.git$', '')), '') AS repo_url_name FROM pages""",
)
def t2(spark, sf_dir):
    names = ("url_without_query", "url_host", "url_with_path", "repo_url_name")
    return table(spark, sf_dir, "pages").select("page_id", *[transforms.apply_chain(F.col("url"), [n]).alias(n) for n in names])


@query("D1_classify_dns_name", f"WITH {_EP} SELECT name, registrable, kind FROM kind")
def d1(spark, sf_dir):
    found = inventory.endpoints(table(spark, sf_dir, "pages"))
    return dns.classify(found.select(F.col("host").alias("name")), _rules(spark))


@query("D2_registrable_domain", f"WITH {_EP} SELECT page_id, registrable FROM ep JOIN kind ON host = name")
def d2(spark, sf_dir):
    found = inventory.endpoints(table(spark, sf_dir, "pages"))
    return found.join(dns.classify(found.select(F.col("host").alias("name")), _rules(spark)), F.col("host") == F.col("name")).select("page_id", "registrable")


@query("V18_dns_name", f"WITH {_EP} SELECT host, count(*) AS n, bool_and(regexp_full_match(host, '([a-z0-9]([a-z0-9-]*[a-z0-9])?\\.)*[a-z0-9]([a-z0-9-]*[a-z0-9])?')) AS valid FROM ep GROUP BY host")
def v18(spark, sf_dir):
    found = inventory.endpoints(table(spark, sf_dir, "pages"))
    return found.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.bool_and(grammar.is_hostname(F.col("host"))).alias("valid"))


@query("I1_identity_key", f"WITH {_EP} SELECT page_id, key, node_id FROM ended")
def i1(spark, sf_dir):
    return inventory.endpoints(table(spark, sf_dir, "pages")).select("page_id", "key", "node_id")


@query(
    "I2_unordered_identity",
    """SELECT page_id, sha256(to_json(list_sort(string_split(regexp_extract(url, '\\?([^#]+)', 1), '&')))) AS member FROM pages""",
)
def i2(spark, sf_dir):
    pairs = F.split(F.regexp_extract("url", r"\?([^#]+)", 1), "&")
    return table(spark, sf_dir, "pages").select("page_id", identity.unordered(pairs).alias("member"))


@query("I3_scoped_identity", f"WITH {_EP} SELECT parent, name, key, node_id FROM pnode")
def i3(spark, sf_dir):
    return inventory.parameters(inventory.endpoints(table(spark, sf_dir, "pages"))).select("parent", "name", "key", "node_id")


@query("I4_relation_identity", f"WITH {_EP} SELECT type, source_id, target_id, sha256(concat_ws('|', source_id, type, target_id, '')) AS rel_id FROM rels")
def i4(spark, sf_dir):
    return inventory.relations(table(spark, sf_dir, "pages"), _rules(spark)).select("type", "source_id", "target_id", "rel_id")


@query("A3_first_last_seen", f"WITH {_EP} SELECT node_id, key, min(seen) AS first_seen, max(seen) AS last_seen, count(*) AS n FROM ended GROUP BY ALL")
def a3(spark, sf_dir):
    return inventory.seen_span(inventory.endpoints(table(spark, sf_dir, "pages")))


@query("A7_ready_counts", f"WITH {_EP} SELECT type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT type, count(*) FROM rels GROUP BY type")
def a7(spark, sf_dir):
    pages, rules = table(spark, sf_dir, "pages"), _rules(spark)
    return inventory.counts(inventory.nodes(pages, rules)).unionByName(inventory.counts(inventory.relations(pages, rules)))


@query("V24_endpoint_types", f"WITH {_EP} SELECT type, source_type, target_type, count(*) AS n, 0::BIGINT AS refused FROM rels GROUP BY ALL")
def v24(spark, sf_dir):
    rows = validation.end_reasons(inventory.relations(table(spark, sf_dir, "pages"), _rules(spark)))
    return rows.groupBy("type", "source_type", "target_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNotNull()).alias("refused"))


@query("V25_subdomain_suffix", f"WITH {_EP} SELECT name, registrable, ends_with(name, '.' || registrable) AS fits FROM kind WHERE kind = 'subdomain'")
def v25(spark, sf_dir):
    kinds = dns.classify(inventory.endpoints(table(spark, sf_dir, "pages")).select(F.col("host").alias("name")), _rules(spark)).where("kind = 'subdomain'")
    return kinds.select("name", "registrable", F.col("name").endswith(F.concat(F.lit("."), F.col("registrable"))).alias("fits"))


@query("J4_single_parent", f"WITH {_EP} SELECT target_id, 'links' AS type, count(DISTINCT source_id) AS parents FROM (SELECT url AS target_id, page_id AS source_id FROM ep) GROUP BY target_id HAVING count(DISTINCT source_id) > 1")
def j4(spark, sf_dir):
    found = inventory.endpoints(table(spark, sf_dir, "pages"))
    return validation.single_parent(found.select(F.col("url").alias("target_id"), F.lit("links").alias("type"), F.col("page_id").alias("source_id")))


@query("J5_repeated_identity", f"WITH {_EP} SELECT page_id % 7 AS batch_id, 'endpoint' AS type, key, count(*) AS n FROM ep GROUP BY ALL HAVING count(*) > 1")
def j5(spark, sf_dir):
    found = inventory.endpoints(table(spark, sf_dir, "pages"))
    return validation.repeated_identities(found.select((F.col("page_id") % 7).alias("batch_id"), F.lit("endpoint").alias("type"), "key"))


@query("A14_identity_collisions", f"WITH {_EP} SELECT host AS batch_id, 'parameter' AS type, name AS key, count(*) AS n FROM (SELECT DISTINCT e.host, p.parent, p.name FROM pnode p JOIN ended e ON p.parent = e.node_id) GROUP BY ALL HAVING count(*) > 1")
def a14(spark, sf_dir):
    found = inventory.endpoints(table(spark, sf_dir, "pages"))
    named = inventory.parameters(found).join(found.select(F.col("node_id").alias("parent"), "host").distinct(), "parent")
    return validation.repeated_identities(named.select(F.col("host").alias("batch_id"), F.lit("parameter").alias("type"), F.col("name").alias("key")))


@query(
    "V5_record_validation",
    f"WITH {_EP}, r AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 'get' ELSE 'GET' END AS method, 100 + page_id % 600 AS status FROM ep) "
    "SELECT page_id, CASE WHEN method IS NULL THEN 'method: required' WHEN method = 'get' THEN 'method: method' WHEN status > 599 THEN 'status: http_status' END AS reason FROM r",
)
def v5(spark, sf_dir):
    found = inventory.endpoints(table(spark, sf_dir, "pages"))
    method = F.when(F.col("page_id") % 5 == 0, F.lit(None)).when(F.col("page_id") % 5 == 1, "get").otherwise("GET")
    rows = found.select("page_id", "url", method.alias("method"), (100 + F.col("page_id") % 600).alias("status"))
    return rows.select("page_id", validation.node_reason("endpoint", {c: F.col(c) for c in ("url", "method", "status")}).alias("reason"))


@query("V6_enum_rules", "SELECT page_id, list_contains(['query', 'body', 'header', 'cookie', 'path'], string_split(url, '/')[-1]) AS location FROM pages")
def v6(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", grammar.valid(catalog.NODES["parameter"].required["location"], F.substring_index("url", "/", -1)).alias("location"))


@query(
    "V11_pattern_formats",
    r"""WITH w AS (SELECT DISTINCT unnest(string_split(url, '/')) AS v FROM pages UNION SELECT unnest(['CWE-79', 'US', '+14155550100', '_dmarc', 'text/html', 'a@b', '0', 'ff00']))
    SELECT v, regexp_full_match(v, 'CWE-[0-9]{1,6}') AS cwe, regexp_full_match(v, '[A-Z]{2}') AS iso3166_alpha2, regexp_full_match(v, '\+[1-9][0-9]{1,14}') AS phone_e164,
      regexp_full_match(v, '0|[1-9a-f][0-9a-f]{0,39}') AS hex_serial, regexp_full_match(v, '[a-z][a-z0-9-]{0,31}') AS html_token, regexp_full_match(v, '[0-9a-f]{64}') AS sha256,
      regexp_full_match(v, '_[a-z0-9]([a-z0-9-]{0,60}[a-z0-9])?') AS srv_label, regexp_full_match(v, '[a-z0-9]([a-z0-9._+-]{0,61}[a-z0-9])?') AS tech_token,
      regexp_full_match(v, '[A-Z][A-Z0-9!#$%&''*+.^_`|~-]{0,31}') AS method FROM w""",
)
def v11(spark, sf_dir):
    words = table(spark, sf_dir, "pages").select(F.explode(F.split("url", "/")).alias("v"))
    more = spark.createDataFrame([(x,) for x in ("CWE-79", "US", "+14155550100", "_dmarc", "text/html", "a@b", "0", "ff00")], "v string")
    names = ("cwe", "iso3166_alpha2", "phone_e164", "hex_serial", "html_token", "sha256", "srv_label", "tech_token", "method")
    return words.union(more).distinct().select("v", *[grammar.valid(n, F.col("v")).alias(n) for n in names])


@query(
    "S6_write_partitioned",
    f"WITH {_EP} SELECT type, count(*) AS n, min(key) AS least FROM nodes GROUP BY type",
)
def s6(spark, sf_dir):
    from orrery.sources import readers, storage

    path = storage.fresh(spark, "nodes")
    readers.write_table(inventory.nodes(table(spark, sf_dir, "pages"), _rules(spark)), path)
    return spark.read.parquet(path).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))


@query("S8_record_export", f"WITH {_EP} SELECT node_id, to_json({{'key': key, 'type': type}}) AS record FROM nodes")
def s8(spark, sf_dir):
    from orrery.sources import readers

    return readers.exported(inventory.nodes(table(spark, sf_dir, "pages"), _rules(spark)), ["type", "key"])


@query(
    "N12_alias_hop",
    f"WITH {_EP} SELECT DISTINCT r2.source_id AS node_id FROM rels r1 JOIN rels r2 ON r1.target_id = r2.target_id WHERE r1.type = 'has_parameter' AND r2.type = 'has_parameter'",
)
def n12(spark, sf_dir):
    rels = inventory.relations(table(spark, sf_dir, "pages"), _rules(spark))
    seeds = rels.where("type = 'has_parameter'").select(F.col("source_id").alias("node_id")).distinct()
    return traverse.alias_hop(rels, seeds, "has_parameter", "has_parameter")


@query(
    "W9_batch_get",
    f"WITH {_EP}, ids AS (SELECT page_id AS place, CASE WHEN page_id % 3 = 0 THEN 'missing' ELSE key END AS key FROM ep) "
    "SELECT place, ids.key, type IS NULL AS missing FROM ids LEFT JOIN (SELECT key, any_value(type) AS type FROM nodes GROUP BY key) n ON ids.key = n.key",
)
def w9(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    asked = inventory.endpoints(pages).select(F.col("page_id").alias("place"), F.when(F.col("page_id") % 3 == 0, "missing").otherwise(F.col("key")).alias("key"))
    known = inventory.nodes(pages, _rules(spark)).groupBy("key").agg(F.first("type").alias("type"))
    return asked.join(known, "key", "left").select("place", "key", F.col("type").isNull().alias("missing"))


@query(
    "T12_T14_name_gates",
    f"""WITH {_EP} SELECT name, CASE WHEN kind = 'domain' THEN name END AS if_domain, CASE WHEN kind = 'subdomain' THEN name END AS if_subdomain,
    CASE WHEN kind = 'domain' THEN substr(name, instr(name, '.') + 1) END AS suffix, coalesce(kind = 'domain', false) AS host_is_domain, coalesce(kind = 'subdomain', false) AS host_is_subdomain FROM kind""",
)
def t12(spark, sf_dir):
    found = inventory.endpoints(table(spark, sf_dir, "pages")).select(F.concat(F.upper("host"), F.lit(".")).alias("written")).distinct()
    kinds = dns.with_kinds(found, F.col("written"), _rules(spark))
    name, kind = F.col("written"), F.col("kind")
    return kinds.select(
        dns.spelled(name).alias("name"),
        transforms.of_kind(name, kind, "domain").alias("if_domain"),
        transforms.of_kind(name, kind, "subdomain").alias("if_subdomain"),
        transforms.public_suffix_of(name, kind).alias("suffix"),
        *[transforms.CONDITIONS[n](kind).alias(n) for n in ("host_is_domain", "host_is_subdomain")],
    )
