"""Queries on events as a stream of observations: identity (user, event type), properties from props and value.

Event time rises with the id, so the order of arrival is a permutation of it.  It repeats after 1,000,003 events: the SQL leaves the order of writes of one seq
open (and DuckDB gives another at each run), here they follow in the order of their events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import jsonwalk, transforms
from orrery.operators import checks, mapping, merge, properties, propertyindex, upsert, validation
from orrery.plans.book import query, table
from orrery.sources import readers, storage, versions
from orrery.streaming import ingest

_W = """
w AS (
  SELECT event_id, user_id || ':' || event_type AS record, (event_id * 7919) % 1000003 AS seq, epoch_us(ts) AS observed,
         'p' || (event_id % 3) AS path, event_id % 11 = 0 AS removed, json_extract_string(props, '$.k') AS value, event_id % 5 <> 0 AS reporting
  FROM events
),
fr AS (
  SELECT *, coalesce(observed >= max(observed) FILTER (WHERE reporting) OVER (PARTITION BY record ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM w
)
"""


def _writes(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat_ws(":", "user_id", "event_type").alias("record"),
        ((F.col("event_id") * 7919) % 1000003).alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("observed"),
        F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("path"),
        (F.col("event_id") % 11 == 0).alias("removed"),
        F.get_json_object("props", "$.k").alias("value"),
        (F.col("event_id") % 5 != 0).alias("reporting"),
    )


def _variant() -> Column:
    return F.parse_json("props")


@query("W2_fresh_flag", f"WITH {_W} SELECT event_id, record, fresh FROM fr")
def w2(spark, sf_dir):
    return merge.with_fresh(_writes(spark, sf_dir), ties=("event_id",)).select("event_id", "record", "fresh")


_A1 = f"""WITH {_W},
e AS (SELECT record, path, max(seq) FILTER (WHERE fresh) AS last FROM fr GROUP BY ALL),
m AS (
  SELECT fr.record, fr.path, any_value(last) AS last,
    max(seq) FILTER (WHERE fresh AND NOT removed) AS fresh_set, arg_max(value, seq) FILTER (WHERE fresh AND NOT removed) AS fresh_value,
    min(seq) FILTER (WHERE NOT fresh AND NOT removed AND seq > coalesce(last, -1)) AS stale_set,
    arg_min(value, seq) FILTER (WHERE NOT fresh AND NOT removed AND seq > coalesce(last, -1)) AS stale_value
  FROM fr JOIN e ON fr.record = e.record AND fr.path = e.path GROUP BY ALL
)
SELECT record, path, CASE WHEN coalesce(last = fresh_set, false) THEN fresh_value ELSE stale_value END AS value
FROM m WHERE coalesce(last = fresh_set, false) OR stale_set IS NOT NULL"""


@query("A1_observation_merge", _A1)
def a1(spark, sf_dir):
    return merge.merge_leaves(merge.with_fresh(_writes(spark, sf_dir), ties=("event_id",)))


@query(
    "A3_A5_spans",
    f"""WITH {_W} SELECT record, min(observed) FILTER (WHERE reporting) AS first_seen, max(observed) FILTER (WHERE reporting) AS last_seen,
    arg_min(path, seq) AS ownership, count(*) AS n_writes FROM w GROUP BY record""",
)
def a3(spark, sf_dir):
    return merge.spans(_writes(spark, sf_dir).withColumn("ownership", F.col("path")))


@query(
    "A4_last_write",
    f"""WITH {_W}, l AS (SELECT record, seq, CASE WHEN removed THEN NULL ELSE value END AS label, event_id % 4 <> 0 AS present FROM w)
    SELECT record, (arg_max({{'v': label}}, seq) FILTER (WHERE present)).v AS label FROM l GROUP BY record""",
)
def a4(spark, sf_dir):
    rows = _writes(spark, sf_dir).select("record", "seq", F.when(~F.col("removed"), F.col("value")).alias("label"), (F.col("event_id") % 4 != 0).alias("label_present"))
    return merge.last_written(rows, ["label"])


@query(
    "A6_acknowledge",
    f"WITH {_W} SELECT record, count(*) FILTER (WHERE seq < 500000) = 0 AS created, count(*) FILTER (WHERE seq >= 500000) AS n_writes FROM w GROUP BY record HAVING count(*) FILTER (WHERE seq >= 500000) > 0",
)
def a6(spark, sf_dir):
    rows = _writes(spark, sf_dir)
    return merge.acknowledge(rows.where("seq >= 500000"), rows.where("seq < 500000"))


@query("V27_future_skew", f"WITH {_W} SELECT event_id, observed > 1705276800000000 + 300000000 AS refused FROM w")
def v27(spark, sf_dir):
    return _writes(spark, sf_dir).select("event_id", validation.too_new(F.col("observed"), 1705276800000000).alias("refused"))


@query("V28_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, epoch_us(ts) AS micros FROM events")
def v28(spark, sf_dir):
    text = F.date_format(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return rows.withColumn("micros", F.unix_micros(F.try_to_timestamp("text")))


@query("V2_canonical_json", "SELECT event_id, to_json({'k': CAST(json_extract(props, '$.k') AS INT), 'type': event_type}) AS document FROM events")
def v2(spark, sf_dir):
    from orrery.functions.identity import canonical

    return table(spark, sf_dir, "events").select("event_id", canonical(type=F.col("event_type"), k=F.get_json_object("props", "$.k").cast("int")).alias("document"))


@query("V7_integer_ranges", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) BETWEEN 0 AND 255 AS uint8, CAST(value AS BIGINT) BETWEEN 100 AND 599 AS http_status FROM events")
def v7(spark, sf_dir):
    from orrery.functions.grammar import valid

    return table(spark, sf_dir, "events").select("event_id", valid("uint8", F.get_json_object("props", "$.k").cast("int")).alias("uint8"), valid("http_status", F.round("value").cast("bigint")).alias("http_status"))


@query(
    "V30_property_predicates",
    """WITH p AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
    SELECT event_id, k = 5 AS eq, k <> 5 AS ne, k IN (1, 2, 3) AS isin, true AS present, false AS missing, k > 50 AS gt, k <= 10 AS lte, false AS text_eq,
           (k > 90 OR k < 5) AS any_of, (k >= 10 AND k < 20) AS all_of FROM p""",
)
def v30(spark, sf_dir):
    d = _variant()
    leaf = lambda op, value=None, path="/k": properties.predicate(d, op, path, value)
    return table(spark, sf_dir, "events").select(
        "event_id",
        leaf("eq", 5).alias("eq"),
        leaf("ne", 5).alias("ne"),
        leaf("in", [1, 2, 3]).alias("isin"),
        leaf("exists").alias("present"),
        leaf("ne", 1, "/gone").alias("missing"),
        leaf("gt", 50).alias("gt"),
        leaf("lte", 10).alias("lte"),
        leaf("eq", "5").alias("text_eq"),
        properties.tree(d, {"any": [{"op": "gt", "path": "/k", "value": 90}, {"op": "lt", "path": "/k", "value": 5}]}).alias("any_of"),
        properties.tree(d, {"all": [{"op": "gte", "path": "/k", "value": 10}, {"op": "lt", "path": "/k", "value": 20}]}).alias("all_of"),
    )


_WIDE = """'{"k": ' || json_extract_string(props, '$.k') || ', "m": {"t": "' || event_type || '"' || CASE WHEN event_id % 50 = 0 THEN ', "long": "' || repeat('é', 600) || '"' ELSE '' END || '}, "v": [' || array_to_string(list_transform(range(CASE WHEN event_id % 20 = 0 THEN 600 ELSE 3 END), lambda x: ((x * 7 + event_id) % 1000)::VARCHAR), ', ') || ']}'"""
_FOUND = {
    "any": [
        {"all": [{"op": "gte", "path": "/k", "value": 40}, {"op": "eq", "path": "/m/t", "value": "view"}]},
        {"all": [{"op": "lt", "path": "/v/1", "value": 30}, {"op": "ne", "path": "/k", "value": 7.0}]},
        {"all": [{"op": "gt", "path": "/v/590", "value": 900}, {"op": "exists", "path": "/m/none", "value": False}]},
        {"op": "gt", "path": "/m/long", "value": "z"},
    ]
}


@query(
    "V30_index_search",
    f"""WITH d AS (SELECT event_id, ({_WIDE})::JSON AS d FROM events),
    v AS (SELECT event_id, (d->>'$.k')::INT AS k, d->>'$.m.t' AS t, (d->>'$.v[1]')::INT AS one, (d->>'$.v[590]')::INT AS far, d->>'$.m.long' AS long FROM d)
    SELECT event_id AS owner, coalesce((k >= 40 AND t = 'view') OR (one < 30 AND k <> 7), false) = false AND (coalesce(far > 900, false) OR coalesce(long > 'z', false) OR event_id % 20 = 0) AND event_id % 10 = 0 AND (event_id % 20 = 0 OR long IS NOT NULL) AS parsed
    FROM v WHERE coalesce((k >= 40 AND t = 'view'), false) OR coalesce(one < 30 AND k <> 7, false) OR coalesce(far > 900, false) OR coalesce(long > 'z', false)""",
)
def v30_index(spark, sf_dir):
    """Documents of up to 600 array items and strings beyond the index's length: only what the index cannot tell is parsed."""
    far = F.when(F.col("event_id") % 20 == 0, 600).otherwise(3)
    items = F.transform(F.sequence(F.lit(0), far - 1), lambda x: ((x * 7 + F.col("event_id")) % 1000).cast("string"))
    long = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit(', "long": "'), F.repeat(F.lit("é"), 600), F.lit('"'))).otherwise("")
    text = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "m": {"t": "'), "event_type", F.lit('"'), long, F.lit('}, "v": ['), F.array_join(items, ", "), F.lit("]}"))
    documents = table(spark, sf_dir, "events").select("event_id", text.alias("document"))
    rows, coverage = propertyindex.build(documents, "event_id", "document", ["/k"])
    return propertyindex.search(_FOUND, rows, coverage, documents, "event_id", "document")


@query("X1_json_pointer", "SELECT event_id, json_extract_string(props, '/k') AS k, json_extract_string(props, '/none') AS none FROM events")
def x1(spark, sf_dir):
    get = lambda p: F.try_variant_get(_variant(), properties.variant_path(p), "string")
    return table(spark, sf_dir, "events").select("event_id", get("/k").alias("k"), get("/none").alias("none"))


@query("X2_value_type", "SELECT event_id, 'number' AS k, NULL::VARCHAR AS none, 'object' AS whole FROM events")
def x2(spark, sf_dir):
    d = _variant()
    kind = lambda p: properties.category(F.try_variant_get(d, p, "variant"))
    return table(spark, sf_dir, "events").select("event_id", kind("$['k']").alias("k"), kind("$['none']").alias("none"), properties.category(d).alias("whole"))


@query("M1_X5_leaves", "SELECT event_id AS owner, '/k' AS path, 'number' AS kind, json_extract_string(props, '$.k') AS value FROM events")
def m1(spark, sf_dir):
    return jsonwalk.exploded(table(spark, sf_dir, "events"), "event_id", "props").select("owner", "path", "kind", "value")


@query("W1_index_budget", "SELECT event_id AS owner, '/k' AS path, true AS materialized, json_extract_string(props, '$.k') AS value FROM events")
def w1(spark, sf_dir):
    leaves = jsonwalk.exploded(table(spark, sf_dir, "events"), "event_id", "props")
    return properties.indexed(leaves, ["/k"]).select("owner", "path", "materialized", "value")


@query("A10_index_coverage", "SELECT event_id AS owner, 1::BIGINT AS total_paths, 1::BIGINT AS indexed_paths, 0::BIGINT AS omitted_values, true AS complete FROM events")
def a10(spark, sf_dir):
    leaves = jsonwalk.exploded(table(spark, sf_dir, "events"), "event_id", "props")
    return properties.coverage(leaves, properties.indexed(leaves, ["/k"]))


def _documents(spark, sf_dir):
    fields = F.struct(F.col("event_type").alias("type"), F.struct(F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("token"), F.round("value", 2).alias("score")).alias("auth"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(fields).alias("document"))


def _rules(spark):
    rows = [("type", "event.kind", "lower", False), ("auth.token", "non_storable", "plain", True), ("auth.*", "event.auth", "plain", False), ("auth.score", "event.score", "plain", False), ("gone", "event.gone", "plain", False)]
    return spark.createDataFrame(rows, "pattern string, sink string, chain string, redact boolean")


def _matched(spark, sf_dir):
    leaves = jsonwalk.exploded(_documents(spark, sf_dir), "event_id", "document").withColumn("field", mapping.field_path())
    return leaves, mapping.match(leaves, _rules(spark))


@query("M2_rule_match", "SELECT event_id AS owner, unnest(['type', 'auth.token', 'auth.score']) AS field, unnest(['event.kind', 'non_storable', 'event.score']) AS sink FROM events")
def m2(spark, sf_dir):
    return _matched(spark, sf_dir)[1].select("owner", "field", "sink")


@query("M3_M6_mapped_values", "SELECT DISTINCT event_id AS owner, 'event.kind' AS sink, lower(event_type) AS value FROM events UNION ALL SELECT event_id, 'non_storable', 'key-' || user_id FROM events UNION ALL SELECT event_id, 'event.score', round(value, 2)::VARCHAR FROM events WHERE value IS NOT NULL")
def m3(spark, sf_dir):
    return mapping.expected(mapping.mapped(_matched(spark, sf_dir)[1], {"lower": ["lower"], "plain": []}))


@query("M5_conditions", "SELECT event_id, event_type IN ('http', 'headless') AS http, event_type <> 'ssl' AS not_ssl FROM events")
def m5(spark, sf_dir):
    c = transforms.CONDITIONS
    return table(spark, sf_dir, "events").select("event_id", c["nuclei_http_result"](F.col("event_type")).alias("http"), c["nuclei_not_ssl_result"](F.col("event_type")).alias("not_ssl"))


@query("M7_redacted_artifact", "SELECT event_id AS owner, event_type AS type, '[REDACTED]' AS token, ['key-' || user_id] AS secrets FROM events")
def m7(spark, sf_dir):
    out = mapping.redacted(_documents(spark, sf_dir), "event_id", "document", ["auth.token"])
    return out.select("owner", F.get_json_object("document", "$.type").alias("type"), F.get_json_object("document", "$.auth.token").alias("token"), "secrets")


@query(
    "M5_gated_rules",
    """WITH r AS (SELECT * FROM (VALUES ('type', 'kind_http', 'nuclei_http_result', 'type'), ('type', 'kind_other', 'nuclei_not_ssl_result', 'type'), ('name', 'wild', 'bbot_not_wildcard_placeholder', 'name'), ('name', 'plain', NULL, NULL), ('name', 'lost', 'no_such', 'name')) x(field, sink, w, a)),
    d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'ssl' WHEN 2 THEN 'dns' END AS type, CASE WHEN event_id % 3 = 0 THEN '_wildcard.' ELSE '' END || event_type AS name FROM events)
    SELECT event_id AS owner, field, sink FROM d, r WHERE NOT (field = 'type' AND type IS NULL) AND (w IS NULL OR w = 'nuclei_http_result' AND type IN ('http', 'headless')
      OR w = 'nuclei_not_ssl_result' AND type IS DISTINCT FROM 'ssl' OR w = 'bbot_not_wildcard_placeholder' AND NOT starts_with(name, '_wildcard.'))""",
)
def m5_gated(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("http"), F.lit("ssl"), F.lit("dns"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    name = F.concat(F.when(F.col("event_id") % 3 == 0, "_wildcard.").otherwise(""), "event_type")
    told = table(spark, sf_dir, "events").select(F.col("event_id").alias("owner"), F.create_map(F.lit("type"), kind, F.lit("name"), name).alias("fields"))
    leaves = told.select("owner", F.explode("fields").alias("field", "value")).where("value is not null")
    rules = spark.createDataFrame(
        [("type", "kind_http", "nuclei_http_result", "type"), ("type", "kind_other", "nuclei_not_ssl_result", "type"), ("name", "wild", "bbot_not_wildcard_placeholder", "name"), ("name", "plain", None, None), ("name", "lost", "no_such", "name")],
        "pattern string, sink string, when string, asks string",
    )
    return mapping.gated(mapping.match(leaves, rules), told).select("owner", "field", "sink")


@query(
    "M8_leaks_anywhere",
    "WITH s AS (SELECT DISTINCT substr(text, 1, 40) AS secret FROM benchmark WHERE text <> '') SELECT secret, doc_id AS found_in FROM s JOIN documents ON contains(text, secret)",
)
def m8_anywhere(spark, sf_dir):
    """The beginnings of all benchmark texts, looked for in the bytes of every document."""
    secrets = table(spark, sf_dir, "benchmark").select(F.substring("text", 1, 40).alias("secret"))
    return mapping.leaks_anywhere(secrets, table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), "text").select("secret", "found_in")


@query("M8_redaction_leaks", "SELECT event_id AS owner, event_type AS secret FROM events WHERE false")
def m8(spark, sf_dir):
    return mapping.leaks(mapping.redacted(_documents(spark, sf_dir), "event_id", "document", ["auth.token"]))


@query("M9_unmapped_and_dead", "SELECT 'dead' AS side, 'gone' AS name, 0::BIGINT AS n UNION ALL SELECT 'dead', 'auth.*', 0")
def m9(spark, sf_dir):
    leaves, matched = _matched(spark, sf_dir)
    missing = mapping.unmapped(leaves, matched).select(F.lit("unmapped").alias("side"), F.col("field").alias("name"), "n")
    return missing.unionByName(mapping.dead_rules(_rules(spark), matched).select(F.lit("dead").alias("side"), F.col("pattern").alias("name"), F.lit(0).cast("bigint").alias("n")))


@query(
    "M10_U3_mapped_vs_written",
    "SELECT event_id AS owner, 'event.kind' AS sink, event_type AS value, 'mapped' AS side FROM events WHERE event_id % 10 = 0",
)
def m10(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    values = events.select(F.col("event_id").alias("owner"), F.lit("event.kind").alias("sink"), F.col("event_type").alias("value"))
    return mapping.difference(values, values.where("owner % 10 <> 0"))


@query("S1_read_json_lines", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s1(spark, sf_dir):
    path = storage.fresh(spark, "json")
    table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).write.json(path)
    read = readers.json_lines(spark, path)
    return read.select(F.variant_get("record", "$.event_id", "bigint").alias("event_id"), F.variant_get("record", "$.k", "bigint").alias("k"))


@query(
    "S5_J1_request_items",
    """WITH b AS (SELECT event_id // 10 AS batch_id, event_id, event_type, row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) - 1 AS item_index FROM events)
    SELECT batch_id, 'node' AS kind, item_index, event_type AS type, event_id AS observed_at FROM b""",
)
def s5(spark, sf_dir):
    in_order = F.sort_array(F.collect_list(F.struct("event_id", "event_type", F.col("event_id").cast("string").alias("id"))))
    batches = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 10).alias("batch_id")).agg(in_order.alias("events"))
    item = lambda e: F.struct(e["event_type"].alias("type"), F.struct(e["id"].alias("id")).alias("properties"), e["event_id"].alias("observed_at"))
    requests = batches.select("batch_id", F.to_json(F.struct(F.transform("events", item).alias("nodes"))).alias("request"))
    return readers.request_items(requests).select("batch_id", "kind", "item_index", "type", F.col("observed_at").cast("bigint").alias("observed_at"))


@query(
    "S5_V26_write_requests",
    """SELECT event_id AS batch_id, 'node' AS kind, 0 AS item_index, event_type AS type, user_id AS number, CASE event_id % 4 WHEN 1 THEN 'properties: reserved name' WHEN 2 THEN 'label: too long' WHEN 3 THEN 'ownership: null' END AS reason FROM events
    UNION ALL SELECT event_id, 'relation', 0, 'has', NULL, CASE event_id % 4 WHEN 1 THEN 'creation needs both endpoints' WHEN 2 THEN 'source_ref: one of id and node_index' WHEN 3 THEN 'evidence_add: no evidence id' END FROM events""",
)
def s5b(spark, sf_dir):
    r = F.col("event_id") % 4
    node = F.format_string('{"type":"%s","properties":{"%s":%s}%s}', F.col("event_type"), F.when(r == 1, "last_seen").otherwise("n"), F.col("user_id").cast("string"), F.when(r == 2, F.concat(F.lit(',"label":"'), F.repeat(F.lit("é"), F.lit(257)), F.lit('"'))).when(r == 3, ',"ownership":null').otherwise(""))
    source = F.when(r == 1, "null").when(r == 2, '{"id":"a","node_index":0}').otherwise('{"node_index":0}')
    added = F.when(r == 3, "e_1").otherwise(F.concat(F.lit("e_"), F.sha2("event_type", 256)))
    relation = F.format_string('{"type":"has","properties":{},"source_ref":%s,"target_ref":{"id":"b"},"evidence_add":["%s"]}', source, added)
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_id"), F.format_string('{"nodes":[%s],"relations":[%s]}', node, relation).alias("request"))
    items = readers.request_items(requests)
    number = F.coalesce(F.get_json_object("properties", "$.n"), F.get_json_object("properties", "$.last_seen")).cast("bigint")
    return items.select("batch_id", "kind", "item_index", "type", number.alias("number"), checks.write_reason().alias("reason"))


@query(
    "J13_atomic_batches",
    "WITH i AS (SELECT event_id, event_id // 10 AS batch_id, event_type = 'error' AS bad FROM events) SELECT event_id, batch_id FROM i WHERE batch_id NOT IN (SELECT batch_id FROM i WHERE bad)",
)
def j13(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("batch_id"), F.when(F.col("event_type") == "error", "bad").alias("reason"))
    return validation.atomic(items).select("event_id", "batch_id")


@query(
    "S7_quarantine",
    "WITH i AS (SELECT event_id, event_id // 10 AS batch_id, event_type = 'error' AS bad FROM events) SELECT event_id, CASE WHEN bad THEN 'bad' ELSE 'batch refused' END AS reason FROM i WHERE batch_id IN (SELECT batch_id FROM i WHERE bad)",
)
def s7(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("batch_id"), F.when(F.col("event_type") == "error", "bad").alias("reason"))
    path = storage.fresh(spark, "quarantine")
    readers.quarantine(validation.refused(items), path)
    return spark.read.parquet(path).select("event_id", "reason")


@query(
    "J7_rejected_identity",
    "SELECT event_id FROM events WHERE user_id % 13 = 0",
)
def j7(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("event_id", F.lit("user").alias("type"), F.col("user_id").cast("string").alias("key"))
    rejected = items.where("cast(key as bigint) % 13 = 0").select("type", "key")
    return validation.blocked_by_rejection(items, rejected).select("event_id")


@query("R1_R3_stream_spans", "SELECT user_id || ':' || event_type AS record, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(*) AS n FROM events WHERE epoch_us(ts) <= 1705276800000000 + 300000000 GROUP BY record")
def r1(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.concat_ws(":", "user_id", "event_type").alias("record"), F.unix_micros(F.col("ts").cast("timestamp")).alias("observed"))
    return ingest.ingest_spans(rows, storage.fresh(spark, "spans"), 1705276800000000)


@query("R2_stream_merge", _A1)
def r2(spark, sf_dir):
    """The writes in four lots by arrival, each a micro-batch of the stream, which goes on where it ended before."""
    writes, source, folder = _writes(spark, sf_dir).withColumnRenamed("event_id", "tie"), storage.fresh(spark, "arrivals"), storage.fresh(spark, "merged")
    for k in range(4):
        writes.where((F.col("seq") >= k * 250001) & (F.col("seq") < (k + 1) * 250001)).write.mode("append").parquet(source)
        merged = ingest.ingest_merge(spark.readStream.schema(writes.schema).parquet(source), folder)
    return merged


@query("T3_number_transforms", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS int_value, round(CAST(value AS DOUBLE), 1) AS one_decimal, 'AS' || user_id AS asn, user_id AS asn_number FROM events")
def t3(spark, sf_dir):
    go = transforms.apply_chain
    asn = F.concat(F.lit("AS"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", go(F.get_json_object("props", "$.k"), ["int_value"]).alias("int_value"), go(F.col("value").cast("string"), ["cvss_one_decimal"]).alias("one_decimal"), asn.alias("asn"), go(asn, ["asn_number"]).alias("asn_number"))


@query("T5_date_transforms", "SELECT event_id, strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS epoch_utc, strftime(ts, '%Y-%m') AS partial_date FROM events")
def t5(spark, sf_dir):
    go = transforms.apply_chain
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return rows.select("event_id", go(F.unix_seconds("t").cast("string"), ["epoch_utc"]).alias("epoch_utc"), go(F.date_format("t", "yyyy-MM"), ["partial_date"]).alias("partial_date"))


@query(
    "J2_A6_S6_snapshot_upsert",
    f"""WITH x AS (SELECT record, coalesce(string_agg(path || '=' || value, ',' ORDER BY path), '') AS leaves FROM ({_A1}) GROUP BY record),
    t AS (SELECT user_id || ':' || event_type AS record, (event_id * 7919) % 1000003 AS seq, epoch_us(ts) AS made, event_id % 4 <> 0 AS added, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS e FROM events),
    h AS (SELECT *, coalesce(lag(added) OVER (PARTITION BY record, e ORDER BY seq), false) AS had, min(seq) OVER (PARTITION BY record) = seq AS created FROM t),
    r AS (SELECT record, arg_min(made, seq) AS created_at, arg_max(made, seq) AS updated_at FROM t GROUP BY record)
    SELECT h.record, seq, created, CAST(added AND NOT had AS BIGINT) AS links_added, CAST(NOT added AND had AS BIGINT) AS links_removed, created_at, updated_at, coalesce(x.leaves, '') AS leaves
    FROM h JOIN r ON h.record = r.record LEFT JOIN x ON h.record = x.record""",
)
def j2_a6(spark, sf_dir):
    """All writes in two batches by arrival, each a version of the snapshot; what is told of each write, and its record in the last version.

    The snapshot wants one seq a write.  Writes that share one here follow in the order of their events, are merged at that seq, and are all told as creating the record where it
    is the first.
    """
    place, block = F.shiftleft("seq", 40) + F.col("event_id"), 1 << 56
    e = _writes(spark, sf_dir).withColumn("place", place)
    linked = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("e"), (F.get_json_object("props", "$.k").cast("bigint") % 7).cast("string")).alias("evidence"), (F.col("event_id") % 4 != 0).alias("added"))
    e = storage.written(e.join(linked, "event_id"), "writes")
    root = storage.fresh(spark, "snapshot")
    version = versions.commit(spark, root, upsert.empty(spark, root, 16), None)
    told = []
    for batch in (e.where("seq < 500000"), e.where("seq >= 500000")):
        batch = batch.withColumn("merge_seq", F.col("seq")).withColumn("seq", F.col("place"))
        writes = batch.select("record", "seq", F.col("observed").alias("at"), "observed", "reporting")
        links, leaves = batch.select("record", "seq", "evidence", "added"), batch.select("record", "seq", "merge_seq", "path", "removed", "value")
        tables, said = upsert.upsert(spark, root, versions.manifest(spark, root, version), writes, leaves, links, block)
        version = versions.commit(spark, root, tables, version)
        told.append(said)
    records = versions.opened(spark, versions.manifest(spark, root, version)["records"])
    leaves = F.array_join(F.transform("leaves", lambda x: F.concat(x["path"], F.lit("="), x["value"])), ",").alias("leaves")
    said = told[0].unionByName(told[1]).drop("updated", "reason").withColumn("seq", F.shiftright("seq", 40))
    said = said.withColumn("created", F.max("created").over(Window.partitionBy("record", "seq")))
    return said.join(records.select("record", "created_at", "updated_at", leaves), "record")
