"""Queries on documents as evidence and search corpus, and on conversations as text records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import evidence, reindex, search
from orrery.plans.book import query, table
from orrery.sources import readers

_WORDS = ["the", "and", "tion"]


def _units(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), "text")


@query(
    "A12_evidence_dedupe",
    "SELECT 'e_' || sha256(text) AS evidence_id, max(strlen(text)) AS byte_size, arg_min(source, doc_id) AS media, count(*) AS n_copies FROM documents GROUP BY 1",
)
def a12(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.encode("text", "UTF-8").alias("content"), F.col("source").alias("media"))
    return evidence.deduplicated(items)


@query(
    "A12_media_conflicts",
    "WITH d AS (SELECT doc_id, 'e_' || sha256(text) AS evidence_id, source FROM documents), f AS (SELECT evidence_id, arg_min(source, doc_id) AS first_media FROM d GROUP BY 1) SELECT doc_id AS seq, d.evidence_id, source AS media, first_media FROM d JOIN f ON d.evidence_id = f.evidence_id WHERE source <> first_media",
)
def a12b(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.encode("text", "UTF-8").alias("content"), F.col("source").alias("media"))
    return evidence.conflicts(items)


@query("A13_provenance", "SELECT 'e_' || sha256(text) AS evidence_id, source, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM documents GROUP BY 1, 2")
def a13(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(evidence.evidence_id(F.encode("text", "UTF-8")).alias("evidence_id"), "source", F.col("doc_id").alias("seen"))
    return evidence.provenance(d)


@query(
    "A9_evidence_coverage",
    """SELECT count(*) FILTER (WHERE lang = 'en') AS indexed, count(*) FILTER (WHERE lang = 'de') AS pending, count(*) FILTER (WHERE lang = 'fr') AS failed,
    count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr')) AS not_applicable, count(*) FILTER (WHERE lang = 'en' AND n_chars > 3000) AS incomplete FROM documents WHERE doc_id % 10 <> 0""",
)
def a9(spark, sf_dir):
    s = F.when(F.col("lang") == "en", "indexed").when(F.col("lang") == "de", "pending").when(F.col("lang") == "fr", "index_failed").otherwise("not_applicable")
    rows = table(spark, sf_dir, "documents").select(s.alias("index_state"), (F.col("n_chars") > 3000).alias("incomplete"), F.when(F.col("doc_id") % 10 == 0, "deleting").otherwise("ready").alias("lifecycle"))
    return evidence.coverage(rows)


@query("D3_read_slice", "SELECT doc_id, CASE WHEN strlen(text) >= 100 THEN base64(encode(text)[101:150]) END AS bytes FROM documents")
def d3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evidence.read_slice(F.encode("text", "UTF-8"), 100, 50).alias("bytes"))


@query("S4_evidence_bytes", "SELECT doc_id, sha256(text) AS sha256, doc_id % 2 = 0 AS read FROM documents")
def s4(spark, sf_dir):
    coded = F.when(F.col("doc_id") % 2 == 0, F.base64(F.encode("text", "UTF-8"))).otherwise(F.lit("no base64!"))
    rows = table(spark, sf_dir, "documents").select("doc_id", readers.evidence_bytes(text=F.col("text")).alias("bytes"), readers.evidence_bytes(base64=coded).alias("decoded"))
    return rows.select("doc_id", F.sha2("bytes", 256).alias("sha256"), F.col("decoded").isNotNull().alias("read"))


@query("F3_detect_encoding", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-le' ELSE 'latin-1' END AS encoding FROM documents")
def f3(spark, sf_dir):
    marked = F.when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("lang", "UTF-16LE"))).otherwise(F.encode("lang", "UTF-8"))
    declared = F.when(F.col("doc_id") % 3 == 2, "latin-1")
    return table(spark, sf_dir, "documents").select("doc_id", evidence.encoding_of(marked, declared).alias("encoding"))


@query("F2_text_candidates", "SELECT doc_id, doc_id % 8 IN (0, 1, 4, 5, 6) AS is_text FROM documents")
def f2(spark, sf_dir):
    media = F.element_at(F.array(*[F.lit(m) for m in ("text/html", "application/json", "image/svg+xml", "image/png", "message/http", "application/problem+json", "application/toml", "application/jsonx")]), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.is_text(media).alias("is_text"))


@query("F4_iter_chunks")
def f4(spark, sf_dir):
    found = evidence.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("owner", "number", "byte_start", "byte_end", "owner_start", "line", F.sha2("text", 256).alias("sha256"))


@query(
    "F4_source_chunks",
    """SELECT doc_id AS owner, (CASE WHEN doc_id % 3 = 0 THEN 2 * length(text) ELSE strlen(text) END)::BIGINT AS bytes, sha256(text) AS sha256,
    (1 + length(text) - length(replace(text, chr(10), '')))::BIGINT AS lines, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS first_byte, false AS incomplete FROM documents""",
)
def f4_sources(spark, sf_dir):
    """A third of the sources in UTF-16 with a mark: what the chunks own, put together again, is the whole text."""
    wide = F.col("doc_id") % 3 == 0
    content = F.when(wide, F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE"))).otherwise(F.encode("text", "UTF-8"))
    sources = table(spark, sf_dir, "documents").select("doc_id", content.alias("content")).withColumn("coding", evidence.encoding_of(F.col("content"), F.lit(None).cast("string")))
    found = evidence.source_chunks(sources, "doc_id", "content", "coding", 4096, 256)
    data = F.when(F.col("encoding") == "utf-8", F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16LE"))
    owned = F.substring(data, (F.col("owner_start") - F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("owner_start")).cast("int"))
    part = F.struct("number", F.when(F.col("encoding") == "utf-8", F.decode(owned, "UTF-8")).otherwise(F.decode(owned, "UTF-16LE")).alias("text"))
    last = F.max(F.col("line") + F.regexp_count("text", F.lit("\n"))).alias("lines")
    one = found.groupBy("owner").agg(F.sum(F.col("byte_end") - F.col("owner_start")).alias("bytes"), F.array_sort(F.collect_list(part)).alias("parts"), last, F.min("byte_start").alias("first_byte"), F.bool_or("gap").alias("incomplete"))
    return one.select("owner", "bytes", F.sha2(F.array_join("parts.text", ""), 256).alias("sha256"), "lines", "first_byte", "incomplete")


@query(
    "F11_record_references",
    """WITH h AS (SELECT page_id AS owner, unnest(['/label', '/properties/url']) AS pointer, url FROM pages WHERE starts_with(url, 'http:'))
    SELECT owner, pointer, 0::BIGINT AS byte_start, 4::BIGINT AS byte_end, 1::BIGINT AS line_start, 1::BIGINT AS line_end, url AS snippet, 2::BIGINT AS n FROM h
    WHERE len(regexp_extract_all(url, '(^|[^a-zA-Z0-9])http([^a-zA-Z0-9]|$)')) = 1""",
)
def f11_records(spark, sf_dir):
    """Hits in the strings of records, under their pointers."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.to_json(F.struct("url", "page_id")).alias("properties"))
    units = search.record_units(pages, "page_id", "properties", "url")
    return search.first_references(search.references(units, "http", snippets=True))


@query("F5_tokens", r"SELECT doc_id, len(regexp_extract_all(strip_accents(lower(text)), '[\pL\pN\p{Co}]+')) AS n FROM documents")
def f5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(search.tokens(F.col("text"))).cast("long").alias("n"))


_TOK = r"tok AS (SELECT doc_id AS unit, regexp_extract_all(strip_accents(lower(text)), '[\pL\pN\p{Co}]+') AS w FROM documents)"


@query("F5_postings", rf"WITH {_TOK}, x AS (SELECT unit, len(w) AS length, unnest(w) AS token FROM tok) SELECT token, unit, count(*) AS tf, any_value(length) AS length FROM x GROUP BY token, unit")
def postings(spark, sf_dir):
    return search.postings(_units(spark, sf_dir)).select("token", "unit", "tf", F.col("length").cast("long").alias("length"))


@query("F8_U1_words_match", rf"WITH {_TOK} SELECT unit FROM tok WHERE list_contains(w, 'the') AND list_contains(w, 'and')")
def f8(spark, sf_dir):
    return search.with_all(search.postings(_units(spark, sf_dir), ["the", "and"]), ["the", "and"])


@query(
    "F9_bm25",
    rf"""WITH {_TOK}, c AS (SELECT unit, len(w) AS l, len(list_filter(w, lambda t: t = 'the')) AS a, len(list_filter(w, lambda t: t = 'was')) AS b FROM tok),
    s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
    SELECT unit, round(-(greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score
    FROM c, s WHERE a > 0 AND b > 0""",
)
def f9(spark, sf_dir):
    return search.bm25(_units(spark, sf_dir), ["the", "was"]).select("unit", F.round("score", 6).alias("score"))


@query("F7_literal_match", r"SELECT doc_id AS unit, len(regexp_extract_all(text, '(^|[^\pL\pN])of the($|[^\pL\pN])')) > 0 AS found FROM documents WHERE regexp_matches(text, '(^|[^\pL\pN])of the($|[^\pL\pN])')")
def f7(spark, sf_dir):
    return search.literal(_units(spark, sf_dir), "of the").select("unit", (F.col("hits") > 0).alias("found"))


@query(
    "W6_snippets",
    """WITH s AS (SELECT doc_id AS unit, substr(text, strpos(text, 'the'), 20) AS s FROM documents WHERE contains(text, 'the'))
    SELECT unit, substr(s, 1, list_max(list_filter(range(21), lambda k: strlen(substr(s, 1, k)) <= 20))::INT) AS snippet FROM s""",
)
def w6(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.col("text").contains("the"))
    return rows.select(F.col("doc_id").alias("unit"), search.snippet(F.col("text"), F.instr("text", "the"), 20).alias("snippet"))


@query(
    "F12_W3_search_top_k",
    rf"""WITH {_TOK}, c AS (SELECT unit, len(w) AS l, len(list_filter(w, lambda t: t = 'the')) AS a FROM tok), s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS d FROM c)
    SELECT unit, round(-greatest(1e-6, ln((n - d + 0.5) / (d + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)), 9) AS score FROM c, s WHERE a > 0 AND unit IN (SELECT doc_id FROM documents WHERE lang <> 'de') ORDER BY score, unit LIMIT 20""",
)
def f12(spark, sf_dir):
    shown = table(spark, sf_dir, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("unit"))
    scores = search.bm25(_units(spark, sf_dir), ["the"]).select("unit", F.round("score", 9).alias("score"))
    return search.top(scores.join(shown, "unit", "left_semi"), 20)


@query(
    "U2_linked_owners",
    rf"WITH {_TOK} SELECT DISTINCT d.source FROM documents d JOIN tok ON d.doc_id = tok.unit WHERE list_contains(w, 'the') OR d.lang = 'es'",
)
def u2(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hits = search.with_all(search.postings(_units(spark, sf_dir)), ["the"])
    linked = d.join(hits.withColumnRenamed("unit", "doc_id"), "doc_id", "left_semi").select("source")
    return linked.union(d.where("lang = 'es'").select("source")).distinct()


@query(
    "W7_best_unit",
    "WITH s AS (SELECT source AS owner, doc_id AS unit, n_chars::DOUBLE AS score, doc_id % 2 = 0 AS is_evidence FROM documents) SELECT owner, unit, score, is_evidence FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score, is_evidence, unit) AS k FROM s) WHERE k = 1",
)
def w7(spark, sf_dir):
    scores = table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("unit"), F.col("n_chars").cast("double").alias("score"), (F.col("doc_id") % 2 == 0).alias("is_evidence"))
    return search.best_unit(scores)


@query("V32_builtin_filters", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars BETWEEN 100 AND 1000 AND source = 'src1' AND doc_id >= 10")
def v32(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("n_chars").alias("byte_size"), F.col("doc_id").alias("created_at"), "source")
    asked = {"type": "en", "byte_size_min": 100, "byte_size_max": 1000, "created_at_min": 10, "created_at_max": None, "source": "src1"}
    return search.filtered(docs.drop("source"), asked, docs.select("id", "source")).select(F.col("id").alias("doc_id"))


@query(
    "F12_W7_combined_search",
    rf"""WITH {_TOK}, c AS (SELECT unit, len(w) AS l, len(list_filter(w, lambda t: t = 'the')) AS a FROM tok), s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS d FROM c),
    b AS (SELECT unit, -greatest(1e-6, ln((n - d + 0.5) / (d + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) AS score FROM c, s WHERE a > 0),
    o AS (SELECT unit AS owner, unit, score, false AS is_evidence FROM b UNION ALL SELECT unit // 10 * 10, unit, score, true FROM b WHERE unit % 10 <> 0),
    f AS (SELECT o.*, row_number() OVER (PARTITION BY owner ORDER BY score, is_evidence, unit) AS place FROM o JOIN documents d ON d.doc_id = owner WHERE owner % 10 = 0 AND n_chars >= 200)
    SELECT owner AS id, unit, round(score, 9) AS score, is_evidence FROM f WHERE place = 1""",
)
def f12b(spark, sf_dir):
    """Every tenth document as a record with a text of its own; the nine that follow are its evidence."""
    docs = table(spark, sf_dir, "documents")
    units = _units(spark, sf_dir)
    records = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("byte_size"))
    links = docs.where("doc_id % 10 <> 0").select(F.expr("doc_id div 10 * 10").alias("owner"), F.col("doc_id").alias("unit"))
    found = search.combined(search.filtered(records, {"byte_size_min": 200}), None, units, ["the"], links)
    return found.withColumn("score", F.round("score", 9))


@query("V29_id_grammars", "SELECT doc_id, true AS evidence, length(source) = 64 AS hash FROM documents")
def v29(spark, sf_dir):
    from orrery.functions.grammar import whole

    e = evidence.evidence_id(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", whole(e, "e_[0-9a-f]{64}").alias("evidence"), whole(F.col("source"), "[0-9a-f]{64}").alias("hash"))


@query("J6_missing_evidence", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'fr')")
def j6(spark, sf_dir):
    from orrery.operators import reports

    return reports.missing(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").where("lang <> 'fr'"), "doc_id")


@query("J11_bare_claims", "SELECT DISTINCT source AS node_id FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0)")
def j11(spark, sf_dir):
    from orrery.operators import validation

    links = table(spark, sf_dir, "documents").select(F.col("source").alias("node_id"), F.col("doc_id").alias("evidence_id"))
    ready = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("evidence_id"))
    return validation.bare_claims(links.select("node_id").distinct(), links, ready)


@query("F1_record_text_units", "SELECT conv_id AS owner, '/' || turn || '/text' AS pointer, text FROM conversations UNION ALL SELECT conv_id, '/' || turn || '/role', role FROM conversations")
def f1(spark, sf_dir):
    from orrery.functions import jsonwalk

    turn = F.map_from_arrays(F.array(F.col("turn").cast("string")), F.array(F.struct("role", "text")))
    leaves = jsonwalk.exploded(table(spark, sf_dir, "conversations").select("conv_id", F.to_json(turn).alias("document")), "conv_id", "document")
    return leaves.where("kind = 'string'").select("owner", F.col("path").alias("pointer"), F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v").alias("text"))


@query(
    "S3_key_value_text",
    "SELECT conv_id AS owner, lower(role) AS key, list(trim(replace(text, chr(10), ' ')) ORDER BY turn) AS values FROM conversations WHERE trim(replace(text, chr(10), ' ')) <> '' GROUP BY ALL",
)
def s3(spark, sf_dir):
    line = F.concat(F.col("role"), F.lit(": "), F.regexp_replace("text", "\n", " "))
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return readers.key_values(texts, "conv_id", "body")


@query(
    "F13_F3_reindexed_evidence",
    r"""SELECT doc_id AS owner, CASE WHEN doc_id % 5 < 3 THEN 2 ELSE 1 END AS generation,
    CASE WHEN doc_id % 5 = 0 THEN 'not_applicable' WHEN doc_id % 5 = 1 AND strlen(text) <> length(text) THEN 'index_failed' ELSE 'indexed' END AS index_state,
    CASE WHEN doc_id % 5 = 0 OR doc_id % 5 = 1 AND strlen(text) <> length(text) THEN 0 ELSE strlen(text) END AS held FROM documents""",
)
def f13(spark, sf_dir):
    """Of every five documents one becomes an image, one is declared ASCII, one is named without a change."""
    docs = table(spark, sf_dir, "documents")
    items = docs.select(F.col("doc_id").cast("long").alias("owner"), F.encode("text", "UTF-8").alias("content"), F.lit("text/plain").alias("media"), F.lit(None).cast("string").alias("encoding"), F.lit(1).alias("generation"))
    r = F.col("doc_id") % 5
    named = docs.where(r < 3).select(F.col("doc_id").cast("long").alias("owner"), F.when(r == 0, "image/png").alias("media"), F.when(r == 1, "ascii").alias("encoding"))
    states, units = reindex.rebuilt(reindex.overridden(items, named))
    held = reindex.current(units, states).groupBy("owner").agg(F.sum(F.col("byte_end") - F.greatest("owner_start", "byte_start")).alias("held"))
    return states.join(held, "owner", "left").select("owner", "generation", "index_state", F.coalesce("held", F.lit(0)).alias("held"))
