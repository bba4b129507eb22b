"""Readers and writers on small files."""

from pyspark.sql import functions as F

from orrery.sources import readers


def test_json_lines_keep_types(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"port": 443}\n{"port": "443"}\nno json\n')
    rows = readers.json_lines(spark, str(tmp_path)).select("line", F.schema_of_variant(F.try_variant_get("record", "$.port", "variant")).alias("t")).collect()
    assert {r.line: r.t for r in rows} == {'{"port": 443}': "BIGINT", '{"port": "443"}': "STRING", "no json": None}


def test_json_documents_of_one_or_many(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1},\n {"k": 2}]')
    (tmp_path / "b.json").write_text('{"k": 3}')
    rows = readers.json_documents(spark, str(tmp_path)).select(F.variant_get("record", "$.k", "int").alias("k")).collect()
    assert sorted(r.k for r in rows) == [1, 2, 3]


def test_xml_records(spark, tmp_path):
    (tmp_path / "scan.xml").write_text('<run><host id="1"><name>a</name></host><host id="2"><name>b</name></host></run>')
    rows = readers.xml_records(spark, str(tmp_path), "host", "_id int, name string").collect()
    assert sorted((r._id, r.name) for r in rows) == [(1, "a"), (2, "b")]


def test_key_value_text(spark):
    text = "% notice\nDomain Name: EXAMPLE.COM\nDomain Status: ok x\nDomain Status: hold\n# end: no\n>>> last: no\n"
    rows = readers.key_values(spark.createDataFrame([(1, text)], "id int, body string"), "id", "body").collect()
    assert {r.key: r["values"] for r in rows} == {"domain name": ["EXAMPLE.COM"], "domain status": ["ok x", "hold"]}


def test_bytes(spark):
    row = spark.range(1).select(readers.evidence_bytes(text=F.lit("é")).alias("t"), readers.evidence_bytes(base64=F.lit("w6k=")).alias("b"), readers.evidence_bytes(base64=F.lit("?")).alias("bad")).first()
    assert bytes(row.t) == bytes(row.b) == "é".encode() and row.bad is None


def test_quarantine_appends(spark, tmp_path):
    items = spark.createDataFrame([(1, "nodes[0]", "bad"), (1, "nodes[1]", None)], "batch_id int, address string, reason string")
    for _ in range(2):
        readers.quarantine(items, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2
