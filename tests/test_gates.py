"""Conditions that gate mapping rules."""

import pytest

from orrery.functions.transforms import CONDITIONS
from orrery.operators import mapping

MATCHED = "owner bigint, pattern string, when string, asks string"


@pytest.mark.parametrize(("when", "value", "holds"), [
    ("nuclei_http_result", "http", True), ("nuclei_http_result", "headless", True), ("nuclei_http_result", "dns", False), ("nuclei_http_result", None, False),
    ("nuclei_ssl_result", "ssl", True), ("nuclei_ssl_result", None, False), ("nuclei_not_ssl_result", "dns", True), ("nuclei_not_ssl_result", None, True), ("nuclei_not_ssl_result", "ssl", False),
    ("bbot_not_wildcard_placeholder", "a.example", True), ("bbot_not_wildcard_placeholder", "_WILDCARD.example", False), ("host_is_domain", "domain", True), ("host_is_domain", "subdomain", False), ("bbot_names_subdomain", "subdomain", True),
])
def test_conditions(spark, when, value, holds):
    records = spark.createDataFrame([(1, {"f": value, "g": "x"})], "owner bigint, fields map<string,string>")
    got = mapping.gated(spark.createDataFrame([(1, "p", when, "f")], MATCHED), records)
    assert got.count() == holds


def test_rules_without_records_and_conditions(spark):
    assert len(CONDITIONS) >= 8
    records = spark.createDataFrame([(1, {"f": "ssl"}), (2, None)], "owner bigint, fields map<string,string>")
    rows = [(k, f"{k}{when}", when, asks) for k in (1, 2, 3) for when, asks in ((None, None), ("nuclei_ssl_result", "f"), ("nuclei_not_ssl_result", "f"), ("no_such", "f"), ("nuclei_ssl_result", None))]
    got = sorted(r.pattern for r in mapping.gated(spark.createDataFrame(rows, MATCHED), records).collect())
    assert got == sorted(["1None", "1nuclei_ssl_result", "2None", "2nuclei_not_ssl_result", "3None", "3nuclei_not_ssl_result"])
    assert [r.when for r in mapping.unknown_conditions(spark.createDataFrame(rows[:5], MATCHED)).collect()] == ["no_such"]
