"""All registered queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.plans import documents, events, orders, pages, requests, rules  # noqa: F401
from orrery.plans.book import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["A7_ready_counts"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
