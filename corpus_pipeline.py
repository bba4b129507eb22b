"""The corpus pipeline: from raw documents to token shards, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run()
writes each stage's rows as Parquet to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontaminate, minhash, mixing, tokens, toxicity
from orrery.llm.common import scratch, table

#: Shares of the domains after mixing; what little still looks toxic is left as it is.
MIX = {"clean": 0.9, "rough": 0.1}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that score as toxic go."""
    return toxicity.acceptable(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each class of near-duplicates the document with the least id stays."""
    return minhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents a twentieth of whose words are benchmark windows go."""
    return decontaminate.clean_of(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as its rate says."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), MIX)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token shards with their index; one row per document, read back from them."""
    import public_tokenizers

    return tokens.token_table(docs, public_tokenizers.path(tokens.VOCABULARY))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Fitted models and hash signatures are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
