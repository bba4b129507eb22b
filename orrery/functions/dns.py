"""Registrable domains and name kinds from a table of public-suffix rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import grammar

#: A few rules for tests and samples; production passes the whole list as a table rule(string).
SAMPLE_RULES = ("com", "net", "org", "io", "co.uk", "*.ck", "!www.ck")


def sample_rules(spark) -> DataFrame:
    return spark.createDataFrame([(r,) for r in SAMPLE_RULES], "rule string")


def classify(names: DataFrame, rules: DataFrame) -> DataFrame:
    """names (name) -> name, registrable, kind (domain, subdomain, or null for a suffix itself).

    The prevailing rule is an exception, else the longest match, else the last label.  A wildcard
    stands for one label.  Each distinct name is joined once for each of its suffixes, and names are read once.
    """
    one = names.select("name").where("name is not null").distinct().withColumn("labels", F.split("name", r"\."))
    tails = one.select("name", F.size("labels").alias("n"), F.posexplode("labels").alias("at", "label"), "labels")
    tails = tails.withColumn("tail", F.expr("array_join(slice(labels, at + 1, n), '.')")).withColumn("wild", F.expr("concat('*', substr(tail, length(label) + 1))"))
    rule = rules.select(F.regexp_replace("rule", "^!", "").alias("pattern"), F.col("rule").startswith("!").alias("exception")).distinct()
    hits = tails.select("name", "n", "at", F.explode(F.array(F.col("tail"), F.col("wild"))).alias("pattern")).join(rule, "pattern", "left")
    # the number of labels of the suffix: an exception is one label shorter than it matches
    size = F.col("n") - F.col("at") - F.col("exception").cast("int")
    best = F.max(F.when(F.col("exception").isNotNull(), F.struct("exception", size.alias("size"))))
    found = hits.groupBy("name").agg(best.alias("best")).withColumn("labels", F.split("name", r"\.")).withColumn("size", F.coalesce("best.size", F.lit(1)))
    extra = F.size("labels") - F.col("size")
    registrable = F.when(extra >= 1, F.expr("array_join(slice(labels, size(labels) - size, size + 1), '.')"))
    kind = F.when(extra == 1, "domain").when(extra > 1, "subdomain")
    return found.select("name", registrable.alias("registrable"), kind.alias("kind"))


def spelled(name: Column) -> Column:
    """A name as the rules read it: lower case, without the root dot; null for an address or an empty text."""
    plain = F.lower(F.regexp_replace(name, r"\.+\z", ""))
    return F.when(~plain.rlike(r":|\A[0-9.]*\z"), plain)


def with_kinds(rows: DataFrame, name: Column, rules: DataFrame, column: str = "kind") -> DataFrame:
    """rows and the kind of a name of theirs (domain, subdomain); null for an address, a suffix, or what is no host name."""
    marked = rows.withColumn("__name", spelled(name))
    sound = marked.where(grammar.valid("dns_name", F.col("__name"))).select(F.col("__name").alias("name"))
    kinds = classify(sound, rules).select(F.col("name").alias("__name"), F.col("kind").alias(column))
    return marked.join(kinds, "__name", "left").drop("__name")
