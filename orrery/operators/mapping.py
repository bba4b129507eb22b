"""Mapping jobs: leaves of tool output, the rules that match them, values for each sink, redaction."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import jsonwalk
from orrery.functions.transforms import CONDITIONS, apply_chain
from orrery.sources.storage import written

#: Bytes of the secrets of one automaton.
PART_BYTES = 4 << 20


def field_path(column: str = "path"):
    """A leaf's pointer as a rule path: object steps joined by dots, array steps as []."""
    bare = F.substring(F.col(column), F.lit(2), F.length(column))
    return F.regexp_replace(F.regexp_replace(bare, r"/[0-9]+(?=/|\z)", "[]"), "/", ".")


def match(leaves: DataFrame, rules: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """leaves (owner, path, field, ...) with all rules (pattern, sink, ...) of the highest specificity.

    A pattern has as many steps as the field; `*` matches one step; a closing `{name=value,...}` asks for fields of the
    record (records: owner, fields as map<string,string>).  Specificity is the number of steps that are no `*`, then the
    number of qualifiers.
    """
    steps = lambda c: F.split(c, r"\.")
    bare = F.regexp_replace("pattern", r"\{[^}]*\}\z", "")
    asked = F.nullif(F.regexp_extract("pattern", r"\{([^}]*)\}\z", 1), F.lit(""))
    ranked = rules.withColumn("__asked", F.str_to_map(asked, F.lit(","), F.lit("="))).withColumn("__steps", steps(bare)).withColumn("__n", F.size("__steps"))
    ranked = ranked.withColumn("__rank", F.struct(F.size(F.filter("__steps", lambda s: s != "*")).alias("named"), F.coalesce(F.size("__asked"), F.lit(0)).alias("asked")))
    fields = leaves.select("field").distinct().withColumn("__own", steps(F.col("field"))).withColumn("__n", F.size("__own"))
    fits = F.forall(F.zip_with("__steps", "__own", lambda p, s: (p == "*") | (p == s)), lambda ok: ok)
    found = fields.join(ranked, "__n").where(fits)  # distinct fields and rules: both belong to formats, not to data
    if records is None:
        best = found.where("__asked is null").withColumn("__best", F.max("__rank").over(Window.partitionBy("field"))).where("__rank = __best")
        return leaves.join(best.drop("__steps", "__own", "__n", "__rank", "__best", "__asked"), "field")
    told = leaves.join(found, "field").join(records.select("owner", F.col("fields").alias("__fields")), "owner", "left")
    holds = F.col("__asked").isNull() | F.forall(F.map_entries("__asked"), lambda e: F.coalesce(F.try_element_at(F.col("__fields"), e["key"]) == e["value"], F.lit(False)))
    best = told.where(holds).withColumn("__best", F.max("__rank").over(Window.partitionBy("owner", "path"))).where("__rank = __best")
    return best.drop("__steps", "__own", "__n", "__rank", "__best", "__asked", "__fields")


def gated(matched: DataFrame, records: DataFrame) -> DataFrame:
    """Matched rows (owner, ..., `when`, `asks`) whose rule has no condition, or whose condition (functions.transforms.CONDITIONS) holds for the record's field `asks`.

    records: owner, fields as map<string,string>.  A missing record or field is null, which most conditions fail; a condition that nobody knows holds for none.
    """
    held = matched.join(records.select("owner", F.col("fields").alias("__fields")), "owner", "left")
    asked = F.try_element_at(F.col("__fields"), F.col("asks"))
    holds = F.col("when").isNull()
    for name, condition in CONDITIONS.items():
        holds = holds | (F.col("when") == name) & F.coalesce(condition(asked), F.lit(False))
    return held.where(F.coalesce(holds, F.lit(False))).drop("__fields")


def unknown_conditions(rules: DataFrame) -> DataFrame:
    """Rules with a condition that does not exist."""
    return rules.where(F.col("when").isNotNull() & ~F.col("when").isin(*CONDITIONS)).select("pattern", "when")


def mapped(matched: DataFrame, chains: dict[str, list[str]]) -> DataFrame:
    """Values by sink: owner, sink, value (string), each rule's chain applied; nulls drop out."""
    plain = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    value = plain
    for name, chain in chains.items():
        value = F.when(F.col("chain") == name, apply_chain(plain, chain).cast("string")).otherwise(value)
    return matched.select("owner", "sink", value.alias("value")).where("value is not null")


def expected(values: DataFrame) -> DataFrame:
    return values.select("owner", "sink", "value").distinct()


def unmapped(leaves: DataFrame, matched: DataFrame) -> DataFrame:
    """Fields that no rule matches, with the number of their leaves."""
    return leaves.join(matched.select("field").distinct(), "field", "left_anti").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def dead_rules(rules: DataFrame, matched: DataFrame) -> DataFrame:
    return rules.join(matched.select("pattern").distinct(), "pattern", "left_anti").select("pattern")


def difference(values: DataFrame, written: DataFrame) -> DataFrame:
    """Distinct values that only one side has: owner, sink, value, side."""
    a, b = expected(values), expected(written)
    return a.exceptAll(b).withColumn("side", F.lit("mapped")).union(b.exceptAll(a).withColumn("side", F.lit("written")))


def policy_breaches(rules: DataFrame, allowed: list[str]) -> DataFrame:
    """Redacted rules whose sink is stored although it is not among the allowed derivations."""
    return rules.where(F.col("redact") & (F.col("sink") != "non_storable") & ~F.col("sink").isin(*allowed)).select("pattern", "sink")


def redacted(rows: DataFrame, row_id: str, document: str, fields: list[str]) -> DataFrame:
    """owner, document (canonical JSON with [REDACTED] at the fields), secrets (the strings taken out).

    Fields are rule paths: steps joined by dots, `*` for one step, `[]` after an array; of an array of scalars each item goes.
    What is no JSON has a null document and no secrets: nothing of it is stored.
    """
    wanted = [f.removesuffix("[]").split(".") for f in fields]

    def taken(pointer: str) -> bool:
        own = re.sub(r"/[0-9]+(?=/|$)", "[]", pointer[1:]).removesuffix("[]").split("/")
        return any(len(own) == len(w) and all(p in ("*", s) for p, s in zip(w, own)) for w in wanted)

    def run(batches):
        for batch in batches:
            out, secrets = [], []
            for text in batch.column(1).to_pylist():
                sound, value = jsonwalk.parsed(text)
                found = {at: v for at, v, _, _ in jsonwalk.leaves(value) if at and taken(at)}
                out.append(None if not sound else jsonwalk.canonical(jsonwalk.redact(value, set(found))))
                secrets.append([str(v) for v in found.values() if v not in (None, "", [], {})])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(secrets, pa.list_(pa.string()))], ["owner", "document", "secrets"])

    return rows.selectExpr(f"cast({row_id} as bigint) as owner", f"{document} as document").mapInArrow(run, "owner bigint, document string, secrets array<string>")


def leaks_anywhere(secrets: DataFrame, evidence: DataFrame, content: str = "content", part_bytes: int = PART_BYTES) -> DataFrame:
    """secrets (secret) that stand in any content (text or bytes) of evidence (id): secret, found_in, hits; nothing is expected.

    The distinct secrets are dealt to parts of about `part_bytes`; each part is one automaton (Aho-Corasick) that every task runs over
    the bytes of its own contents, so all secrets of a part are looked for in one pass.  Empty secrets are none; hits may overlap.
    """
    told = secrets.select(F.col("secret").cast("string").alias("secret")).where("secret <> ''").distinct()
    held = told.agg(F.sum(F.octet_length("secret")).alias("n")).first()["n"] or 0
    parts = max(1, -(-held // part_bytes))
    marked = written(told.withColumn("part", F.pmod(F.xxhash64("secret"), F.lit(parts))), "secrets")
    picked, out = evidence.select(F.col("id").alias("found_in"), F.col(content).cast("binary").alias("content")), None
    kind = evidence.schema["id"].dataType.simpleString()
    for part in range(parts):
        words = [r["secret"] for r in marked.where(F.col("part") == part).select("secret").toLocalIterator()]
        found = picked.mapInArrow(_finder(words), f"secret string, found_in {kind}, hits bigint") if words else None
        out = found if out is None else out.unionByName(found) if found is not None else out
    return out if out is not None else picked.sparkSession.createDataFrame([], f"secret string, found_in {kind}, hits bigint")


def _finder(words: list[str]):
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, word in enumerate(words):  # bytes as characters
            automaton.add_word(word.encode().decode("latin-1"), k)
        automaton.make_automaton()
        for batch in batches:
            rows = []
            for i, body in enumerate(batch.column(1)):
                if body.is_valid:
                    rows += [(words[k], i, n) for k, n in Counter(k for _, k in automaton.iter(body.as_py().decode("latin-1"))).items()]
            said, at, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64())], ["secret", "found_in", "hits"])

    return run


def leaks(redactions: DataFrame) -> DataFrame:
    """Secrets, short ones too, that still stand in their own document; nothing is expected."""
    return redactions.select("owner", "document", F.explode("secrets").alias("secret")).where(F.col("document").contains(F.col("secret"))).select("owner", "secret")
