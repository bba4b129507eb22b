"""Building text units of evidence again: all of it or some, with other media types or encodings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import evidence


def decoded(rows: DataFrame, row_id: str, content: str, encoding: str) -> DataFrame:
    """owner, text: contents (bytes) in their encodings (evidence.encoding_of), without a byte order mark.

    The text is null where the encoding is null or unknown, or where any byte does not fit it; the job goes on.
    """

    def one(body, name):
        try:
            return None if body is None or name is None else bytes(body).decode(name, "strict").removeprefix("﻿")
        except (UnicodeError, LookupError):
            return None

    def run(batches):
        for batch in batches:
            text = [one(*pair) for pair in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["owner", "text"])

    return rows.selectExpr(f"cast({row_id} as bigint) as owner", f"{content} as content", f"{encoding} as encoding").mapInArrow(run, "owner bigint, text string")


def overridden(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """items (owner, content, media, encoding, generation) with overrides (owner, media, encoding; null keeps); one more generation for each that an override names."""
    change = overrides.select("owner", F.col("media").alias("new_media"), F.col("encoding").alias("new_encoding"), F.lit(1).alias("step"))
    both = items.join(change, "owner", "left")
    return both.select("owner", "content", F.coalesce("new_media", "media").alias("media"), F.coalesce("new_encoding", "encoding").alias("encoding"), (F.col("generation") + F.coalesce("step", F.lit(0))).alias("generation"))


def rebuilt(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of items (owner, content, media, encoding, generation): states (owner, generation, index_state, incomplete), and text units.

    Media types that hold no text are not_applicable; contents that do not decode are index_failed, and incomplete; so are
    those with a token too long to keep.
    """
    text = F.coalesce(evidence.is_text(F.col("media")), F.lit(False))
    found = items.where(text).withColumn("coding", evidence.encoding_of(F.col("content"), F.col("encoding")))
    read = evidence.source_chunks(found, "owner", "content", "coding")
    kept = read.groupBy("owner").agg(F.bool_and(F.col("text").isNotNull()).alias("read"), F.bool_or("gap").alias("gap"))
    state = F.when(~F.col("is_text"), "not_applicable").when(F.col("read"), "indexed").otherwise("index_failed")
    states = items.select("owner", "generation", text.alias("is_text")).join(kept, "owner", "left").select("owner", "generation", state.alias("index_state"), "gap")
    units = read.where("text is not null").join(items.select("owner", "generation"), "owner")
    incomplete = (F.col("index_state") == "index_failed") | F.coalesce("gap", F.lit(False))
    return states.select("owner", "generation", "index_state", incomplete.alias("incomplete")), units


def current(units: DataFrame, states: DataFrame) -> DataFrame:
    """Units of the generation that the states name; those of an older one, or of what is not indexed, are no longer shown."""
    live = states.where("index_state = 'indexed'").select("owner", "generation")
    return units.join(live, ["owner", "generation"], "left_semi")
