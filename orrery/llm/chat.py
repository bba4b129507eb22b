"""Chat formatting from an event log, with DataFrame functions only.

A log has one row per event: conversation, message, sequence number, kind, role, text.
Kinds: `message` (a whole message, replaces what was said; a null kind counts as this), `delta` (text appended to the message), `edit` (the text
replaces what the message says), `regenerate` (what the message says is dropped; deltas
that follow start it anew); other kinds say nothing.  Each message is folded by grouped aggregates: what counts is
the last replacing event and the deltas after it.  The messages of a conversation are
then sorted by their first sequence number and rendered into one string.

Template: `<|turn|>role<|text|>text<|end|>` for each message.  Roles and texts are escaped, `&`,
`<` and `[` as `&amp;`, `&lt;` and `&#91;`, so neither the template's marks nor `</s>` and
`[INST]` of other templates can come from a text, and unescaping gives the text back.
`loss` lists the spans (code points, start from 0, length) of assistant texts.

Defined results: null text and null role are empty; events without a sequence number come
first; of events of one message with equal sequence numbers the deltas come last, then kind, role and text decide;
messages with equal sequence numbers are ordered by role and text; a null message is one message of its conversation; a null conversation is one
conversation; a message that only regenerates is an empty message with its role; an empty
log gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
REPLACING = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log: each row is a message of its own, repeated rows too, with a start that names the role and a delta with the text."""
    text, role = F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), role, text)
    turns = turns.groupBy("conv_id", "seq", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    turns = turns.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    start = F.struct(F.lit("message").alias("kind"), F.col("role"), F.lit("").alias("text"))
    delta = F.struct(F.lit("delta").alias("kind"), F.lit("").alias("role"), F.col("text"))
    message = F.xxhash64("seq", F.col("seq").isNull(), "role", "text", "copy").alias("message_id")
    return turns.select("conv_id", message, "seq", F.explode(F.array(start, delta)).alias("event")).select("conv_id", "message_id", "seq", "event.*")


def fold(events: DataFrame) -> DataFrame:
    """Messages in their final form: conv_id, message_id, seq (of the first event), role, text.

    All events are grouped by message, so what one group holds is bounded by one message.
    """
    clean = events.select("conv_id", "message_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("seq", (F.col("kind") == "delta").alias("adds"), "kind", "role", "text")))
    grouped = clean.groupBy("conv_id", "message_id").agg(parts.alias("parts"))
    # the place of the last replacing event (0: none); it and the deltas after it are what the message says
    replaces = F.transform("parts", lambda e, i: F.when(e["kind"].isin(*REPLACING), i + 1).otherwise(0))
    grouped = grouped.withColumn("last", F.array_max(replaces))
    said = F.filter(F.slice("parts", F.greatest("last", F.lit(1)), F.size("parts")), lambda e: e["kind"].isin("delta", "message", "edit"))
    folded = F.array_join(F.transform(said, lambda e: e["text"]), "")
    role = F.expr("coalesce(try_element_at(filter(parts, e -> e.role <> ''), 1).role, '')")
    return grouped.select("conv_id", "message_id", F.col("parts")[0]["seq"].alias("seq"), role.alias("role"), folded.alias("text"))


def formatted(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (array of start and length)."""
    turns = fold(events).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("turns"))
    shown = turns.select("conv_id", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss"))).alias("shown"))
    rendered = F.array_join(F.transform("shown", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))), "")
    spans = F.expr(
        f"""aggregate(shown, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int>>)),
            (a, t) -> named_struct(
                'at', a.at + {len(TURN + TEXT + END)} + length(t.role) + length(t.text),
                'spans', if(t.loss, array_append(a.spans, named_struct('start', a.at + {len(TURN + TEXT)} + length(t.role), 'length', length(t.text))), a.spans)),
            a -> a.spans)"""
    )
    return shown.select("conv_id", rendered.alias("formatted"), spans.alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_texts, both taken from the rendered string."""
    pieces = F.slice(F.split("formatted", r"<\|end\|>"), 1, F.size(F.split("formatted", r"<\|end\|>")) - 1)
    turn = lambda p: F.struct(
        unescape(F.substring_index(p.substr(F.lit(len(TURN) + 1), F.length(p)), TEXT, 1)).alias("role"),
        unescape(F.substring_index(p, TEXT, -1)).alias("text"),
    )
    said = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return rendered.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), said.alias("loss_texts"))
