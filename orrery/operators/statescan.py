"""Ownership, authorization, allowlist markers and overrides of records, request after request, without going through a record's requests in one row.

A request is a function from the state before it to the state after it.  There are few states, each with a letter, so the function is a word: its i-th letter is where the
i-th state leads.  Functions are chained inside blocks of ranks, blocks in blocks of blocks, and so on up; on the way down each block learns the state that it starts from.
So a record with a third of all requests is as many tasks as it has blocks, and no row holds more than a block.

The ranks come from one sort of all requests by (record, seq), split by range and so also inside a record; they are written down once.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import merge, state
from orrery.sources.storage import written


class State(NamedTuple):
    ownership: str | None
    authorization: str | None
    allowlist: bool


#: States of a record that carries its own state; the first is that of a record which is not there yet.
ROOT_STATES = (
    State(None, None, False),
    *(State(o, a, listed) for o in ("owned", "candidate", "dependency") for a, listed in (("unknown", False), ("in_scope", False), ("out_of_scope", False), ("in_scope", True))),
    State("rejected", "unknown", False),
)
#: Overrides of a scoped record.
OVERRIDES = (None, "in_scope", "out_of_scope")


def _then(word: Column, after: Column, letters: str) -> Column:
    """The word (or single letter) followed by the function `after`."""
    return F.call_function("translate", word, F.lit(letters), after)


def _chained(rows: Column, letters: str) -> Column:
    return F.aggregate(rows, F.lit(letters), lambda word, r: _then(word, r["lead"], letters))


def _walked(rows: Column, start: Column, letters: str) -> Column:
    """The letters before each row, and the last one after all."""
    return F.aggregate(rows, start, lambda seen, r: F.concat(seen, _then(F.right(seen, F.lit(1)), r["lead"], letters)))


def before_each(requests: DataFrame, lead: Column, states: int, first: DataFrame | None = None, size: int = 256) -> DataFrame:
    """requests (record, seq, ...; none null there) with the column `before`: the letter of the state that the requests before it in its record lead to.

    `lead` is the word of each request over the letters a, b, ... of `states` states; a record starts from its letter in `first`
    (record, letter; one row a record), else from a.  Requests of one record and seq are taken in the order of their words.
    """
    letters = string.ascii_letters[:states]
    keyed = requests.withColumn("__lead", lead)
    ranked = keyed.repartitionByRange("record", "seq", "__lead").sortWithinPartitions("record", "seq", "__lead").withColumn("__place", F.monotonically_increasing_id())
    ranked = written(ranked, "ranked").withColumn("__block", F.floor(F.col("__place") / size))
    held = F.sort_array(F.collect_list(F.struct(F.col("__place").alias("at"), F.col("__lead").alias("lead")))).alias("rows")
    blocks = ranked.groupBy("record", "__block").agg(held).select("record", "__block", _chained(F.col("rows"), letters).alias("lead"))
    # places of blocks in their record: one row for `size` requests
    level = blocks.withColumn("at", F.row_number().over(Window.partitionBy("record").orderBy("__block")) - 1)
    levels = [written(level, "blocks")]
    most = levels[0].agg(F.max("at")).first()[0] or 0
    up = lambda rows: rows.withColumn("up", F.floor(F.col("at") / size))
    inner = F.sort_array(F.collect_list(F.struct("at", "lead"))).alias("rows")
    while most >= size:
        most //= size
        grouped = up(levels[-1]).groupBy("record", "up").agg(inner)
        levels.append(written(grouped.select("record", F.col("up").alias("at"), _chained(F.col("rows"), letters).alias("lead")), "blocks"))
    start = F.lit("a")
    starts = levels[-1].select("record").distinct().withColumn("up", F.lit(0).cast("bigint"))
    if first is not None:
        starts = starts.join(first.select("record", "letter"), "record", "left")
        start = F.coalesce("letter", start)
    starts = starts.select("record", "up", start.alias("start"))
    for level in reversed(levels):
        grouped = up(level).groupBy("record", "up").agg(inner).join(starts, ["record", "up"])
        told = grouped.select("record", "rows", _walked(F.col("rows"), F.col("start"), letters).alias("seen"))
        each = told.select("record", "seen", F.posexplode("rows").alias("i", "r"))
        starts = each.select("record", F.col("r.at").alias("up"), F.substring("seen", F.col("i") + 1, F.lit(1)).alias("start"))
    named = levels[0].select("record", "__block", F.col("at").alias("up")).join(starts, ["record", "up"]).select("record", "__block", "start")
    words = ranked.groupBy("record", "__block").agg(held).join(named, ["record", "__block"])
    told = words.select("__block", "record", "rows", _walked(F.col("rows"), F.col("start"), letters).alias("seen"))
    each = told.select(F.posexplode("rows").alias("i", "r"), "seen").select(F.col("r.at").alias("__place"), F.substring("seen", F.col("i") + 1, F.lit(1)).alias("before"))
    return ranked.join(each, "__place").drop("__lead", "__place", "__block")


def _field(before: Column, values: list, kind: str) -> Column:
    """A field of the state with this letter."""
    at = F.instr(F.lit(string.ascii_letters[: len(values)]), before)
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), at)


def _judged(rows: DataFrame) -> DataFrame:
    """rows with a request's columns and the state before it (__ownership, __authorization, __allowlist), and what comes of it: __reason, and the state after it (__to_...).

    Step by step in columns, so that no expression is repeated inside the next.
    """
    asked, evidenced = F.col("ownership"), F.coalesce("evidenced", F.lit(False))
    ownership, by_id = F.col("__ownership"), F.coalesce("by_id", F.lit(False))
    named = [s for s in state.STATES if s]
    new, after = ownership.isNull(), F.col("__after")
    rows = rows.withColumn("__after", F.coalesce(asked, ownership)).withColumn("__rejecting", F.coalesce((after == "rejected") & ~ownership.eqNullSafe("rejected"), F.lit(False)))
    rejecting = F.col("__rejecting")
    rows = rows.withColumns({"__was": F.when(rejecting | new, "unknown").otherwise(F.col("__authorization")), "__listed": F.col("__allowlist") & ~rejecting})
    rows = rows.withColumns({"__wants": F.coalesce("authorization", "__was"), "__marked": F.coalesce("allowlist", "__listed")})
    rows = rows.withColumn("__rest", state.authorization_reason(after, F.col("__was"), F.col("__wants"), F.col("__listed"), F.col("__marked"), evidenced))
    reason = (
        F.when(new & by_id, "missing")
        .when(after.isNull(), "ownership required")
        .when(asked.isNotNull() & ~(F.array_contains(F.coalesce("allowed", F.array(*[F.lit(s) for s in named])), asked) & asked.isin(*named)), "ownership not allowed")
        .when(F.col("authorization").isNotNull() & ~F.col("authorization").isin("unknown", "in_scope", "out_of_scope"), "unknown authorization")
        .when(~state.transition_allowed(ownership, after, evidenced), F.when(rejecting, "only candidates are rejected").when(after == "candidate", "rejected").otherwise("evidence required"))
        .otherwise(F.col("__rest"))
    )
    kept = ~new & ~by_id  # found by its identity: an observation, which moves no state
    rows = rows.withColumn("__reason", F.when(~kept, reason)).withColumn("__stays", kept | F.col("__reason").isNotNull())
    then = {"ownership": "__after", "authorization": "__wants", "allowlist": "__marked"}
    return rows.withColumns({f"__to_{k}": F.when(F.col("__stays"), F.col(f"__{k}")).otherwise(F.col(v)) for k, v in then.items()})


def _placed(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a place in a record's order, and those without."""
    there = F.col("record").isNotNull() & F.col("seq").isNotNull()
    return requests.where(there), requests.where(~there)


def _letter(states: list[tuple], fields: tuple[Column, ...]) -> Column:
    out = F.lit("a")
    for letter, s in zip(string.ascii_letters, states):
        fits = F.lit(True)
        for field, value in zip(fields, s):
            fits = fits & field.eqNullSafe(F.lit(value))
        out = F.when(fits, letter).otherwise(out)
    return out


#: What a request asks for.
_ASKED = ("by_id", "ownership", "authorization", "allowlist", "evidenced", "allowed")


def _kind(requests: DataFrame) -> DataFrame:
    """The requests with what they ask for in few spellings (unknown words as `?`), and all of that in one column, kind."""
    named = [s for s in state.STATES if s]
    one_of = lambda name, words: F.when(F.col(name).isin(*words), F.col(name)).when(F.col(name).isNotNull(), "?")
    asked = requests.withColumns(
        {
            "by_id": F.coalesce("by_id", F.lit(False)),
            "ownership": one_of("ownership", named),
            "authorization": one_of("authorization", ("unknown", "in_scope", "out_of_scope")),
            "evidenced": F.coalesce("evidenced", F.lit(False)),
            "allowed": F.array_intersect(F.array(*[F.lit(s) for s in named]), F.coalesce("allowed", F.array(*[F.lit(s) for s in named]))),
        }
    )
    return asked.select("*", F.to_json(F.struct(*_ASKED), {"ignoreNullFields": "false"}).alias("kind"))


def _as_columns(s: State) -> list[Column]:
    return [F.lit(v).cast(kind).alias(k) for k, v, kind in zip(State._fields, s, ("string", "string", "boolean"))]


def root_requests(requests: DataFrame, snapshot: DataFrame | None = None, size: int = 256) -> DataFrame:
    """What becomes of requests to records that carry their own state.

    requests (record, seq, by_id, ownership, authorization, allowlist, evidenced, allowed, ...): by_id tells whether the request names the record's id (else it
    finds the record by its identity, which creates it where it is new and otherwise moves no state); null fields ask for nothing; allowed lists the ownerships of the
    record's type (null: all).  Added: before and after, structs of ownership, authorization and allowlist, and reason where the request is refused; a refused one leaves
    the state as it was.  Records start as in snapshot (record, ownership, authorization, allowlist), else they are new.  Requests without record or seq
    are refused as such.
    """
    placed, lost = _placed(requests)
    words = _kind(placed).select("kind", *_ASKED).dropDuplicates(["kind"])
    words = words.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *_as_columns(s)) for i, s in enumerate(ROOT_STATES)])))
    words = _judged(words.withColumns({f"__{k}": F.col(f"__s.{k}") for k in State._fields}))
    to = _letter(ROOT_STATES, tuple(F.col(f"__to_{k}") for k in State._fields))
    words = words.select("kind", F.struct("__s.i", to.alias("to")).alias("step")).groupBy("kind").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    words = words.select("kind", F.array_join(F.transform("steps", lambda x: x["to"]), "").alias("word"))
    # at most 6 x 5 x 3 x 2 x 2 x 16 kinds of requests
    worded = _kind(placed).join(F.broadcast(words), "kind").drop("kind")
    first = None if snapshot is None else snapshot.select("record", _letter(ROOT_STATES, tuple(F.col(k) for k in State._fields)).alias("letter"))
    told = before_each(worded, F.col("word"), len(ROOT_STATES), first, size)
    was = [_field(F.col("before"), [getattr(s, k) for s in ROOT_STATES], kind) for k, kind in zip(State._fields, ("string", "string", "boolean"))]
    judged = _judged(told.withColumns({f"__{k}": field for k, field in zip(State._fields, was)}))
    pack = lambda prefix, name: F.struct(*[F.col(prefix + k).alias(k) for k in State._fields]).alias(name)
    judged = judged.select(*requests.columns, pack("__", "before"), pack("__to_", "after"), F.col("__reason").alias("reason"))
    nothing = F.lit(None).cast(judged.schema["before"].dataType)
    return judged.unionByName(lost.select("*", nothing.alias("before"), nothing.alias("after"), F.lit("no record or seq").alias("reason")))


def _judged_child(override: Column) -> tuple[Column, Column]:
    asked = F.col("authorization")
    after = F.when(asked == "unknown", F.lit(None).cast("string")).otherwise(asked)
    changes = asked.isNotNull() & ~after.eqNullSafe(override) & F.coalesce("by_id", F.lit(False))
    reason = (
        F.when(F.col("ownership").isNotNull(), "ownership is inherited")
        .when(F.col("allowlist").isNotNull(), "allowlist is inherited")
        .when(asked.isNotNull() & ~asked.isin("unknown", "in_scope", "out_of_scope"), "unknown authorization")
        .when(changes & after.isNotNull() & ~F.coalesce("evidenced", F.lit(False)), "evidence required")
        .when(changes & (after == "in_scope") & ~F.col("root_listed"), "root has no allowlist")
    )
    return reason, F.when(reason.isNull() & changes, after).otherwise(override)


def child_requests(requests: DataFrame, root_states: DataFrame, size: int = 256) -> DataFrame:
    """What becomes of requests to scoped records, which inherit all but an override of authorization.

    requests (record, root, seq, by_id, ownership, authorization, allowlist, evidenced, ...); root_states (record, seq, allowlist): the allowlist marker that each request to a
    root leaves, as `root_requests` gives it (where a root has several of one seq, it counts as marked if one of them leaves it so).  A child's request meets its root as it is after all requests of the same or a smaller seq; an
    in_scope override is only for roots with an allowlist then.  by_id is also true for the request that creates the child.  `unknown` takes the
    override back.  Added: root_listed, before, after and reason.
    """
    placed, lost = _placed(requests)
    # twice the seq, and one more for children: a root's own request of that seq comes first
    marks = root_states.where("record is not null and seq is not null").groupBy("record", "seq").agg(F.max("allowlist").alias("listed"))
    marks = marks.select(F.col("record").alias("root"), (F.col("seq") * 2).alias("seq"), F.struct("seq", "listed").alias("mark"))
    child = placed.where("root is not null").select("record", "root", "seq").distinct().select("root", (F.col("seq") * 2 + 1).alias("seq"), F.struct("record", "seq").alias("child"))
    both = marks.unionByName(child, allowMissingColumns=True)
    timed = merge.greatest_before(both, ["root"], F.col("mark")).where("child is not null")
    met = timed.select(F.col("child.record").alias("record"), "root", F.col("child.seq").alias("seq"), F.col("__before.listed").alias("root_listed"))
    asked = placed.join(met, ["record", "root", "seq"], "left").withColumn("root_listed", F.coalesce("root_listed", F.lit(False)))
    states = [(o,) for o in OVERRIDES]
    word = F.concat(*[_letter(states, (_judged_child(F.lit(o).cast("string"))[1],)) for o in OVERRIDES])
    told = before_each(asked, word, len(states), None, size)
    was = _field(F.col("before"), list(OVERRIDES), "string")
    reason, then = _judged_child(was)
    judged = told.select(*requests.columns, "root_listed", was.alias("before"), then.alias("after"), reason.alias("reason"))
    rest = lost.select("*", F.lit(None).cast("boolean").alias("root_listed"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), F.lit("no record or seq").alias("reason"))
    return judged.unionByName(rest)


def accepted_transitions(requests: DataFrame, size: int = 256) -> DataFrame:
    """requests (record, seq, after, evidenced) for ownership alone, with before, the last accepted state, and allowed.

    A refused request leaves the state as it was.  Requests without record or seq are kept with no state before them and allowed null.
    """
    placed, lost = _placed(requests.select("record", "seq", "after", "evidenced"))
    evidenced = F.coalesce("evidenced", F.lit(False))
    states = [(s,) for s in state.STATES]
    then = lambda s: F.when(state.transition_allowed(s, F.col("after"), evidenced), F.col("after")).otherwise(s)
    word = F.concat(*[_letter(states, (then(F.lit(s).cast("string")),)) for s in state.STATES])
    told = before_each(placed, word, len(states), None, size)
    told = told.withColumn("before", _field(F.col("before"), list(state.STATES), "string"))
    judged = told.select("record", "seq", "before", "after", state.transition_allowed(F.col("before"), F.col("after"), evidenced).alias("allowed"))
    return judged.unionByName(lost.select("record", "seq", F.lit(None).cast("string").alias("before"), "after", F.lit(None).cast("boolean").alias("allowed")))
