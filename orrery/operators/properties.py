"""Property predicates and the property index."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, LONGEST_PATH, LONGEST_VALUE = 512, 1024, 1024
DEPTH, LEAVES, MEMBERS = 4, 32, 100


def _steps(pointer: str) -> list[str]:
    return [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]


def _name(step: str) -> str:
    """An object key as a variant path step."""
    quote = '"' if "'" in step else "'"
    if quote in step:
        raise ValueError(f"a key with both kinds of quotes has no variant path: {step}")
    return f"[{quote}{step}{quote}]"


def variant_path(pointer: str) -> str:
    """A JSON Pointer as a variant path; numeric steps are array indexes (value_at finds keys of digits too)."""
    return "$" + "".join(f"[{s}]" if s.isdecimal() else _name(s) for s in _steps(pointer))


def value_at(document: Column, pointer: str) -> Column:
    """The variant at a JSON Pointer: a canonical decimal step is an index of an array and a key of an object."""
    found, names = document, ""
    for step in _steps(pointer):
        if step.isdecimal() and step == str(int(step)):
            own = F.try_variant_get(found, f"${names}", "variant") if names else found
            found, names = F.coalesce(F.try_variant_get(own, f"$[{step}]", "variant"), F.try_variant_get(own, f"$['{step}']", "variant")), ""
        else:
            names += _name(step)
    return F.try_variant_get(found, f"${names}", "variant") if names or found is document else found


def category(value: Column) -> Column:
    """JSON category of a variant value; null for a missing one."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(kind == "VOID", "null")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )


TESTS = {"eq": lambda x, y: x == y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y}


def whole_test(op: str, wanted: int | float):
    """The exact comparison of integers (a decimal column) with a number."""
    if isinstance(wanted, float) and not math.isfinite(wanted):
        return lambda x: F.lit(op in (("lt", "lte") if wanted > 0 else ("gt", "gte")))
    if op == "eq":
        bound = math.floor(wanted)
        return (lambda x: x == F.lit(bound).cast("decimal(38,0)")) if bound == wanted and abs(bound) < 10**38 else (lambda x: F.lit(False))
    # x > 2.5 is x > 2, x >= 2.5 is x >= 3
    bound = math.floor(wanted) if op in ("gt", "lte") else math.ceil(wanted)
    if abs(bound) >= 10**38:
        return lambda x: F.lit((bound < 0) == (op in ("gt", "gte")))
    return lambda x: TESTS[op](x, F.lit(str(bound)).cast("decimal(38,0)"))


def real_test(op: str, wanted: int | float):
    """The exact comparison of doubles with a number, which a double need not hold."""
    try:
        near = float(wanted)
    except OverflowError:
        near = math.inf if wanted > 0 else -math.inf
        return lambda x: F.lit(op in (("lt", "lte") if wanted > 0 else ("gt", "gte")))
    if near == wanted:
        return lambda x: TESTS[op](x, F.lit(near))
    if op == "eq":
        return lambda x: F.lit(False)
    low = near if near < wanted else math.nextafter(near, -math.inf)
    return lambda x: x > F.lit(low) if op in ("gt", "gte") else x <= F.lit(low)


def checked(node: dict) -> dict:
    """The tree, if it is one: groups of at most DEPTH levels, at most LEAVES leaves, operators with operands that they take; else a ValueError."""
    left, leaves = [(node, 0)], 0
    while left:
        one, depth = left.pop()
        if not isinstance(one, dict):
            raise ValueError("a filter is an object")
        groups = {"all", "any"} & set(one)
        if groups:
            members = one[next(iter(groups))]
            if len(one) != 1 or not isinstance(members, list) or not members:
                raise ValueError("a group has one list of members")
            if depth >= DEPTH:
                raise ValueError(f"groups go {DEPTH} levels deep")
            left += [(m, depth + 1) for m in members]
            continue
        leaves += 1
        op, value = one.get("op"), one.get("value")
        if leaves > LEAVES:
            raise ValueError(f"a filter has {LEAVES} predicates at most")
        if not set(one) <= {"op", "path", "value"} or not isinstance(one.get("path"), str) or op not in (*TESTS, "ne", "in", "exists"):
            raise ValueError("a predicate has path, op and value")
        if one["path"] and not re.fullmatch(r"(?:/(?:[^~/]|~[01])*)+", one["path"], re.DOTALL):
            raise ValueError("a path is a JSON Pointer")
        if op == "exists":
            if not isinstance(value, (bool, type(None))):
                raise ValueError("exists takes a boolean")
            continue
        values = value if op == "in" else [value]
        if not isinstance(values, list) or not 1 <= len(values) <= MEMBERS:
            raise ValueError(f"in takes 1 to {MEMBERS} values")
        kinds = (str, int, float) if op in ("gt", "gte", "lt", "lte") else (str, int, float, bool, type(None))
        if any(not isinstance(v, kinds) or isinstance(v, bool) and bool not in kinds for v in values):
            raise ValueError("values are scalars, of ranges numbers or strings")
    return node


def predicate(document: Column, op: str, pointer: str, value=None) -> Column:
    """One leaf of a predicate tree over a variant; never null.

    Types must agree; `ne` is false where the path is missing; ranges compare numbers with numbers
    and strings with strings.
    """
    found = value_at(document, pointer)
    if op == "exists":
        return found.isNotNull() if value in (None, True) else found.isNull()
    if op == "in":
        out = F.lit(False)
        for v in value:
            out = out | predicate(document, "eq", pointer, v)
        return out
    wanted = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
    same = F.coalesce(category(found) == wanted, F.lit(False))
    read = lambda kind: F.try_variant_get(found, "$", kind)

    def compared(op):
        """The comparison on values of one type; integers, and decimals without places, are compared exactly with whatever number is asked for."""
        if wanted != "number":
            return TESTS[op](read(wanted), F.lit(value))
        whole = F.schema_of_variant(found).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
        return F.when(whole, whole_test(op, value)(read("decimal(38,0)"))).otherwise(real_test(op, value)(read("double")))

    if op in ("eq", "ne"):
        equal = same if wanted == "null" else same & F.coalesce(compared("eq"), F.lit(False))
        return equal if op == "eq" else found.isNotNull() & ~equal
    if wanted in ("null", "boolean"):
        return F.lit(False)
    return same & F.coalesce(compared(op), F.lit(False))


def tree(document: Column, node: dict) -> Column:
    """{'all': [...]}, {'any': [...]} or a leaf {'op', 'path', 'value'}."""
    if "all" in node or "any" in node:
        parts = [tree(document, n) for n in node.get("all", node.get("any"))]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if "all" in node else out | p
        return out
    return predicate(document, node["op"], node["path"], node.get("value"))


def indexed(leaves: DataFrame, required: list[str], budget: int = BUDGET) -> DataFrame:
    """The leaves that the index keeps for each owner: required paths first, then paths outside arrays, then the rest, each by path.

    Strings beyond LONGEST_VALUE bytes keep their type only (materialized false).
    """
    rank = F.when(F.col("path").isin(*required), 0).when(~F.col("in_array"), 1).otherwise(2)
    fits = leaves.where(F.octet_length("path") <= LONGEST_PATH)
    place = F.row_number().over(Window.partitionBy("owner").orderBy(rank, "path"))
    small = F.octet_length("value") <= LONGEST_VALUE
    return fits.withColumn("place", place).where(F.col("place") <= budget).select("owner", "path", "kind", small.alias("materialized"), F.when(small, F.col("value")).alias("value"))


def coverage(leaves: DataFrame, kept: DataFrame) -> DataFrame:
    """owner, total_paths, indexed_paths, omitted_values, complete."""
    total = leaves.groupBy("owner").agg(F.count(F.lit(1)).alias("total_paths"))
    have = kept.groupBy("owner").agg(F.count(F.lit(1)).alias("indexed_paths"), F.count_if(~F.col("materialized")).alias("omitted_values"))
    both = total.join(have, "owner", "left").fillna(0, ["indexed_paths", "omitted_values"])
    return both.withColumn("complete", (F.col("total_paths") == F.col("indexed_paths")) & (F.col("omitted_values") == 0))
