"""Full-text search over text units: postings, all-words and literal matches, BM25, pages."""

from __future__ import annotations

import math
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import jsonwalk
from orrery.operators.evidence import breaks
from orrery.sources.storage import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SNIPPET = 512
#: References that a unit shows.
REFERENCES = 32


def _bare() -> tuple[str, str]:
    """Letters with marks and the letters that remain without them; then the marks themselves, which go."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        rest = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(rest) == 1 and rest != chr(code):
            marked.append(chr(code))
            plain.append(rest)
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


_MARKED, _PLAIN = _bare()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and private characters, without diacritics; text in ASCII has none to lose."""
    whole = F.regexp_extract_all(F.translate(F.lower(text), _MARKED, _PLAIN), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.length(text) == F.octet_length(text), plain).otherwise(whole)


#: Bounds of a text query (fixed values): bytes and tokens.
QUERY_BYTES, QUERY_TOKENS = 2048, 32
_WORD = regex.compile(r"[\p{L}\p{N}\p{Co}]+")


def compiled(query: Column, mode: str = "words") -> Column:
    """tokens (in order; of `words` each once) and reason: why a query is refused, null where it is not."""
    words = tokens(query) if mode == "literal" else F.array_distinct(tokens(query))
    reason = F.when(F.octet_length(query) > QUERY_BYTES, "too long").when(F.size(words) == 0, "no tokens").when(F.size(words) > QUERY_TOKENS, "too many tokens")
    return F.struct(F.when(reason.isNull(), words).alias("tokens"), reason.alias("reason"))


def places(text: str, phrase: str):
    """Code points (start, end) of every hit of a phrase, overlapping ones too, whose first and last token are whole tokens of the text."""
    own = list(_WORD.finditer(phrase))
    at = text.find(phrase) if own else -1
    while at >= 0:
        first, last = at + own[0].start(), at + own[-1].end()
        if not (first and _WORD.match(text[first - 1])) and not (last < len(text) and _WORD.match(text[last])):
            yield at, at + len(phrase)
        at = text.find(phrase, at + 1)


def references(chunks: DataFrame, phrase: str, snippets: bool = False) -> DataFrame:
    """chunks (owner, byte_start, owner_start, line, text) -> owner, byte_start, byte_end, line_start, line_end of each hit, once.

    Ranges are those of the whole source, in its own encoding where chunks name one; CRLF is one line break, also across chunks (after_cr), and a lone CR is one too; a break that ends a
    hit does not count for it.  A hit that ends in what a chunk repeats of the one before belongs to that one.  Units of records may bring a pointer, which their hits
    keep; with `snippets` a hit has the first SNIPPET bytes of text from its start.
    """
    more = {"pointer": "string", "snippet": "string"}
    extra = [c for c in more if c in chunks.columns or c == "snippet" and snippets]

    def run(batches):
        for batch in batches:
            out = []
            for owner, base, owned, line, text, after_cr, encoding, pointer in zip(*(batch.column(k).to_pylist() for k in range(8))):
                done, size, lines, text = 0, base, line, text or ""
                for start, end in places(text, phrase):
                    before = text[done:start]
                    size, lines = size + len(before.encode(encoding)), lines + breaks(before, after_cr)
                    done, after_cr = start, before.endswith("\r") if before else after_cr
                    last = size + len(text[start:end].encode(encoding))
                    if last > owned:
                        own = {"pointer": pointer, "snippet": text[start : start + SNIPPET].encode("utf-8", "replace")[:SNIPPET].decode(errors="ignore") if snippets else None}
                        out.append((owner, size, last, lines, lines + breaks(text[start : end - 1], after_cr), *(own[c] for c in extra)))
            columns = list(zip(*out)) if out else [()] * (5 + len(extra))
            kinds = [pa.int64()] * 5 + [pa.string()] * len(extra)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["owner", "byte_start", "byte_end", "line_start", "line_end", *extra])

    given = lambda name, other: F.col(name) if name in chunks.columns else F.lit(other)
    picked = chunks.select("owner", "byte_start", "owner_start", "line", "text", given("after_cr", False).alias("after_cr"), given("encoding", "utf-8").alias("encoding"), given("pointer", None).cast("string").alias("pointer"))
    found = picked.mapInArrow(run, ", ".join(["owner bigint, byte_start bigint, byte_end bigint, line_start bigint, line_end bigint", *(f"{c} {more[c]}" for c in extra)]))
    return found.dropDuplicates(["owner", "byte_start", "byte_end", *(c for c in extra if c == "pointer")])


def first_references(found: DataFrame, most: int = REFERENCES) -> DataFrame:
    """The first references of each owner, by pointer and place, and how many there are in all (n); Spark keeps so many of an owner in each task before it shuffles them."""
    place = [c for c in ("pointer", "byte_start", "byte_end") if c in found.columns]
    ranked = found.withColumn("__place", F.row_number().over(Window.partitionBy("owner").orderBy(*place))).where(F.col("__place") <= most)
    return ranked.drop("__place").join(found.groupBy("owner").agg(F.count(F.lit(1)).alias("n")), "owner")


def record_units(records: DataFrame, owner: str, properties: str, label: str | None = None) -> DataFrame:
    """Text units of records as chunks: the label, and each string of the properties under its pointer; what is no JSON has no strings."""

    def run(batches):
        for batch in batches:
            out = []
            for own, text, said in zip(*(batch.column(k).to_pylist() for k in range(3))):
                value = jsonwalk.parsed(text)[1]
                out += [(own, "/label", said)] if said is not None else []
                out += [(own, f"/properties{at}", v) for at, v, _, _ in jsonwalk.leaves(value) if isinstance(v, str)]
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["owner", "pointer", "text"])

    told = f"cast({label} as string)" if label else "cast(null as string)"
    found = records.selectExpr(f"cast({owner} as bigint) as owner", f"{properties} as properties", f"{told} as label").mapInArrow(run, "owner bigint, pointer string, text string")
    zero = F.lit(0).cast("long")
    return found.select("owner", "pointer", zero.alias("byte_start"), zero.alias("owner_start"), F.lit(1).cast("long").alias("line"), "text")


def postings(units: DataFrame, only: list[str] | None = None) -> DataFrame:
    """units (unit, text) -> token, unit, tf, length (tokens of the unit); of some tokens only, where these are named."""
    words = units.select("unit", tokens(F.col("text")).alias("words"))
    kept = F.col("words") if only is None else F.filter("words", lambda w: w.isin(*only))
    rows = words.select("unit", F.size("words").alias("length"), F.explode(kept).alias("token"))
    return rows.groupBy("token", "unit").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def with_all(found: DataFrame, words: list[str]) -> DataFrame:
    """Units that hold every word: found is postings restricted or not."""
    wanted = sorted(set(words))
    return found.where(F.col("token").isin(*wanted)).groupBy("unit").agg(F.countDistinct("token").alias("n")).where(F.col("n") == len(wanted)).select("unit")


def bm25(units: DataFrame, words: list[str]) -> DataFrame:
    """unit, score (negative, less is better) of units that hold every word; a unit may have several rows of text.

    A unit's score is the sum of its best row's score for each word.  Only the query's tokens leave the scan; the number of
    rows, their mean length and the document frequencies are sums over all rows.
    """
    wanted = sorted(set(words))
    if not wanted:
        raise ValueError("no words")
    own = units.select("unit", tokens(F.col("text")).alias("words"))
    counts = written(own.select("unit", F.size("words").alias("length"), *[_times(t).alias(f"tf{k}") for k, t in enumerate(wanted)]), "counts")  # texts are cut once
    total = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))]).first()
    scores, any_of = [], F.lit(False)
    for k in range(len(wanted)):
        df, tf = total[f"df{k}"], F.col(f"tf{k}")
        idf = max(LEAST_IDF, math.log((total.n - df + 0.5) / (df + 0.5))) if df else 0.0
        value = -idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / (total["mean"] or 1.0)))
        scores.append(F.min(F.when(tf > 0, value)).alias(f"s{k}"))
        any_of = any_of | (tf > 0)
    best = counts.where(any_of).groupBy("unit").agg(*scores)
    whole = sum((F.col(f"s{k}") for k in range(len(wanted))), F.lit(0.0))
    return best.select("unit", whole.alias("score")).where("score is not null")


def _times(word: str) -> Column:
    return F.size(F.filter("words", lambda w: w == F.lit(word)))


def literal(units: DataFrame, phrase: str) -> DataFrame:
    """Units that hold the phrase exactly, not inside a longer token at either end; with the first place (code points)."""
    inner = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", phrase)
    pattern = (r"(?<![\p{L}\p{N}])" if phrase[:1].isalnum() else "") + inner + (r"(?![\p{L}\p{N}])" if phrase[-1:].isalnum() else "")
    hits = units.where(F.col("text").contains(phrase) & F.col("text").rlike(pattern))
    return hits.select("unit", F.regexp_instr("text", F.lit(pattern)).alias("place"), F.regexp_count("text", F.lit(pattern)).alias("hits"))


def snippet(text: Column, place: Column, size: int = SNIPPET) -> Column:
    """At most `size` bytes of the text from the place, whole characters only."""
    start = F.substring(text, place, F.lit(size))
    data = F.encode(start, "UTF-8")
    # a character has at most four bytes, so one of these ends does not split any
    whole = [F.try_validate_utf8(F.substring(data, 1, size - k).cast("string")) for k in range(min(4, size))]
    return F.when(F.octet_length(start) <= size, start).otherwise(F.coalesce(*whole))


def best_unit(scores: DataFrame) -> DataFrame:
    """scores (owner, unit, score, is_evidence) -> the best unit of each owner: least score, own record first, then unit."""
    best = F.min_by(F.struct(*scores.columns), F.struct("score", "is_evidence", "unit"))
    return scores.groupBy("owner").agg(best.alias("b")).select("b.*")


# What a search can ask of a record besides its properties and text.
EQUAL = ("type", "key", "source", "source_id", "target_id", "media_type", "index_state", "ownership", "authorization", "allowlist_scoped")
RANGES = ("first_seen", "last_seen", "byte_size", "created_at")


def filtered(records: DataFrame, asked: dict, sources: DataFrame | None = None) -> DataFrame:
    """Records that have each asked value (a field of EQUAL) and lie in each range (<field>_min, <field>_max of RANGES, both included).

    A field without a value is not asked for; a null never fits.  With sources (id, source) a record (id) fits a source where
    any of its rows there does: evidence may come from several.
    """
    told = {name: value for name, value in asked.items() if value is not None}
    if unknown := set(told) - set(EQUAL) - {f"{f}_{end}" for f in RANGES for end in ("min", "max")}:
        raise ValueError(f"no filters: {sorted(unknown)}")
    out = records
    for name, value in told.items():
        if name == "source" and sources is not None:
            out = out.join(sources.where(F.col("source") == F.lit(value)).select("id"), "id", "left_semi")
        elif name in EQUAL:
            out = out.where(F.col(name) == F.lit(value))
        elif name.endswith("_min"):
            out = out.where(F.col(name.removesuffix("_min")) >= F.lit(value))
        else:
            out = out.where(F.col(name.removesuffix("_max")) <= F.lit(value))
    return out


def combined(records: DataFrame, owners: DataFrame | None = None, units: DataFrame | None = None, words: list[str] | None = None, links: DataFrame | None = None) -> DataFrame:
    """records (id) that are among owners (id), where given, and whose text holds all words: id, unit, score, is_evidence of the best unit.

    units (unit, text) are those of records, where unit is the record's id, and of evidence that links (owner, unit) ties to records.
    Without words each record comes once, without a unit and a score.
    """
    shown = records.select("id") if owners is None else records.select("id").join(owners.select("id"), "id", "left_semi")
    if not words:
        return shown.select("id", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("is_evidence"))
    scores = bm25(units, words)
    own = scores.select(F.col("unit").alias("owner"), "unit", "score", F.lit(False).alias("is_evidence"))
    if links is not None:
        own = own.unionByName(scores.join(links.select("owner", "unit").distinct(), "unit").select("owner", "unit", "score", F.lit(True).alias("is_evidence")))
    kept = own.join(shown.withColumnRenamed("id", "owner"), "owner", "left_semi")
    return best_unit(kept).withColumnRenamed("owner", "id")


def top(scores: DataFrame, k: int, by: str = "unit") -> DataFrame:
    """The k best by (score, id)."""
    return scores.orderBy("score", by).limit(k)


def page(rows: DataFrame, column: str, after, limit: int) -> DataFrame:
    """The rows after a key, in key order, and whether more follow."""
    got = rows.where(F.col(column) > F.lit(after)).orderBy(column).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(column))  # limit + 1 rows
    return got.withColumn("place", place).withColumn("has_more", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit).drop("place")


def pages(rows: DataFrame, owner: str, by: list[str], limit: int) -> DataFrame:
    """The first `limit` rows of each owner in the order of `by` (unique inside an owner), and whether it has more.

    Tasks keep limit + 1 rows of an owner before the shuffle, so an owner with most of all rows is no burden.
    """
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*by))
    first = rows.withColumn("place", place).where(F.col("place") <= limit + 1)
    return first.withColumn("has_more", F.max("place").over(Window.partitionBy(owner)) > limit).where(F.col("place") <= limit).drop("place")
