"""Content-addressed evidence: identity, provenance, coverage, decoding and chunks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 64 << 10, 2 << 10
#: Bytes of the longest token that is kept.
LONGEST = 1 << 20


def evidence_id(content: Column) -> Column:
    return F.concat(F.lit("e_"), F.sha2(content, 256))


def deduplicated(items: DataFrame) -> DataFrame:
    """items (seq, content, media) -> evidence_id, byte_size, media of the first, n_copies; content itself is not shuffled."""
    named = items.select("seq", evidence_id(F.col("content")).alias("evidence_id"), F.octet_length("content").alias("byte_size"), "media")
    return named.groupBy("evidence_id").agg(F.max("byte_size").cast("long").alias("byte_size"), F.min_by("media", "seq").alias("media"), F.count(F.lit(1)).alias("n_copies"))


def conflicts(items: DataFrame) -> DataFrame:
    """seq of items whose explicit media type differs from that of the first copy."""
    named = items.select("seq", evidence_id(F.col("content")).alias("evidence_id"), "media")
    first = named.groupBy("evidence_id").agg(F.min_by("media", "seq").alias("first_media"))
    return named.join(first, "evidence_id").where("media <> first_media").select("seq", "evidence_id", "media", "first_media")


def provenance(items: DataFrame) -> DataFrame:
    """items (evidence_id, source, seen) -> first and last seen of each pair."""
    return items.groupBy("evidence_id", "source").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


#: Media types outside text/ that hold text (fixed values).
TEXT_MEDIA = ("application/json", "application/xml", "application/javascript", "application/x-ndjson", "application/json-seq", "application/yaml", "application/x-yaml", "application/toml", "message/http")


def is_text(media: Column) -> Column:
    """Whether a declared media type is text: text/*, a listed type, or application/* built on JSON or XML."""
    return media.startswith("text/") | media.isin(*TEXT_MEDIA) | media.rlike(r"\Aapplication/.*\+(?:json|xml)\z")


def coverage(evidence: DataFrame) -> DataFrame:
    """One row: ready evidence by index state; index_failed counts as failed, incomplete apart."""
    ready = evidence.where("lifecycle = 'ready'")
    state = F.when(F.col("index_state") == "index_failed", "failed").otherwise(F.col("index_state"))
    return ready.select(state.alias("state"), "incomplete").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("indexed", "pending", "failed", "not_applicable")], F.count_if((F.col("state") == "indexed") & F.col("incomplete")).alias("incomplete"))


def encoding_of(content: Column, declared: Column) -> Column:
    """The encoding that a byte order mark and the declaration agree on, else null."""
    head = F.hex(F.substring(content, 1, 4))
    mark = F.when(head.startswith("EFBBBF"), "utf-8").when(head.isin("FFFE0000", "0000FEFF"), "utf-32").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be")
    return F.when(mark == "utf-32", F.lit(None)).when(mark.isNull(), F.coalesce(declared, F.lit("utf-8"))).when(declared.isNull() | (declared == mark), mark)


def read_slice(content: Column, offset: int, length: int) -> Column:
    """Bytes offset..offset + length as base64; empty at the end, null beyond it."""
    return F.when(F.octet_length(content) < offset, F.lit(None)).otherwise(F.base64(F.substring(content, offset + 1, length)))


#: Letters, numbers and private characters.
_TOKEN = regex.compile(r"[\p{L}\p{N}\p{Co}]+")


def tokens(text: str) -> list[str]:
    """Letters and digits, lower-case, without diacritics."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _TOKEN.findall(plain.lower())


def _whole(data: bytes, at: int) -> int:
    """The last place up to `at` where a character starts."""
    while 0 < at < len(data) and (data[at] & 0xC0) == 0x80:
        at -= 1
    return at


def chunked(text: str, size: int = CHUNK, overlap: int = OVERLAP):
    """(number, byte start, byte end, owner start, first line, text): cut between characters and, where a token ends in the second half, between tokens; each chunk repeats up to `overlap` bytes of the last."""
    data = text.encode()
    start, number, owned, line, counted = 0, 0, 0, 1, 0
    while start < len(data) or not number:
        end = _whole(data, min(len(data), start + size))
        end = end if end > start else min(len(data), start + 4)  # a size under one character
        body = data[start:end].decode(errors="ignore") if end - start < 4 else data[start:end].decode()
        if end < len(data):
            kept = len(body)
            while kept and body[kept - 1].isalnum():
                kept -= 1
            cut = start + len(body[:kept].encode())
            if cut > start + size // 2:
                end, body = cut, body[:kept]
        line, counted = line + data.count(b"\n", counted, start), start
        yield number, start, end, owned, line, body
        if end >= len(data):
            return
        owned = end
        nxt = max(_whole(data, max(start + 1, end - overlap)), start + 1)
        while nxt < end and (data[nxt] & 0xC0) == 0x80:
            nxt += 1
        before = data[_whole(data, nxt - 1) : nxt].decode()
        if nxt < end and before.isalnum():  # inside a token: on to its end
            rest = data[nxt:end].decode()
            inside = next((k for k, c in enumerate(rest) if not c.isalnum()), len(rest))
            nxt += len(rest[:inside].encode())
        start, number = nxt, number + 1


def chunks(rows: DataFrame, row_id: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk of each text: owner, number, byte_start, byte_end, owner_start, line, text."""

    def run(batches):
        for batch in batches:
            for owner, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if body is None:
                    continue
                out = list(zip(*chunked(body, size, overlap)))
                n = len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array([owner] * n, pa.int64()), *[pa.array(c, pa.int64()) for c in out[:5]], pa.array(out[5])], ["owner", "number", "byte_start", "byte_end", "owner_start", "line", "text"])

    schema = "owner bigint, number bigint, byte_start bigint, byte_end bigint, owner_start bigint, line bigint, text string"
    return rows.selectExpr(f"cast({row_id} as bigint) as owner", f"{text} as text").mapInArrow(run, schema)


def breaks(text: str, after_cr: bool = False) -> int:
    """Line breaks: CRLF is one, also where the CR is the character before the text."""
    return text.count("\r") + text.count("\n") - text.count("\r\n") - (after_cr and text.startswith("\n"))


def _ahead(text: str, at: int, size: int) -> int:
    """The place after `size` bytes of UTF-8 from a place, on to the end of its character."""
    data = text[at : at + size].encode("utf-8", "surrogatepass")
    end = size
    while end < len(data) and (data[end] & 0xC0) == 0x80:
        end += 1
    return at + len(data[:end].decode("utf-8", "surrogatepass"))


def _back(text: str, at: int, size: int) -> int:
    """The place `size` bytes of UTF-8 before a place, back to the start of its character."""
    data = text[max(0, at - size) : at].encode("utf-8", "surrogatepass")
    begin = max(0, len(data) - size)
    while begin and (data[begin] & 0xC0) == 0x80:
        begin -= 1
    return at - len(data[begin:].decode("utf-8", "surrogatepass"))


def _token_around(text: str, at: int, low: int) -> tuple[int, int] | None:
    """The token that reaches over a place, from `low` on; None between tokens."""
    if not 0 < at < len(text) or not _TOKEN.match(text[at - 1]) or not (found := _TOKEN.match(text, at)):
        return None
    first = at
    while first > low and _TOKEN.match(text[first - 1]):
        first -= 1
    return first, found.end()


def pieces(text: str, encoding: str = "utf-8", mark: int = 0, size: int = CHUNK, overlap: int = OVERLAP, longest: int = LONGEST):
    """(number, byte start, byte end, owner start, line, after a CR, gap, text) of the chunks of a decoded source.

    Bytes are those of the source in its encoding, after a byte order mark of `mark` bytes.  A chunk has about `size` bytes of UTF-8 and goes on to the end of a token
    that reaches over its end; the next one repeats up to `overlap` bytes before that, from the start of a token.  A token beyond `longest` bytes is left out: what
    stands before it is a chunk, and a gap takes its place.
    """
    width = lambda a, z: len(text[a:z].encode(encoding))
    at, raw, owned, line, after_cr, number = 0, mark, mark, 1, False, 0

    def moved(to: int) -> None:
        nonlocal at, raw, line, after_cr
        part = text[at:to]
        raw, line, after_cr, at = raw + width(at, to), line + breaks(part, after_cr), part.endswith("\r") if part else after_cr, to

    while at < len(text) or not number:
        cut = _ahead(text, at, size)
        token = _token_around(text, cut, at)
        if token and len(text[token[0] : token[1]].encode()) > longest:
            if token[0] > at:
                yield number, raw, raw + width(at, token[0]), owned, line, after_cr, False, text[at : token[0]]
                number += 1
                moved(token[0])
                owned = raw
            yield number, raw, raw, owned, line, after_cr, True, ""
            number += 1
            moved(token[1])
            owned = raw
            continue
        cut = token[1] if token else cut
        yield number, raw, raw + width(at, cut), owned, line, after_cr, False, text[at:cut]
        number += 1
        if cut >= len(text):
            return
        owned = raw + width(at, cut)
        begin = max(at, _back(text, cut, overlap))
        around = _token_around(text, begin, at)
        begin = around[0] if around else begin
        moved(begin if begin > at else cut)


#: Python's names of the encodings, their marks.
_MARKS = {"utf-8": b"\xef\xbb\xbf", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
_CHUNK = "owner bigint, number bigint, byte_start bigint, byte_end bigint, owner_start bigint, line bigint, after_cr boolean, gap boolean, text string, encoding string"


def source_chunks(rows: DataFrame, row_id: str, content: str, encoding: str, size: int = CHUNK, overlap: int = OVERLAP, longest: int = LONGEST) -> DataFrame:
    """Chunks of sources in bytes and their encodings (encoding_of): owner, number, byte_start, byte_end, owner_start, line, after_cr, gap, text, encoding.

    A source without an encoding, or with bytes that do not fit it, has one row with a null text: it cannot be indexed.  A source with a gap is incomplete.
    """

    def run(batches):
        for batch in batches:
            for owner, body, name in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if not body.is_valid:
                    continue
                data, mark = body.as_py(), _MARKS.get(name or "", b"")
                mark = mark if mark and data.startswith(mark) else b""
                try:
                    out = list(pieces(data[len(mark) :].decode(name or "none", "strict"), name, len(mark), size, overlap, longest))
                except (UnicodeError, LookupError):
                    out = [(0, 0, 0, 0, 1, False, False, None)]
                columns, n = list(zip(*out)), len(out)
                kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([owner] * n, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array([name] * n, pa.string())], [c.split()[0] for c in _CHUNK.split(", ")])

    return rows.selectExpr(f"cast({row_id} as bigint) as owner", f"cast({content} as binary) as content", f"{encoding} as encoding").mapInArrow(run, _CHUNK)
