"""WARC archives written with an index, and read through it by coalesced byte ranges.

Writing.  Each task writes its pages as files of compressed records (one gzip member a record, a new file after FILE_BYTES), and the job returns
the index: file, offset, length, URL, payload digest and type of each record.  A file's name is unique to the attempt that wrote it, and only
files in the index exist for readers, so lost executors leave nothing half-written behind it.

Equal payloads.  Payloads are compared by SHA-256.  Of those of at least `least` bytes that occur more than once, the smallest page_id is found by
grouped aggregates over digests; that table joins the pages (by broadcast if its size allows, else by a join whose skewed keys Spark splits), and the
other pages become revisit records, which name the response and carry its HTTP header and digest but no payload.

Reading.  Index rows are all a reader needs: any selection of them (by URL, digest, type) is sorted by file and offset, and what lies
within `gap` bytes of each other is fetched in one read of at most `span` bytes (a longer record alone), then cut into records.

Defined results: a null html is an empty payload; a null url or page_id leaves its header out and is read back as null; control characters, blanks and
characters beyond ASCII of a URL are percent-encoded in the record's header (the index keeps the url as it is); rows with a null page_id revisit the smallest page_id of their payload, and are
responses where there is none; rows that share the smallest page_id of a payload are all responses; repeated rows are repeated records; an empty table writes no file and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut, kept, scratch
from orrery.llm.textblocks import lean

LEAST = 100
FILE_BYTES = 1 << 30
GAP, SPAN = 1 << 16, 8 << 20
#: Archive bytes that a task reads, where the session's shuffle partitions would make it more.
TASK_BYTES = 256 << 20
LEVEL = 6

#: Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

INDEX = "page_id bigint, url string, digest string, record_type string, refers_to bigint, payload_bytes bigint, file string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, intact boolean"


def _fs(path: str):
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, wherever and whenever it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def _uri(url: str) -> str:
    return "".join(chr(b) if 0x21 <= b <= 0x7E else f"%{b:02X}" for b in url.encode("utf-8", "surrogatepass"))


def packed(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member; fields without a value are left out."""
    head = "".join(f"{name}: {value}\r\n" for name, value in (*fields, ("Content-Length", str(len(block)))) if value is not None)
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END) + press.flush()


def unpacked(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one record."""
    data = zlib.decompress(raw, 31)
    edge = data.index(_END)
    version, *lines = data[:edge].decode().split("\r\n")
    assert version.startswith("WARC/"), "no WARC record"
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    block = data[edge + 4 : edge + 4 + int(fields["content-length"])]
    assert data[edge + 4 + len(block) :] == _END, "a record of another length"
    return fields, block


def _page(page_id: int | None, url: str | None, digest: str, refers_to: int | None, revisit: bool, payload: bytes, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _uri(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", _PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("X-Refers-To-Page", str(refers_to) if revisit else None),
        ("X-Page", None if page_id is None else str(page_id)),
    ]
    return packed(fields, http if revisit else http + payload)


class _File:
    """An archive file under way: begins with a warcinfo record, knows where the next record starts."""

    def __init__(self, folder: str, date: str):
        filesystem, path = _fs(folder)
        filesystem.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out = filesystem.open_output_stream(f"{path}/{self.name}", compression=None)
        self.offset = 0
        self.add(packed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, record: bytes) -> tuple[int, int]:
        begin, self.offset = self.offset, self.offset + len(record)
        self.out.write(record)
        return begin, len(record)


def _write(batches, folder: str, date: str, file_bytes: int):
    file = None
    for batch in batches:
        page, url, digest, refers, revisit = (batch.column(c).to_pylist() for c in range(5))
        size, where = [], []
        for i, payload in enumerate(batch.column(5)):
            if file is not None and file.offset >= file_bytes:
                file.out.close()
                file = None
            file = file or _File(folder, date)
            body = payload.as_py()
            size.append(len(body))
            where.append((file.name, *file.add(_page(page[i], url[i], digest[i], refers[i], revisit[i], body, date))))
        if where:
            names, offset, length = zip(*where)
            kind = ["revisit" if r else "response" for r in revisit]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(kind), batch.column(3), pa.array(size, pa.int64()), pa.array(names), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                ["page_id", "url", "digest", "record_type", "refers_to", "payload_bytes", "file", "offset", "length"],
            )
    if file is not None:
        file.out.close()


def _digest() -> Column:
    return F.sha2("payload", 256).alias("digest")


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, digest, refers_to (null for responses), revisit, payload."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    long = named.where(F.octet_length("payload") >= least).select("page_id", _digest())
    repeated = long.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    # written, so that its size is known when the join is planned
    first = kept(repeated.select(F.col("digest").alias("same"), "first"), "repeated")
    joined = named.select("page_id", "url", _digest(), "payload").join(first, F.col("digest") == F.col("same"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"), "payload")


def write_archive(pages: DataFrame, folder: str, least: int = LEAST, date: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives in the folder; the index, one row per record."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return cut(with_revisits(pages, least).mapInArrow(lean(lambda b: _write(b, folder, date, file_bytes)), INDEX))


def ranges(file: list[str], offset: np.ndarray, length: np.ndarray, gap: int, span: int) -> list[tuple[int, int]]:
    """(first, last) rows of each read; rows are sorted by file and offset."""
    out: list[tuple[int, int]] = []
    for i in range(len(file)):
        if out:
            lo, hi = out[-1]
            end = offset[hi] + length[hi]
            if file[i] == file[lo] and offset[i] - end <= gap and offset[i] + length[i] - offset[lo] <= span:
                out[-1] = lo, i
                continue
        out.append((i, i))
    return out


def _parsed(raw: bytes, payloads: bool) -> tuple:
    fields, block = unpacked(raw)
    http, _, payload = block.partition(_END)
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    page, refers = fields.get("x-page"), fields.get("x-refers-to-page")
    if fields["warc-type"] == "revisit":
        size = next(int(line.partition(":")[2]) for line in http.decode().split("\r\n") if line.lower().startswith("content-length:"))
        return page and int(page), fields.get("warc-target-uri"), "revisit", int(refers), size, digest, None, not payload
    own = hashlib.sha256(payload).hexdigest()
    return page and int(page), fields.get("warc-target-uri"), "response", None, len(payload), own, payload if payloads else None, own == digest


def _read(batches, folder: str, gap: int, span: int, payloads: bool):
    filesystem, path = _fs(folder)
    name, file = None, None
    for batch in batches:
        names, offset, length = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for lo, hi in ranges(names, offset, length, gap, span):
            if names[lo] != name:
                name, file = names[lo], filesystem.open_input_file(f"{path}/{names[lo]}")
            raw = file.read_at(int(offset[hi] + length[hi] - offset[lo]), int(offset[lo]))
            at = offset[lo : hi + 1] - offset[lo]
            rows = [_parsed(raw[a : a + n], payloads) for a, n in zip(at.tolist(), length[lo : hi + 1].tolist())]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "intact"])


def read_records(index: DataFrame, folder: str, payloads: bool = True, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records that these index rows stand for, each as often as it is listed; `intact` tells whether a response's payload has its record's digest."""
    held = index.agg(F.sum("length")).first()[0] or 0
    # tasks by the bytes that they will read, of which the index rows tell little
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK_BYTES))
    placed = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(lean(lambda b: _read(b, folder, gap, span, payloads)), RECORD)


def archived(pages: DataFrame, folder: str | None = None, least: int = LEAST, payloads: bool = False) -> DataFrame:
    """Write pages as archives and read every record back."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_records(write_archive(pages, folder, least), folder, payloads)
