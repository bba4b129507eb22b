"""Product quantisation, whitening and archives: against plain versions, on odd rows, and in their parts."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import queries, quantize, warc, whitening
from tests.llm.helpers import EXTRA

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id bigint, embedding array<double>, label int"
PAGES = "page_id bigint, url string, html string"


def table(spark, rows, schema=VECTORS):
    names = {c.split()[0] for c in schema.split(", ")}
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in EXTRA if c not in names})


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """vec_id -> (code, error, label_error), and the codebooks, in plain integers; rows are sorted by vec_id."""
    whole = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows]
    dim = len(whole[0][2])
    cut = [k * dim // parts for k in range(parts + 1)]
    pieces = [[v[a:z] for _, _, v in whole] for a, z in zip(cut, cut[1:])]
    books = [p[:entries] for p in pieces]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        new = []
        for book, own in zip(books, pieces):
            at = [nearest(book, x)[1] for x in own]
            took = [[x for x, k in zip(own, at) if k == e] for e in range(len(book))]
            new.append([[sum(c) // len(t) for c in zip(*t)] if t else old for t, old in zip(took, book)])
        books = new
    found = [[nearest(book, x) for x in own] for book, own in zip(books, pieces)]
    error = [sum(f[r][0] for f in found) for r in range(len(whole))]
    by = {}
    for (_, label, _), e in zip(whole, error):
        by[label] = by.get(label, 0) + e
    return sorted((i, bytes(f[r][1] for f in found).hex(), error[r], by[label]) for r, (i, label, _) in enumerate(whole)), books


@pytest.mark.parametrize(("dim", "spread"), [(8, 1.0), (10, 0.01), (16, 30.0)])
def test_quantized_is_the_plain_algorithm(spark, dim, spread):
    rng = random.Random(dim)
    rows = [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.choice([1, 2, None])) for i in range(120)]
    rows += [(200 + i, rows[7][1], 1) for i in range(40)]  # ties and copies
    for entries in (3, 70, 256):
        want, books = plain_codes(rows, entries=entries)
        coded, made = quantize.quantized(table(spark, rows).repartition(5), entries=entries)
        assert sorted((r.vec_id, r.code.hex(), r.error, r.label_error) for r in coded.collect()) == want
        assert [b.tolist() for b in made] == books
        assert quantize.digest(made) == hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 70), st.integers(1, 9), st.integers(1, 40), st.sampled_from([1, 3, 50, 100000]), st.integers(0, 10**6))
def test_slices_find_the_nearest_entry(entries, width, n, spread, seed):
    rng = np.random.default_rng(seed)
    book, queries_ = rng.integers(-spread, spread + 1, (entries, width)), rng.integers(-3 * spread, 3 * spread + 1, (n, width))
    entry, distance = quantize.Slices(book).nearest(queries_)
    apart = ((queries_[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


def test_cubes_hold_what_lies_within_the_radius():
    rng = np.random.default_rng(2)
    book, x, radius = rng.integers(-50, 50, (130, 5)), rng.integers(-60, 60, (40, 5)), rng.integers(0, 60, 40)
    mask = quantize.Slices(book).cube(x, radius)
    inside = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")
    assert (inside[:, :130] == (np.abs(x[:, None] - book[None]).max(axis=2) <= radius[:, None])).all() and not inside[:, 130:].any()


ODD = [
    (5, [1.0, 2.0, 3.0, 4.0], 1), (3, [1.0, 2.0, 3.0, 4.0], None), (3, [1.0, 2.0, 3.0, 4.0], None), (3, [0.0, 0.0, 0.0, 0.0], None), (None, [-1.5, 0.0, 2.25, 9.0], 2),
    (7, None, 1), (8, [1.0, None, 3.0, 4.0], 1), (9, [NAN, 0.0, 0.0, 0.0], 1), (10, [INF, 0.0, 0.0, 0.0], 1), (11, [], 1), (12, [1.0, 2.0], 1), (-(1 << 63), [4.0, 3.0, 2.0, -1.0], 2),
]
GOOD = [r for r in ODD if r[1] and len(r[1]) == 4 and all(x is not None and math.isfinite(x) for x in r[1])]


def test_quantized_odd_rows(spark):
    order = sorted(GOOD, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want, books = plain_codes([(i if i is not None else 1 << 62, v, label) for i, v, label in order])
    coded, made = quantize.quantized(table(spark, ODD))
    assert sorted((r.vec_id if r.vec_id is not None else 1 << 62, r.code.hex(), r.error, r.label_error) for r in coded.collect()) == want
    assert [b.tolist() for b in made] == books
    assert quantize.quantized(table(spark, ODD[5:11]).where("vec_id < 11"))[0].count() == 0
    with pytest.raises(Exception, match="64-bit"):
        quantize.quantized(table(spark, [(1, [1e30] * 4, 1)]))


def plain_white(rows, most=32):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[n * a - s for a, s in zip(v, sums)] for v in x], dtype=object)
    cov = (centred.T @ centred).astype(np.float64) / float(n) ** 3
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    return [int((c * c).sum()) for c in centred], values[order], axes[:, order], (centred.astype(np.float64) / n) @ axes[:, order], np.trace(cov)


def test_whitened_is_the_plain_algorithm(spark):
    rng = np.random.default_rng(3)
    mixed = rng.standard_normal((40, 40)) * np.linspace(0.2, 2, 40)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(rng.standard_normal((700, 40)) @ mixed)]
    deviation, values, axes, scores, trace = plain_white(rows)
    got = {(r.vec_id, r.component): r for r in whitening.whitened(table(spark, rows).repartition(6)).collect()}
    assert len(got) == 700 * 32
    assert all(got[i, 1].deviation == d and got[i, 1].n == 700 for i, d in enumerate(deviation))
    white = np.array([[got[i, k].whitened for k in range(1, 33)] for i in range(700)])
    want = scores / np.sqrt(values)
    want *= np.sign((want * white).sum(axis=0))
    assert np.abs(white - want).max() < 1e-8
    assert all(abs(got[0, k + 1].explained * trace / values[k] - 1) < 1e-9 for k in range(32))
    assert np.abs(white.T @ white / 700 - np.eye(32)).max() < 1e-10 > got[0, 1].identity_error


def residual(a, x):
    return float(np.abs(x.T @ x - np.eye(len(a))).max()), float(np.abs(x.T @ a @ x - np.diag(np.diag(x.T @ a @ x))).max())


@pytest.mark.parametrize("values", [np.linspace(1, 2, 30), np.r_[np.full(10, 1.0), np.linspace(2, 3, 20)], np.r_[1 + 1e-9 * np.arange(15), 5 + 1e-12 * np.arange(15)], np.geomspace(1, 1e-9, 30), np.zeros(30)])
def test_refined_solves_clusters(values):
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((30, 30)))[0].astype(np.longdouble)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined(a, np.linalg.eigh(a.astype(np.float32))[1])
    off, away = residual(a, x)
    assert off < 1e-15 and away < 1e-15 * max(1, values.max()) and (np.diff(found) <= 1e-15).all()
    assert np.abs(np.sort(found) - np.sort(values)).max() < 1e-15 * max(1, values.max())


def test_whitened_odd_rows(spark):
    got = whitening.whitened(table(spark, ODD)).collect()
    assert len(got) == 4 * len(GOOD) and {r.n for r in got} == {len(GOOD)} and {r.component for r in got} == {1, 2, 3, 4}
    deviation = plain_white(GOOD)[0]
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert whitening.whitened(table(spark, ODD[5:11]).where("vec_id < 11")).count() == 0
    same = whitening.whitened(table(spark, [(i, [1.0, 2.0, 3.0], 1) for i in range(4)])).collect()
    assert len(same) == 12 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in same} == {(None, 0.0, 0.0, 0)}
    flat = whitening.whitened(table(spark, [(i, [float(i), 2.0 * i, 3.0], 1) for i in range(9)])).collect()
    assert {r.whitened is None for r in flat if r.component > 1} == {True} and abs(next(r.explained for r in flat if r.component == 1) - 1) < 1e-12
    far = [(1, [1e9, 0.0], 1), (2, [-1e9, 0.0], 1), (3, [1e9, 1.0], 1)]
    exact = plain_white(far)[0]
    assert sorted(str(r.deviation) for r in whitening.whitened(table(spark, far)).where("component = 1").collect()) == sorted(str(d if d < 1 << 63 else None) for d in exact)


LONG = "<p>" + "x" * 120
PAGE_ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (2, "http://a/2", LONG), (3, None, LONG), (None, "http://n", LONG), (4, "http://ü/ b\r\nX-Page: 9", "short"), (5, "http://a/5", "short"), (6, "http://a/6", None),
    (7, "http://a/7", ""), (8, "", "é" * 50), (9, "http://a/9", "é" * 50), (None, "http://z", "z" * 200), (None, "http://z", "z" * 200), (10, "http://big", "0123456789abcdef" * 200000),
]


def test_archive_round_trip(spark, tmp_path):
    pages = table(spark, PAGE_ROWS, PAGES)
    index = warc.write_archive(pages.repartition(3), str(tmp_path), file_bytes=400)
    back = warc.read_records(index, str(tmp_path)).collect()
    assert len(back) == len(PAGE_ROWS) and all(r.intact for r in back)
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    want = []
    for page, _, html in PAGE_ROWS:
        body = (html or "").encode()
        first = min((p for p, _, h in PAGE_ROWS if h == html and p is not None), default=None) if len(body) >= 100 else None
        want.append((page, "response" if first in (None, page) else "revisit", None if first in (None, page) else first, len(body), hashlib.sha256(body).hexdigest()))
    assert sorted(map(key, ((r.page_id, r.record_type, r.refers_to) for r in back))) == sorted(map(key, (w[:3] for w in want)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in back) == sorted((str(w[0]), *w[3:]) for w in want)
    assert {bytes(r.payload) for r in back if r.payload} == {(h or "").encode() for _, _, h in PAGE_ROWS if h}
    assert {r.page_id: r.url for r in back}[4] == "http://%C3%BC/%20b%0D%0AX-Page:%209" and {r.page_id: r.url for r in back}[3] is None
    some = index.where("url = 'http://a/5' or page_id = 10")
    assert sorted(r.page_id for r in warc.read_records(some, str(tmp_path)).collect()) == [5, 10]
    assert warc.archived(pages.limit(0)).count() == 0


def test_files_are_archives_of_their_own(spark, tmp_path):
    """A reader that knows nothing of the index finds the same records: members one after the other, each with its length."""
    index = warc.write_archive(table(spark, PAGE_ROWS, PAGES).coalesce(1), str(tmp_path), date="2020-01-01T00:00:00Z").collect()
    (file,) = {r.file for r in index}
    raw, at, found = (tmp_path / file).read_bytes(), 0, []
    while at < len(raw):
        member = zlib.decompressobj(31)
        data = member.decompress(raw[at:])
        size = len(raw) - at - len(member.unused_data)
        fields, block = warc.unpacked(raw[at : at + size])
        assert data.startswith(b"WARC/1.1\r\n") and fields["warc-date"] == "2020-01-01T00:00:00Z"
        found.append((at, size, fields))
        at += size
    assert [f["warc-type"] for *_, f in found][0] == "warcinfo" and len(found) == len(PAGE_ROWS) + 1
    assert {(a, n) for a, n, _ in found[1:]} == {(r.offset, r.length) for r in index}
    ids = {f["warc-record-id"] for *_, f in found if f["warc-type"] == "response"}
    assert all(f["warc-refers-to"] in ids for *_, f in found if f["warc-type"] == "revisit")


def test_reads_are_coalesced():
    offset, length = np.array([0, 100, 250, 5000, 0, 10, 100000]), np.array([100, 100, 50, 10, 10, 5, 90000])
    files = ["a", "a", "a", "a", "b", "b", "b"]
    assert warc.ranges(files, offset, length, 60, 10000) == [(0, 2), (3, 3), (4, 5), (6, 6)]
    assert warc.ranges(files, offset, length, 10**6, 250) == [(0, 1), (2, 2), (3, 3), (4, 5), (6, 6)]
    assert warc.ranges([], offset[:0], length[:0], 1, 1) == []


@pytest.mark.parametrize("name", ["op11_quantize", "op12_warc"])
def test_query_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, want.project(", ".join(order)).fetchall()))
