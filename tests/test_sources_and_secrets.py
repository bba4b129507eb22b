"""Chunks of raw sources, references in them, and secrets looked for everywhere: literal rows, and plain search."""

import json
import random

from pyspark.sql import functions as F

from orrery.operators import checks, evidence, mapping, reindex, search


def plain_lines(text):
    """The line that each place of a text is on."""
    line, out, before = 1, [], ""
    for c in text:
        out.append(line)
        if c == "\r" or c == "\n" and before != "\r":
            line += 1
        before = c
    return [*out, line]


def test_literal_chunks():
    rows = lambda *a, **k: [p[1:] for p in evidence.pieces(*a, **k)]
    assert rows("") == [(0, 0, 0, 1, False, False, "")]
    assert rows("", mark=3) == [(3, 3, 3, 1, False, False, "")]
    assert rows("ab cd ef", size=4, overlap=1) == [(0, 5, 0, 1, False, False, "ab cd"), (3, 8, 5, 1, False, False, "cd ef")]
    assert rows("ab cd", size=2, overlap=0) == [(0, 2, 0, 1, False, False, "ab"), (2, 5, 2, 1, False, False, " cd")]
    assert rows("é仲", "utf-16-le", 2, size=1, overlap=0) == [(2, 6, 2, 1, False, False, "é仲")]  # one token, kept whole
    assert rows("a\r\nb\rc\nd", size=2, overlap=0) == [(0, 2, 0, 1, False, False, "a\r"), (2, 4, 2, 2, True, False, "\nb"), (4, 6, 4, 2, False, False, "\rc"), (6, 8, 6, 3, False, False, "\nd")]
    giant = "x" * 50
    assert rows(f"a {giant} b", size=8, overlap=4, longest=20) == [(0, 2, 0, 1, False, False, "a "), (2, 2, 2, 1, False, True, ""), (52, 54, 52, 1, False, False, " b")]
    assert rows(giant, size=8, overlap=4, longest=20) == [(0, 0, 0, 1, False, True, "")]
    assert rows(giant, size=8, overlap=4, longest=50) == [(0, 50, 0, 1, False, False, giant)]


def test_chunks_own_every_byte_once():
    rng = random.Random(6)
    for encoding, mark in (("utf-8", 3), ("utf-16-le", 2), ("utf-16-be", 0)):
        for size, overlap in ((1, 0), (16, 4), (64, 8), (4096, 256)):
            text = "".join(rng.choice("ab é仲😀\r\n. ") for _ in range(1500))
            data, lines = text.encode(encoding), plain_lines(text)
            end = mark
            for _, start, stop, owned, line, after_cr, gap, body in evidence.pieces(text, encoding, mark, size, overlap):
                before = data[: start - mark].decode(encoding)
                assert data[start - mark : stop - mark].decode(encoding) == body and owned == end and start <= owned < stop and not gap
                assert line == lines[len(before)] and after_cr == before.endswith("\r")
                end = stop
            assert end == mark + len(data)


def test_sources_that_do_not_decode(spark):
    text = "eins zwei\r\ndrei"
    rows = [
        (1, text.encode(), None), (2, b"\xef\xbb\xbf" + text.encode(), None), (3, b"\xff\xfe" + text.encode("utf-16-le"), None), (4, b"\xfe\xff" + text.encode("utf-16-be"), "utf-16-be"), (5, b"\xff\xfe" + text.encode("utf-16-le"), "utf-8"),
        (6, b"a\xffb", None), (7, None, None), (8, b"", None), (9, b"\xff\xfe\x00\x00", None), (10, b"x" * 40, None),
    ]
    df = spark.createDataFrame(rows, "id bigint, content binary, declared string").withColumn("coding", evidence.encoding_of(F.col("content"), F.col("declared")))
    got = {}
    for r in evidence.source_chunks(df, "id", "content", "coding", longest=30, size=16, overlap=2).orderBy("owner", "number").collect():
        got.setdefault(r.owner, []).append((r.byte_start, r.byte_end, r.gap, r.text))
    assert got[1] == [(0, 15, False, text)] and got[2] == [(3, 18, False, text)] and got[3] == got[4] == [(2, 32, False, text)]
    assert got[5] == got[6] == got[9] == [(0, 0, False, None)] and 7 not in got and got[8] == [(0, 0, False, "")] and got[10] == [(0, 0, True, "")]
    items = df.select(F.col("id").alias("owner"), "content", F.lit("text/plain").alias("media"), F.col("declared").alias("encoding"), F.lit(1).alias("generation"))
    states, units = reindex.rebuilt(items.where("owner in (1, 6)").unionByName(items.where("owner = 1").withColumns({"owner": F.lit(11).cast("bigint"), "content": F.lit(b"y" * ((1 << 20) + 1))})))
    assert sorted(map(tuple, states.collect())) == [(1, 1, "indexed", False), (6, 1, "index_failed", True), (11, 1, "indexed", True)]
    assert {r.owner for r in units.collect()} == {1, 11}


def test_references_in_sources(spark):
    rng, texts = random.Random(9), []
    for k in range(6):
        texts.append((k, "".join(rng.choice(["ab", " ", "é", "\r\n", "\r", "\n", "ab ab", ".", ""]) for _ in range(400))))
    coding = ["utf-8", "utf-16-le"]
    rows = [(k, t.encode(coding[k % 2]), coding[k % 2]) for k, t in texts]
    chunks = evidence.source_chunks(spark.createDataFrame(rows, "id bigint, content binary, coding string"), "id", "content", "coding", 64, 16)
    for phrase in ("ab", "ab ab", "é.ab", "ab\r\n"):
        want = set()
        for k, t in texts:
            lines, width = plain_lines(t), lambda a: len(a.encode(coding[k % 2]))  # noqa: B023
            want |= {(k, width(t[:a]), width(t[:z]), lines[a], lines[z - 1], t[a : a + 512].encode()[:512].decode(errors="ignore")) for a, z in search.places(t, phrase)}
        got = search.references(chunks, phrase, snippets=True).collect()
        assert len(got) == len(want) and {tuple(r)[:5] for r in got} == {w[:5] for w in want}
        full = {w[:3]: w[5] for w in want}
        assert all(full[tuple(r)[:3]].startswith(r.snippet[: len(phrase)]) for r in got)  # of the chunk, so as much as it has


def test_references_of_records_and_their_first(spark):
    record = {"a": {"b/c": "one two"}, "list": ["two", {"x": "no"}, "a\rtwo two"], "n": 2}
    rows = spark.createDataFrame([(1, json.dumps(record), "two"), (2, "no json", None), (3, json.dumps({"t": "two " * 50}), None)], "id bigint, p string, label string")
    found = search.references(search.record_units(rows, "id", "p", "label"), "two", snippets=True)
    got = sorted((r.owner, r.pointer, r.byte_start, r.line_start, r.snippet) for r in found.where("owner = 1").collect())
    assert got == [(1, "/label", 0, 1, "two"), (1, "/properties/a/b~1c", 4, 1, "two"), (1, "/properties/list/0", 0, 1, "two"), (1, "/properties/list/2", 2, 2, "two two"), (1, "/properties/list/2", 6, 2, "two")]
    few = search.first_references(found)
    assert {(r.owner, r.n, r["count"]) for r in few.groupBy("owner", "n").count().collect()} == {(1, 5, 5), (3, 50, 32)}
    assert max(r.byte_start for r in few.where("owner = 3").collect()) == 31 * 4
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()


def test_secrets_are_found_anywhere(spark):
    rng = random.Random(4)
    secrets = ["".join(rng.choice("abü") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    texts = [(k, "".join(rng.choice("abü ") for _ in range(60)).encode() + (b"\xff\x00" if k % 3 else b"")) for k in range(30)] + [(99, None)]
    told = spark.createDataFrame([(s,) for s in [*secrets, "", None, secrets[0]]], "secret string")
    held = spark.createDataFrame(texts, "id bigint, content binary")
    want = {(s, k): sum(t.startswith(s.encode(), i) for i in range(len(t))) for s in set(secrets) for k, t in texts if t and s.encode() in t}
    for size in (1 << 20, 30):  # one automaton, several
        got = {(r.secret, r.found_in): r.hits for r in mapping.leaks_anywhere(told, held, part_bytes=size).collect()}
        assert got == want
    assert mapping.leaks_anywhere(told.limit(0), held).count() == 0
    # a secret of one record in the document of another
    rows = spark.createDataFrame([(1, '{"token": "s3cret"}'), (2, '{"note": "it was s3cret"}')], "id bigint, d string")
    cleaned = mapping.redacted(rows, "id", "d", ["token"])
    assert mapping.leaks(cleaned).count() == 0
    anywhere = mapping.leaks_anywhere(cleaned.select(F.explode("secrets").alias("secret")), cleaned.withColumnRenamed("owner", "id"), "document")
    assert [tuple(r) for r in anywhere.collect()] == [("s3cret", 2, 1)]


def test_contacts(spark):
    cases = [
        ("package", "email_address", "maintainer", None, True), ("package", "email_address", "admin", None, False), ("package", "phone", "security", None, False), ("organization", "phone", "maintainer", None, False), ("whois_registration", "phone", "tech", None, True),
        ("whois_registration", "phone", "abuse", None, False), ("domain", "phone", "tech", None, False), ("subdomain", "email_address", "abuse", None, True), ("organization", "phone", "admin", None, True), ("domain", "endpoint", "iodef", "POST", True),
        ("domain", "endpoint", "iodef", "GET", False), ("domain", "endpoint", "abuse", "POST", False), ("domain", "phone", "iodef", None, False), ("domain", "email_address", "iodef", None, True), ("domain", "endpoint", "iodef", None, False),
    ]
    df = spark.createDataFrame(cases, "s string, t string, r string, m string, ok boolean")
    said = checks.contact_role(F.col("s"), F.col("t"), F.col("r"), F.col("m"))
    assert df.where(said.isNull() != F.col("ok")).collect() == []
