"""Nulls, empties, ties, repeated rows, long texts, clashing columns and empty tables, for every operator."""

import random
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import chat, decontaminate, embeddings, lines, minhash, mixing, pii, quality, samples, tokens, toxicity
from tests.llm.helpers import DOCS, EXTRA, ODD, docs, words

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD, extra=True)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (4, 0, 0)], LABELS).withColumns({c: F.lit(1) for c in EXTRA})


def test_near_duplicates(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.class_id) for r in rows} == {(i, i) for i, _ in ODD}
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_without_ids(spark):
    rows = minhash.near_duplicates(docs(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (None, "q r s t u v")])).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in rows if r.doc_id) == [(7, 7, True)]
    assert {(r.class_id, r.kept) for r in rows if r.doc_id is None} == {(7, False), (None, True)}


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "one TWO three"), (2, None), (3, ""), (None, "h i j"), (1, "one two three")], "item_id bigint, text string")
    rows = decontaminate.contamination(odd, bench).collect()
    assert sorted((r.doc_id, r.n_words) for r in rows) == sorted((i, len(words(t))) for i, t in ODD)
    assert [r.item_ids for r in rows if r.doc_id == 4] == [[1], [1]]
    assert [(r.n_hit, r.item_ids) for r in rows if r.doc_id == 5] == [(3, [])]
    assert decontaminate.contamination(none, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(odd, bench.limit(0)).collect()} == {0}


@pytest.mark.parametrize("score", [quality.quality, toxicity.toxicity])
def test_scores(score, odd, none, labels):
    rows = score(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert score(none, labels).count() == 0
    assert {r.score for r in score(odd, labels.limit(0)).collect()} == {0.0}


def test_sample_of_a_rare_class(spark):
    rows = [(i, f"word{i} " * 25) for i in range(20000)]
    marks = spark.createDataFrame([(i, 1, int(i % 1000 == 0)) for i, _ in rows], LABELS)
    y = samples.labelled(docs(spark, rows), marks, "toxic", text_bytes=100000).column("y").to_pylist()
    assert sum(y) == marks.where("toxic = 1").where(~samples.held_out()).count() and len(y) > 300


def test_sample_skips_an_oversized_text(spark):
    rows, order = [(i, "a b c 1") for i in range(50)], F.xxhash64("doc_id", F.lit(5))
    first = spark.range(50).withColumnRenamed("id", "doc_id").where(~samples.held_out()).orderBy(order).first().doc_id
    marks = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], LABELS)
    usual = samples.labelled(docs(spark, rows), marks, "toxic", text_bytes=5000).num_rows
    rows[first] = (first, "a b c 1 " * 1000)
    assert samples.labelled(docs(spark, rows), marks, "toxic", text_bytes=5000).num_rows == usual - 1 > 30


T, NEAR, U = " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(201)), "quite another text of some words"


def test_one_of_each_by_row(spark):
    texts = lambda rows: sorted(r.text for r in minhash.one_of_each(docs(spark, rows)).collect())
    assert texts([(1, T), (2, NEAR), (2, U)]) == sorted([T, U])
    assert texts([(1, T), (1, T), (None, U), (None, U), (None, NEAR)]) == sorted([T, U])


def test_contaminated_rows_go_by_row(spark):
    bench = spark.createDataFrame([(1, T)], "item_id bigint, text string")
    rows = decontaminate.clean_of(docs(spark, [(None, T), (1, T), (1, U), (2, U), (2, U), (3, None)]), bench).collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == [(1, U), (2, U), (2, U), (3, "")]


def test_toxic_rows_go_by_row(spark, monkeypatch):
    class Fixed:
        def score(self, block):
            return (block.words().count > 100) * 1.0, None, None

    monkeypatch.setattr(toxicity, "_fitted", lambda docs, labels: SimpleNamespace(value=Fixed()))
    rows = toxicity.acceptable(docs(spark, [(None, T), (1, T), (1, U), (2, U), (2, U)]), None).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, U), (2, U), (2, U)]


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, odd, none, labels, number, tmp_path):
    import corpus_pipeline

    (labels.limit(0) if number == 0 else labels).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, T), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[number][1]
    more = docs(spark, [(None, T), (None, U), (4, U), (4, "one two three"), (None, None)], extra=True)
    out = stage(spark, odd.unionByName(more), str(tmp_path))
    rows = out.collect()
    if number < 4:
        assert out.columns == odd.columns and {r.doc_id for r in rows} <= {None, *(i for i, _ in ODD)}
        assert len(rows) == {0: 15, 1: 12, 2: 14}.get(number, len(rows))
    else:
        assert sorted(out.columns) == ["doc_id", "ids_crc32", "n_tokens", "start"] and len(rows) == 15
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_mixing(odd, none, labels):
    rows = mixing.rates(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r.rate >= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.rates(none, labels).count() == 0
    assert {round(r.p_clean, 6) for r in mixing.rates(odd, labels.limit(0)).collect()} == {1.0}
    assert mixing.mixed(odd, labels).columns == odd.columns


def test_lines(odd, none):
    rows = lines.line_classes(odd).collect()
    assert sorted(r.n_places for r in rows if r.doc_id == 4) == [2, 2]
    assert not [r for r in rows if r.doc_id in (1, 2, 3)]
    assert lines.line_classes(none).count() == 0
    assert lines.without_repeats(odd).columns == odd.columns


def test_tokens(spark, odd, none):
    import public_tokenizers

    file = public_tokenizers.path(tokens.VOCABULARY)
    rows = tokens.token_table(odd, file).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in ODD)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert tokens.token_table(none, file).count() == 0
    named = tokens.token_table(docs(spark, [(None, "a"), (1, "b"), (None, "c")]), file).collect()
    assert sorted((r.doc_id is None, r.start) for r in named) == [(False, 4), (True, 0), (True, 2)]


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (11, [], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({c: F.lit(1) for c in EXTRA if c != "label"})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(table).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, False), **{k: (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)}}
    assert embeddings.near_vectors(table.limit(0)).count() == 0


def test_personal_data(odd, none):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == len(ODD) and all(r.base == [] for r in rows)
    assert pii.personal_data(none).count() == 0


def test_personal_data_beyond_the_patterns(spark):
    rng = random.Random(4)
    plain = ["alpha beta gamma", "some words here", "und noch etwas mehr", "Version 2.4 of 1999"]
    rows, planted = [], []
    for i in range(200):
        kind, said = pii._spellings(rng)
        text = f"{rng.choice(plain)} {said} {rng.choice(plain)}"
        rows.append((i, text))
        planted.append((i, text.index(said), text.index(said) + len(said)))
    rows += [(1000 + i, f"{a} {b}") for i, (a, b) in enumerate(zip(plain * 5, plain[::-1] * 5))]
    got = {r.doc_id: [(s.start, s.end) for s in r.base + r.added] for r in pii.personal_data(docs(spark, rows)).collect()}
    caught = sum(any(a < z and s < e for s, e in got[i]) for i, a, z in planted)
    assert caught >= 0.9 * len(planted)
    assert [(i, got[i]) for i in got if i >= 1000 and got[i]] == []


def test_long_runs_take_linear_time():
    began = time.process_time()
    for text in ("1" * 1000000, "a" * 1000000, "a" * 500000 + "@" + "b" * 500000, "Ab1+/" * 200000, "1.1.1" * 200000, "+1 " * 300000, "a@" * 400000):
        pii.base_spans(text)
    assert time.process_time() - began < 15
    assert pii.base_spans("a@b.c_d@e.f x@y") == [(0, 0, 5), (0, 5, 11)]
    assert pii.base_spans("1.2.3.4.5.6.7.8 x1.2.3.4") == [(1, 0, 7), (1, 8, 15), (1, 17, 24)]


def test_chat(spark):
    log = chat.events_of_turns(spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", "<&[\n|end|>"), (None, 0, "user", "x"), (1, 1, "assistant", "<&[\n|end|>")], "conv_id bigint, turn bigint, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(log)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("", ""), ("assistant", "<&[\n|end|>"), ("assistant", "<&[\n|end|>")]
    assert back[1].loss_texts == ["<&[\n|end|>"] * 2 and [t.text for t in back[None].turns] == ["x"]
    assert chat.formatted(log.limit(0)).count() == 0


LOW, HIGH = -(1 << 63), (1 << 63) - 1
SAME = "the very same line of some words\nfoo is unrelated to all others"
IDS = [(None, SAME), (LOW, SAME), (HIGH, SAME), (2, SAME), (2, "bar is unrelated to all others\nthe very same line of some words"), (2, SAME), (None, "a b c d e f"), (None, "a b c d e f"), (LOW, "g h"), (LOW, None)]


def test_extreme_and_shared_ids(spark, labels):
    import public_tokenizers

    told = docs(spark, IDS, extra=True).repartition(3)
    want = sorted(map(str, (i for i, _ in IDS)))
    bench = spark.createDataFrame([(LOW, SAME), (None, SAME)], "item_id bigint, text string")
    found = [
        minhash.near_duplicates(told), decontaminate.contamination(told, bench), quality.quality(told, labels), mixing.rates(told, labels),
        tokens.token_table(told, public_tokenizers.path(tokens.VOCABULARY)), toxicity.toxicity(told, labels), pii.personal_data(told),
    ]
    for out in found:
        assert sorted(str(r.doc_id) for r in out.collect()) == want
    classes = minhash.near_duplicates(told).where("class_id is null or class_id = doc_id").collect()
    assert {r.doc_id for r in classes} <= {None, LOW, HIGH, 2}
    vectors = spark.createDataFrame([(None, [1.0, 0.0], 1), (LOW, [1.0, 0.0], 1), (HIGH, [1.0, 0.01], 1)], "vec_id bigint, embedding array<float>, label int")
    assert {(r.vec_id, r.component_id, r.n_links) for r in embeddings.near_vectors(vectors).collect()} == {(None, None, 0), (LOW, LOW, 1), (HIGH, LOW, 1)}
    log = chat.events_of_turns(spark.createDataFrame([(LOW, 0, "user", "x"), (None, 0, "user", "x"), (HIGH, LOW, "user", "x")], "conv_id bigint, turn bigint, role string, text string"))
    assert {r.conv_id for r in chat.read_back(chat.formatted(log)).collect()} == {None, LOW, HIGH}


def test_lines_of_rows_that_share_an_id(spark):
    told = docs(spark, IDS, extra=True).repartition(3)
    rows = lines.line_classes(told).collect()
    same = [r for r in rows if r.n_places == 5]
    assert len(same) == 5 and [(r.doc_id, r.class_doc_id) for r in same if r.kept] == [(None, None)]
    assert [r.doc_id for r in rows if r.kept].count(2) == 1 and sum(r.kept for r in rows) == 5
    left = sorted((str(r.doc_id), r.text or "") for r in lines.without_repeats(told).collect())
    assert len(left) == len(IDS)
    text = "\n".join(t for _, t in left)
    assert all(text.count(line) == 1 for line in ("the very same line", "foo is unrelated", "bar is unrelated", "a b c d e f", "g h"))
    low = docs(spark, [(LOW, SAME), (5, SAME)])
    assert sorted((r.doc_id, r.class_doc_id, r.kept) for r in lines.line_classes(low).collect()) == [(LOW, LOW, True)] * 2 + [(5, LOW, False)] * 2


def test_token_keys(spark):
    import public_tokenizers

    file = public_tokenizers.path(tokens.VOCABULARY)
    told = docs(spark, [(None, "a"), (LOW, "b b"), (None, "c c c"), (HIGH, "d")])
    rows = tokens.token_table(told, file).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens) for r in rows) == sorted([("None", 0, 2), ("None", 2, 4), (str(LOW), 6, 3), (str(HIGH), 9, 2)])
    with pytest.raises(ValueError, match="once"):
        tokens.Index.build(np.array([5, 5]))


def test_a_frequent_line_gives_its_keys_once_a_task():
    rng = random.Random(1)
    hot = "a line that stands everywhere in the corpus"
    texts = ["\n".join([hot] + ["".join(rng.choice("abcdefghij") for _ in range(30)) for _ in range(200)]) for _ in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 10])], ["text"]) for k in range(0, 300, 10)]
    every = [x for b in lines.segment_keys(batches, 2, 20) for x in b.column("line_id").to_pylist()]
    few = [x for b in lines.segment_keys(batches, 2, 20, remember=8000) for x in b.column("line_id").to_pylist()]
    counts, again = Counter(every), Counter(few)
    assert set(counts) == set(again) and max(counts.values()) <= 24
    top = lines.xxh3_64_intdigest(hot.encode())
    top -= (1 << 64) * (top >= 1 << 63)
    assert again[top] <= 24 * 16 and counts[top] <= 24
