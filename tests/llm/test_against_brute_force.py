"""Every operator against a plain version of its rule."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import buckets, chat, components, crf, lines, minhash, mixing, queries, tokens
from orrery.llm.common import table
from orrery.llm.decontaminate import contamination
from orrery.llm.textblocks import Hashes, blocks
from tests.llm.helpers import docs, shingles, union_find, words


def mutated(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(5000)}"
    return out


@pytest.fixture(scope="module")
def families(spark):
    """Groups of near copies from loose to tight, and strangers."""
    rng, rows = random.Random(5), []
    for _ in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 80, 200)))]
        rows += [" ".join(mutated(rng, base, rng.randrange(0, 1 + len(base) // 20))) for _ in range(60)]
    rows += [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return list(enumerate(rows))


def test_near_duplicates_are_components_of_similar_pairs(spark, families):
    sets = {i: shingles(t) for i, t in families}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    wanted = union_find(pairs, sets)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, families)).collect()}
    assert got == wanted and len(set(wanted.values())) > 60


def test_repeated_own_lines_hide_no_pair(spark):
    rng, rows = random.Random(8), []
    for _ in range(60):
        base = " ".join(f"w{rng.randrange(100000)}" for _ in range(140))
        for _ in range(2):
            own = " ".join(f"w{rng.randrange(100000)}" for _ in range(10))
            rows.append("\n".join([own] * 20 + [base]))
    rows = list(enumerate(rows))
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert len(pairs) == 60
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == union_find(pairs, sets)


def test_prob_min_hash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    sig = minhash.prob_min_hash(np.repeat([0, 1], 300), np.concatenate([a, b]), np.ones(600), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 200 / 400) < 0.05


def morse(n, x="a", y="b"):
    """A string that differs from its own complement everywhere, and whose polynomial modulo a power of two does not."""
    return x if not n else morse(n - 1, x, y) + morse(n - 1, y, x)


def test_substring_hashes():
    text = f"{morse(11)} {morse(11, 'b', 'a')} {morse(11)}".encode()
    at = np.array([0, 2049, 4098])
    first, second, third = Hashes(np.frombuffer(text, np.uint8)).of(at, at + 2048)
    assert first == third != second
    data = np.random.default_rng(1).integers(0, 256, (1 << 23) + 5000, dtype=np.uint8)
    data[-2000:] = data[:2000]
    n = len(data)
    whole = Hashes(data)
    one = whole.of(np.array([0, n - 2000, 10, (1 << 23) - 7]), np.array([2000, n, 20, (1 << 23) + 9]))
    assert one[0] == one[1] and one[2] == Hashes(data[10:20]).of(np.array([0]), np.array([10]))[0]
    assert one[3] == Hashes(data[(1 << 23) - 7 : (1 << 23) + 9]).of(np.array([0]), np.array([16]))[0]


def test_lines_that_only_look_alike(spark):
    rows = [(1, morse(10)), (2, morse(10, "b", "a")), (3, morse(10))]
    got = {r.doc_id: (r.n_places, r.kept) for r in lines.line_classes(docs(spark, rows)).collect()}
    assert got == {1: (2, True), 2: (1, True), 3: (2, False)}


def test_repeated_words_stay_cheap(spark):
    bench = spark.createDataFrame([(1, "same " * 4000), (2, "same " * 20), (3, "a b " * 500)], "item_id bigint, text string")
    rows = contamination(docs(spark, [(1, "same " * 20000), (2, "a b " * 9000), (3, "same " * 12)]), bench).collect()
    assert sorted((r.doc_id, r.n_hit, r.item_ids) for r in rows) == [(1, 20000, [1, 2]), (2, 18000, [3]), (3, 0, [])]


def test_decontamination_against_all_windows(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    windows = {}
    for r in b.collect():
        w = words(r.text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(r.item_id)
    sizes = {len(w) for w in windows}
    for chunk in (1 << 20, 1500):
        got = {r.doc_id: r for r in contamination(d, b, chunk_bytes=chunk).collect()}
        for r in d.collect():
            w, hit, items = words(r.text), set(), set()
            for n in sizes:
                for k in range(len(w) - n + 1):
                    if (found := windows.get(tuple(w[k : k + n]))) is not None:
                        hit.update(range(k, k + n))
                        items |= found
            own = got[r.doc_id]
            assert (own.n_words, own.n_hit, own.item_ids) == (len(w), len(hit), sorted(items))


def test_scores_separate_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    for query, column, least in ((queries.op3_quality, "quality", 0.93), (queries.op8_toxicity, "toxic", 0.93)):
        rows = query(spark, sf).join(labels, "doc_id").where("held_out").select("predicted", column).collect()
        assert np.mean([r.predicted == r[column] for r in rows]) >= least


def test_field_learns_and_decodes():
    rng = np.random.default_rng(2)
    state = (rng.random(4000) < 0.2).astype(np.int64)
    state[1:] |= state[:-1] & (rng.random(3999) < 0.5)
    ids = np.where(rng.random(4000) < 0.9, state, 1 - state)[:, None]
    start, length = crf.sequences(np.arange(4000) % 20 == 0)
    chain = crf.Chain(2, 2).fit(ids, state, start, length, rounds=60)
    assert (chain.decode(chain.scores(ids), start, length) == state).mean() > 0.88
    chance = chain.marginals(chain.scores(ids), start, length)[0]
    assert np.allclose(chance.sum(axis=1), 1)


def test_marginals_and_path_against_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    chain = crf.Chain(1, 3)
    chain.transition, chain.opening = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(4, 3))
    weigh = lambda p: chain.opening[p[0]] + sum(scores[t, p[t]] for t in range(4)) + sum(chain.transition[p[t], p[t + 1]] for t in range(3))
    paths = list(itertools.product(range(3), repeat=4))
    mass = np.exp([weigh(p) for p in paths])
    chance = np.array([[sum(m for m, p in zip(mass, paths) if p[t] == s) for s in range(3)] for t in range(4)]) / mass.sum()
    one = np.array([0]), np.array([4])
    got, _, log = chain.marginals(scores, *one)
    assert np.allclose(got, chance) and np.isclose(log, np.log(mass.sum()))
    assert tuple(chain.decode(scores, *one)) == paths[int(mass.argmax())]


def plain_rates(n, p, goal, rounds=400000):
    """Nonnegative rates of least squares by projected gradient, document by document, started from 1."""
    share, r = n / n.sum(), np.ones(len(n))
    step = 1 / (share @ p).max()
    for _ in range(rounds):
        new = np.maximum(0, r - step * (p @ ((share * r) @ p - goal)))
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return r


@pytest.mark.parametrize("goal", [[0.7, 0.2, 0.1], [0.9775, 0.115, 0.0575], [0.2, 0.9, 0.0], [1.0, 0.05, 0.001]])
def test_rates_against_projected_gradient(spark, goal):
    rng = np.random.default_rng(11)
    p = rng.dirichlet([2.0, 0.6, 0.2], 300)
    n = rng.integers(1, 400, 300).astype(float)
    placed = spark.createDataFrame([(int(i), int(m), q.tolist()) for i, (m, q) in enumerate(zip(n, p))], "doc_id bigint, __n bigint, __p array<double>")
    rated = mixing.with_rates(placed, dict(zip(mixing.DOMAINS, goal)), 1.0).orderBy("doc_id").collect()
    r = np.array([x["__rate"] for x in rated])
    goal, share = np.array(goal), n / n.sum()
    best = plain_rates(n, p, goal)
    missed = lambda r: np.square((share * r) @ p - goal).sum()
    whole = lambda r: missed(r) + mixing.PULL * (share @ (r - 1) ** 2)
    assert r.min() >= 0 and whole(r) <= whole(best) + 1e-9
    if missed(best) < 1e-12:
        assert np.allclose((share * r) @ p, goal, atol=1e-4)
        assert share @ (r - 1) ** 2 <= share @ (best - 1) ** 2 + 1e-6  # no other rates are as near to 1


def test_rates_of_a_rare_domain_meet_their_target(spark):
    rows = [(1, 900, [0.98, 0.02, 0.0]), (2, 95, [0.05, 0.95, 0.0]), (3, 5, [0.0, 0.0, 1.0]), (4, 0, [1.0, 0.0, 0.0])]
    placed = spark.createDataFrame(rows, "doc_id bigint, __n bigint, __p array<double>")
    rates = [r["__rate"] for r in mixing.with_rates(placed).orderBy("doc_id").collect()]
    reached = [sum(n / 1000 * r * p[k] for r, (_, n, p) in zip(rates, rows)) for k in range(3)]
    assert np.allclose(reached, [t * mixing.EPOCHS for t in mixing.TARGETS.values()], atol=1e-4) and min(rates) >= 0 and rates[2] > 11
    assert mixing.with_rates(placed).first()["__residual"] <= mixing.RESIDUAL
    steps, left = mixing.fitted_steps(placed, [0.9, 0.1, 0.0], rounds=0)
    assert steps == [0.0, 0.0, 0.0] and left > 0.01  # stopped before it was there


def test_mass_below_a_grid_step_counts(spark):
    rows = [(i, 100, [0.85 - t, 0.15, t]) for i, t in enumerate([0.0005, 0.0095] * 25)] + [(50, 100, [0.3, 0.0, 0.7])]
    targets = {"rough": 0.10, "toxic": 0.05}
    placed = spark.createDataFrame(rows, "doc_id bigint, __n bigint, __p array<double>")
    rated = mixing.with_rates(placed, targets).select("doc_id", F.col("__n").alias("n_tokens"), *[F.col("__p")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)], F.col("__rate").alias("rate"))
    wanted, got = mixing.reached(rated, targets)["toxic"]
    assert abs(wanted - got) < 1e-3


def test_shards_round_trip(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY)), 0
    got = {r.doc_id: r for r in queries.op5_tokens(spark, sf).collect()}
    for r in table(spark, sf, "documents").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, tokens.END]
        own = got.pop(r.doc_id)
        assert (own.start, own.n_tokens, own.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_pieces_encode_as_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path(tokens.VOCABULARY)
    plain, encoder = Tokenizer.from_file(file), tokens.Encoder(file)
    rng = random.Random(12)
    odd = ["a", "Bc", " ", "  ", "\n", "\u00a0", "\u3000", "\u2009", "\u2028", "\u1680", "\u0085", "“q”", "カナ", "你好", "é", "'s", "1", "<|", "\x1c", "<|endoftext|>"]
    texts = ["a  b", " a b ", "a \n b c", "a b <|endoftext|> c<|endoftext|>", "a b c", "a\x1c b \x1cc", "don't we'll  x 's", "", " ", "é 你好 1 23 a", "a <| b", "", ""]
    texts += [" ".join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(400)]
    wanted = [[*plain.encode(text, add_special_tokens=False).ids, tokens.END] for text in texts]
    for limit in (1 << 20, 40):
        got = []
        for block in blocks(pa.array(texts), limit):
            ids, many = encoder.encode(block)
            got += np.split(ids, np.cumsum(many)[:-1])
        assert [x.tolist() for x in got] == wanted


def test_blank_lines_encode_as_in_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path(tokens.VOCABULARY)
    plain, encoder = Tokenizer.from_file(file), tokens.Encoder(file)
    rng = random.Random(8)
    odd = ["\n", "\n\n", " ", "\t", "\r\n", "\u00a0", "a", "B.", "é", "<", "<|endoftext|>"]
    texts = ["a\n\nb", "a\n\n\nb", "\n\nb", "a\n\n", "a \n\nb", "a\n\n b", "a\n\n<|endoftext|>\n\nb", "a\n\n<b", "\n\n"]
    texts += ["".join(rng.choices(odd, k=rng.randrange(10))) for _ in range(2000)]
    wanted = [[*plain.encode(text, add_special_tokens=False).ids, tokens.END] for text in texts]
    ids, many = encoder.encode(next(blocks(pa.array(texts), 1 << 20)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == wanted


def test_words_of_letters_go_straight_to_the_model():
    import public_tokenizers
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, tokenizer):
            self.whole, self.seen = tokenizer, 0

        def __getattr__(self, name):
            return getattr(self.whole, name)

        def encode_batch_fast(self, texts, **how):
            self.seen += sum(len(text.split("<|endoftext|>")) for text in texts)
            return self.whole.encode_batch_fast(texts, **how)

    file = public_tokenizers.path(tokens.VOCABULARY)
    plain, encoder = Tokenizer.from_file(file), tokens.Encoder(file)
    encoder.tokenizer = Counted(encoder.tokenizer)
    rng = random.Random(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "éèßñçaeiou", "αβγδεζη", "жизньмир", "אבגדה"]
    words = ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(1, 14))) for _ in range(5000)]
    text = " ".join(word + rng.choice(["", "", ".", ","] if word < "\u0100" else [""]) for word in words)
    ids, many = encoder.encode(next(blocks(pa.array([text]), 1 << 20)))
    assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, tokens.END] and many.tolist() == [len(ids)]
    assert encoder.tokenizer.seen * 20 < len(words)


def test_letters_are_letters_to_the_pattern():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, all_letters = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY)), "".join(sorted(tokens._LETTERS))
    assert len(plain.pre_tokenizer.pre_tokenize_str(" " + all_letters)) == 1 and tokens.letters(" " + all_letters) and tokens.letters("Ħa")
    assert not any(map(tokens.letters, ["", " ", "  a", "a ", "a1", "don't", "e\u0301", "\u4e00", "a\n", "\u00d7"]))


def test_cuts_at_punctuation_inside_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path(tokens.VOCABULARY)
    plain, encoder = Tokenizer.from_file(file), tokens.Encoder(file)
    rng = random.Random(6)
    odd = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "'s", "'t", "'ll", "'re", "a", "Word", "9", "é", "ÿ", "À", "×", "÷", "ö́", "ж", "你", "²", " ", "\n", "<|endoftext|>", "<|endoftext", "\u00a0"]
    texts = ["don't", "l'été's", "été.", "a×.b÷,", "x<|endoftext|>y", "é<|endoftext|>'s", "a_b-c/d", "'", "é'", ".", "", "é"]
    texts += ["".join(rng.choices(odd, k=rng.randrange(14))) for _ in range(3000)]
    wanted = [[*plain.encode(text, add_special_tokens=False).ids, tokens.END] for text in texts]
    for limit in (1 << 20, 30):
        got = []
        for block in blocks(pa.array(texts), limit):
            ids, many = encoder.encode(block)
            got += np.split(ids, np.cumsum(many)[:-1])
        assert [x.tolist() for x in got] == wanted


def test_index_is_minimal_and_perfect():
    keys = np.random.default_rng(4).choice(1 << 60, 5000, replace=False).astype(np.int64)
    index = tokens.Index.build(keys)
    assert sorted(index.slots(keys)) == list(range(5000))
    others = keys + 1
    slot = index.slots(others)
    held = np.zeros(5000, np.uint32)
    held[index.slots(keys)] = tokens.fingerprints(keys)
    assert (held[slot[slot >= 0]] == tokens.fingerprints(others[slot >= 0])).mean() < 0.01


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, n):
    line = list(line)
    for _ in range(n):
        at = rng.randrange(len(line))
        kind = rng.randrange(3)
        if kind == 0:
            line[at] = rng.choice("abéz")
        elif kind == 1:
            line.insert(at, rng.choice("abéz"))
        else:
            del line[at]
    return "".join(line)


def test_banded_distance():
    rng, left, right = random.Random(6), [], []
    for _ in range(800):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        left.append(a)
        right.append(edited(rng, a + "x", rng.randrange(0, 4)))
    for edits in (1, 2, 3):
        got = lines.within([np.array(list(map(ord, x))) for x in left], [np.array(list(map(ord, x))) for x in right], edits)
        assert got.tolist() == [edit_distance(a, b) <= edits for a, b in zip(left, right)]


def test_line_classes_against_all_pairs(spark):
    rng = random.Random(7)
    bases = ["".join(rng.choice("abcdeéü ") for _ in range(rng.randrange(20, 70))).strip() + "x" * 20 for _ in range(20)]
    rows = [(d, "\n".join(edited(rng, rng.choice(bases), rng.randrange(0, 3)) for _ in range(4))) for d in range(60)] + [(100, "short\nshort\nshor")]
    places = {(d, k): line for d, text in rows for k, line in enumerate(text.split("\n"))}
    near = lambda a, b: a == b or (min(len(a), len(b)) >= lines.LEAST and edit_distance(a, b) <= lines.EDITS)
    wanted = union_find([(p, q) for p in places for q in places if p < q and near(places[p], places[q])], places)
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in lines.line_classes(docs(spark, rows)).collect()}
    assert got == wanted


def test_vectors_against_all_pairs(spark):
    from orrery.llm.embeddings import near_vectors

    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 32))
    x = (centers[rng.integers(0, 12, 400)] + rng.normal(size=(400, 32)) * rng.choice([0.15, 0.27, 0.6], 400)[:, None]).astype(np.float32)
    label = rng.integers(0, 2, 400)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(400, dtype=bool)
    wanted = union_find([tuple(map(int, p)) for p in np.argwhere(linked)], range(400))
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(400)]
    for block in (512, 16):
        got = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(linked[i].sum()), wanted[i]) for i in range(400)}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    ids = {x for p in pairs for x in p}
    assert {i: got.get(i, i) for i in ids} == union_find(pairs, ids)


def test_forest_keeps_components():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 80, 60), rng.integers(80, 160, 60)
    ids, n, root = buckets.forest(a, b)
    whole = union_find(list(zip(a.tolist(), b.tolist())), ids.tolist())
    assert union_find(list(zip(ids.tolist(), root.tolist())), ids.tolist()) == whole and n.sum() == 120


def test_personal_data_base_spans(spark, sf):
    import re

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(s[::-1])) % 10 == 0
    sound = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    got = {r.doc_id: r for r in queries.op9_pii(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in kinds.items() for m in re.finditer(p, r.text or "") if sound[k](m[0]))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(got[r.doc_id].spans.split(","))


def test_events_fold_into_messages(spark):
    log = spark.createDataFrame(
        [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "wro"), (1, 2, 2, "delta", "assistant", "ng"), (1, 2, 3, "regenerate", "assistant", None), (1, 2, 5, "delta", "assistant", "ght"), (1, 2, 4, "delta", "assistant", "ri"), (1, 3, 6, "delta", "user", "old"), (1, 3, 7, "edit", "user", "new")],
        "conv_id bigint, message_id bigint, seq bigint, kind string, role string, text string",
    )
    row = chat.read_back(chat.formatted(log)).first()
    assert [(t.role, t.text) for t in row.turns] == [("user", "hi"), ("assistant", "right"), ("user", "new")] and row.loss_texts == ["right"]


def test_events_of_one_message_fold_into_one(spark):
    log = spark.createDataFrame(
        [(1, 1, 0, "message", "user", "hi"), (1, 1, 1, "edit", "user", "hello"), (1, 2, 2, "message", "assistant", "first"), (1, 2, 3, "regenerate", None, None), (1, 2, 4, "delta", "assistant", "second"), (1, 3, 5, None, "user", "no kind"), (1, 3, 6, "delta", "user", " more"), (1, 4, 7, "message", "user", "a"), (1, 4, 8, "message", "user", "b"), (1, 4, 9, "odd", "user", "c")],
        "conv_id bigint, message_id bigint, seq bigint, kind string, role string, text string",
    )
    row = chat.read_back(chat.formatted(log)).first()
    assert [(t.role, t.text) for t in row.turns] == [("user", "hello"), ("assistant", "second"), ("user", "no kind more"), ("user", "b")]


def test_rows_by_turn_go_through_the_fold(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "b"), (2, 0, "user", "a")]
    log = chat.events_of_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert {r.kind for r in log.collect()} == {"message", "delta"}
    assert sorted((r.conv_id, r.seq, r.text) for r in chat.fold(log).collect() if r.seq is not None) == [(1, 0, "a"), (1, 0, "a"), (2, 0, "a")]


def test_pipeline_keeps_what_its_stages_keep(spark, sf):
    import corpus_pipeline

    kept = table(spark, sf, "documents")
    toxic = {r.doc_id for r in queries.op8_toxicity(spark, sf).where("predicted = 1").collect()}
    out = corpus_pipeline.toxicity_stage(spark, kept, sf)
    assert out.columns == kept.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()} - toxic
    one = corpus_pipeline.near_dedup_stage(spark, out, sf)
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(out).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(classes.values()))
    clean = corpus_pipeline.decontamination_stage(spark, one, sf)
    bad = {r.doc_id for r in contamination(one, table(spark, sf, "benchmark")).where("n_hit > 0 and 20 * n_hit >= n_words").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - bad
    mixed = corpus_pipeline.mixing_stage(spark, clean, sf)
    assert mixed.columns == kept.columns and not mixed.join(clean, "doc_id", "left_anti").count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_mixing_rows_repeat_by_rate(spark, sf):
    d = table(spark, sf, "documents")
    out = mixing.mixed(d, table(spark, sf, "labels")).groupBy("doc_id").count()
    rate = mixing.rates(d, table(spark, sf, "labels")).select("doc_id", "rate")
    worst = rate.join(out, "doc_id", "left").select(F.max(F.abs(F.coalesce("count", F.lit(0)) - F.col("rate")))).first()[0]
    assert worst <= 1


def test_machine_sums_all_pairs():
    from orrery.llm.quality import BUCKETS, STATISTICS, Machine, features

    rng = np.random.default_rng(21)
    machine = Machine()
    n = BUCKETS + len(STATISTICS)
    machine.w0, machine.w, machine.v = 0.3, rng.normal(size=n), rng.normal(size=(n, 8))
    machine.center, machine.spread = rng.random(len(STATISTICS)), 0.5 + rng.random(len(STATISTICS))
    texts = ["one two two three", "", "a b c d e f. One two!\nthree | four", "x " * 50]
    (block,) = blocks(pa.array(texts))
    row, column, value = machine._joined(*features(block))
    got = machine.score(block)
    for k in range(len(texts)):
        c, x = column[row == k], value[row == k]
        z = machine.w0 + machine.w[c] @ x + sum(machine.v[c[i]] @ machine.v[c[j]] * x[i] * x[j] for i in range(len(c)) for j in range(i))
        assert np.isclose(got[k], 1 / (1 + np.exp(-z)))


def test_document_score_by_enumeration():
    import itertools

    from orrery.llm.toxicity import Tagger, _breaks, _features

    rng = np.random.default_rng(22)
    tagger = Tagger()
    tagger.chain = crf.Chain(1 << 18, 2)
    tagger.chain.emission, tagger.chain.transition, tagger.chain.opening = rng.normal(size=(1 << 18, 2)) / 2, rng.normal(size=(2, 2)), rng.normal(size=2)
    tagger.blend = np.array([-0.4, 0.7, 1.3])
    (block,) = blocks(pa.array(["a bad word here. And more\nof it", "fine", ""]))
    words = block.words()
    local = tagger.chain.scores((_features(words) % np.uint64(1 << 18)).astype(np.int32))
    start = np.append(np.flatnonzero(_breaks(words)), len(words))
    chance = np.zeros(len(words))
    for a, z in zip(start[:-1], start[1:]):
        mass = np.zeros((z - a, 2))
        for path in itertools.product(range(2), repeat=z - a):
            weight = np.exp(tagger.chain.opening[path[0]] + sum(local[a + t, s] for t, s in enumerate(path)) + sum(tagger.chain.transition[s, r] for s, r in zip(path, path[1:])))
            for t, s in enumerate(path):
                mass[t, s] += weight
        chance[a:z] = mass[:, 1] / mass.sum(axis=1)
    got = tagger.score(block)[0]
    for row in range(3):
        own = chance[words.row == row]
        top = min(max([1e-6, *own]), 1 - 1e-6)
        z = tagger.blend @ [1, np.log(top / (1 - top)), np.log1p(own[own >= 0.1].sum())]
        assert np.isclose(got[row], 1 / (1 + np.exp(-z)))
