"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (email, ip, card, phone) give the base spans, which always stay; each is searched in time linear in the
text.  The field adds spans, also of kinds and spellings that no pattern knows: written-out addresses, numbers
in groups, ids, keys and passwords (kind `secret`).  Words are runs of visible bytes, and a word's features are its shape (runs
of digits, upper and lower case and non-ASCII letters collapsed, marks kept), its neighbours' shapes, its length, its
first bytes, whether it mixes letters and digits, and the last letters of the word before.  The field is fitted on a small labelled table (`labelled`: text,
spans of kind, start, end); where none is given `examples` writes one: `EXAMPLES` sentences by a fixed seed, whose words come from the
corpus itself (`WORDS` words of bounded length) and whose personal data come from a list of spellings.  Each text is decoded by Viterbi in numpy batches over
sequences that end at line breaks and after 128 words; decoded words of one kind that touch form a span, trimmed of
surrounding marks, and added where it meets no base span and holds a digit, `@` or a bracket.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive;
without labelled spans only base spans are returned; repeated documents give one row each; other
columns are ignored.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.crf import Chain, sequences
from orrery.llm.textblocks import Hashes, blocks, lean, mix64, trim

KINDS = ("email", "ip", "card", "phone", "secret")
#: Of the kinds, those that patterns find.
BASE = KINDS[:4]
BUCKETS = 1 << 16
#: Sentences of the built-in labelled table, and words of the corpus that they are made of.
EXAMPLES, WORDS = 8000, 4000
BLOCK = 1 << 20

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
# a run of digits matches from its first digit or not at all
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_VISIBLE = np.ones(256, dtype=bool)
_VISIBLE[:33] = _VISIBLE[127] = False
_TELLING = np.zeros(256, dtype=bool)
_TELLING[48:58] = _TELLING[64] = _TELLING[91] = _TELLING[40] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 57, 65, 97, 200
_DIGIT, _LETTER = _SHAPE == 57, (_SHAPE == 65) | (_SHAPE == 97)
_MARK = np.zeros(256, dtype=bool)
for _c in b".,;:!?()[]{}<>\"'|":
    _MARK[_c] = True


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        # what may stand before this @: from the end of the last address or @ on
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((0, start, match.end()))
        done = match.end() if match else at + 1
        at = text.find("@", max(done, at + 1))
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 64 else ""
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((3, m.start(), m.end()))
    return found


class Shapes:
    """Words of a block as runs of visible bytes, their features and sequences."""

    def __init__(self, block):
        words = block.words(lower=False, table=_VISIBLE)
        self.words = words
        start, end = words.start, words.end
        shape = _SHAPE[block.data]
        keep = np.ones(len(shape), dtype=bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[start] = True
        place = np.append(0, np.cumsum(keep))
        short = Hashes(shape[keep]).of(place[start], place[end])
        size = np.minimum(end - start, 24).astype(np.uint64)
        hashes = Hashes(block.data)
        head = hashes.of(start, np.minimum(start + 4, end))
        breaks = np.append(0, np.cumsum(block.data == 10))
        self.first = np.zeros(len(start), dtype=bool)
        self.first[1:] = breaks[start[1:]] > breaks[end[:-1]]
        self.first[words.first[:-1][words.count > 0]] = True
        before, after = np.roll(short, 1), np.roll(short, -1)
        before[self.first] = 1
        if len(after):
            after[np.append(self.first[1:], True)] = 2
        salt = lambda x, k: mix64(x + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        tail = hashes.of(np.maximum(start, end - 5), end)
        said = np.roll(tail, 1)
        said[self.first] = 1
        digits, letters = (np.diff(np.append(0, np.cumsum(kind[block.data]))[np.stack([start, end])], axis=0)[0] for kind in (_DIGIT, _LETTER))
        mixed = (np.minimum(digits, 15) * 16 + np.minimum(letters, 15)).astype(np.uint64)
        features = np.stack([salt(short, 1), salt(before, 2), salt(after, 3), salt(short + size, 4), salt(head, 5), salt(mix64(short) + before, 6), salt(said, 7), salt(mixed, 8)], axis=1)
        self.ids = (features % np.uint64(BUCKETS)).astype(np.int32)


def fit(table: pa.Table) -> Chain | None:
    """A chain from texts and their spans (kind, start, end in code points)."""
    spans, parts = table.column("spans").to_pylist(), []
    for block in blocks(table.column("text"), BLOCK):
        shapes = Shapes(block)
        words = shapes.words
        if not len(words):
            continue
        begin = np.append(0, np.cumsum((block.data & 0xC0) != 0x80))
        low, high = begin[words.start] - begin[block.offset[words.row]], begin[words.end] - begin[block.offset[words.row]]
        state = np.zeros(len(words), dtype=np.int64)
        for row in range(block.rows):
            own = slice(int(words.first[row]), int(words.first[row + 1]))
            for span in spans[block.lo + row] or []:
                inside = (low[own] < span["end"]) & (high[own] > span["start"])
                state[own][inside] = KINDS.index(span["kind"]) + 1
        seat = np.flatnonzero(shapes.first)
        keep = np.maximum.reduceat(state, seat) > 0
        keep |= (shapes.ids[seat, 4] + shapes.ids[seat, 0]) % 4 == 0  # a share of the sequences without spans
        keep = keep[np.cumsum(shapes.first) - 1]
        parts.append((shapes.ids[keep], state[keep], shapes.first[keep]))
    if not any(p[1].any() for p in parts):
        return None
    ids, state, first = (np.concatenate(x) for x in zip(*parts))
    trim()
    return Chain(BUCKETS, len(KINDS) + 1).fit(ids, state, *sequences(first), rounds=40)


def _added(chain: Chain, block) -> dict[int, list[tuple[int, int, int]]]:
    """Decoded spans of each row that has some: (kind, start, end) in code points."""
    shapes = Shapes(block)
    words = shapes.words
    if not len(words):
        return {}
    state = chain.decode(chain.scores(shapes.ids), *sequences(shapes.first))
    at = np.flatnonzero(state)
    out: dict[int, list] = {}
    if not len(at):
        return out
    begin = np.append(0, np.cumsum((block.data & 0xC0) != 0x80))
    joined = (np.diff(at) == 1) & (state[at][1:] == state[at][:-1]) & ~shapes.first[at[1:]]
    group = np.append(True, ~joined)
    heads, tails = at[group], at[np.append(~joined, True)]
    for a, z in zip(heads, tails):
        start, end = int(words.start[a]), int(words.end[z])
        while start < end and _MARK[block.data[start]]:
            start += 1
        while end > start and _MARK[block.data[end - 1]]:
            end -= 1
        if end > start and _TELLING[block.data[start:end]].any():
            row = int(words.row[a])
            base = begin[block.offset[row]]
            out.setdefault(row, []).append((int(state[a]) - 1, int(begin[start] - base), int(begin[end] - base)))
    return out


def _find(batches, model):
    chain = model.value
    for batch in batches:
        for block in blocks(batch.column(1), BLOCK):
            telling = np.diff(np.append(0, np.cumsum(_TELLING[block.data]))[block.offset]) > 0
            added = _added(chain, block) if chain else {}
            base, more = [], []
            for row in range(block.rows):
                own = base_spans(bytes(block.data[block.offset[row] : block.offset[row + 1]]).decode()) if telling[row] else []
                base.append(own)
                more.append(sorted(s for s in added.get(row, []) if not any(s[1] < b[2] and b[1] < s[2] for b in own)))
            lists = lambda rows: pa.array([[{"kind": KINDS[k], "start": a, "end": z} for k, a, z in r] for r in rows], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.rows), lists(base), lists(more)], ["doc_id", "base", "added"])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _spellings(rng: random.Random) -> tuple[str, str]:
    """A kind and one example of it in one of its spellings."""
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    letters = lambda n, of=string.ascii_lowercase: "".join(rng.choice(of) for _ in range(n))
    name = letters(rng.randrange(2, 10)) + rng.choice(["", ".", "_", "-", "."]) + rng.choice([letters(5), digits(2), ""])
    host = letters(rng.randrange(3, 9)) + rng.choice(["", digits(1)]) + "." + rng.choice(["com", "org", "net", "example.com", "de", "fr", "es"])
    kind = rng.choice(KINDS)
    if kind == "email":
        return kind, rng.choice([f"{name}@{host}"] * 4 + [f"{name}(at){host}", f"{name}[at]{host}", f"{name} [at] {host}"])
    if kind == "ip":
        return kind, rng.choice([".".join(str(rng.randrange(256)) for _ in range(4))] * 3 + [":".join(letters(4, string.hexdigits[:16]) for _ in range(8)), "-".join(digits(2) for _ in range(4))])
    if kind == "card":
        body = rng.choice("3456") + digits(14)
        number = next(body + c for c in string.digits if _luhn(body + c))
        return kind, rng.choice([number] * 2 + [" ".join(number[k : k + 4] for k in range(0, 16, 4)), "-".join(number[k : k + 4] for k in range(0, 16, 4))])
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return kind, rng.choice([f"+{rng.randrange(1, 99)} ({a}) {b}-{c}", f"+{rng.randrange(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randrange(1, 99)}{a}{b}{c}", f"0{a}/{b}{c}"])
    key = rng.choice([letters(n, of) for n in (16, 20, 24, 32, 40, 64) for of in (string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_uppercase + string.digits)])
    named = rng.choice(["token", "secret", "password", "passwd", "key", "api_key", "apikey", "access_key", "auth", "pwd", "credential"])
    return kind, rng.choice([f'{named} = "{key}"', f"{named}={key}", f"{named}: {key}", f'"{named}": "{key}"', letters(4, string.ascii_uppercase) + letters(16, string.ascii_uppercase + string.digits), letters(3) + "_" + key, letters(2) + "-" + key])


#: Words that the examples hold besides those of the corpus.
GROUND = "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know Version Section Chapter Page der die das und nicht ein eine von zu mit auf le la les des et en un une que el los las por con".split()


def examples(words: list[str], rows: int = EXAMPLES, seed: int = 17) -> pa.Table:
    """A labelled table: sentences of these words, most with one or two pieces of personal data, some with harmless numbers."""
    rng, texts, spans = random.Random(seed), [], []
    words = [*words, *GROUND]
    number = lambda: "".join(rng.choice(string.digits) for _ in range(rng.randrange(1, 8)))
    harmless = [
        lambda: f"{rng.randrange(1000, 2100)}", lambda: f"of {rng.randrange(1000, 2100)}", lambda: f"{rng.choice(words)} {rng.randrange(10000)}", lambda: f"{rng.randrange(32)}.{rng.randrange(13)}.{rng.randrange(1900, 2100)}", lambda: f"{rng.randrange(10)}.{rng.randrange(10)}",
        number, lambda: f"{number()}-{number()}", lambda: f"{rng.choice(words)}-{rng.choice(words)}", lambda: f"${number()}", lambda: f"({number()})", lambda: f"{number()}%", lambda: f"{rng.choice(words)}={number()}",
        lambda: f"{rng.choice(words).upper()}", lambda: f"v{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(9)}", lambda: f"{rng.randrange(24)}:{rng.randrange(60):02d}", lambda: f'"{rng.choice(words)}"', lambda: f"@{rng.choice(words)}", lambda: f"https://{rng.choice(words)}.com/{number()}",
    ]
    for _ in range(rows):
        text, own = "", []
        for _ in range(rng.randrange(2, 5)):
            text += " ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) + " "
            chance = rng.random()
            if chance < 0.3:
                kind, said = _spellings(rng)
                own.append({"kind": kind, "start": len(text), "end": len(text) + len(said)})
                text += said + rng.choice([" ", " ", " ", ". ", ", "])
            elif chance < 0.8:
                text += rng.choice(harmless)() + rng.choice([" ", ". ", ", "])
        texts.append(text.strip())
        spans.append(own)
    return pa.table({"text": texts, "spans": pa.array(spans, pa.list_(_SPAN))})


def common_words(docs: DataFrame, words: int = WORDS) -> list[str]:
    """Of a sixteenth of the corpus' words of letters and marks (by hash, 24 characters at most), those with the least hash: the ground of the examples."""
    drawn = lambda w: (F.pmod(F.xxhash64(w), F.lit(16)) == 0) & F.length(w).between(1, 24) & w.rlike(r"\A[\p{L}'-]+[.,;:!?]?\z")
    one = docs.select(F.explode(F.filter(F.split("text", r"\s+"), drawn)).alias("word")).distinct()
    least = one.orderBy(F.xxhash64("word"), "word").limit(words)
    return [r.word for r in least.collect()]


def personal_data(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, base and added (arrays of kind, start, end)."""
    table = labelled.select("text", "spans").toArrow() if labelled is not None else examples(common_words(docs))
    model = docs.sparkSession.sparkContext.broadcast(fit(table))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(lean(lambda b: _find(b, model)), f"doc_id bigint, base {_SPANS}, added {_SPANS}")
