"""Toxicity by a linear-chain conditional random field that tags toxic words.

Labels mark documents, the field needs marked words.  A word's features are its hash and the
hashes of its first three to six and last three and four bytes.  A feature that occurs in labelled toxic documents
far more often than in the others (a likelihood-ratio test) marks the words of toxic documents
that carry it; all other words are clean.  Copies of a document count once.  On these labelled tokens the field is fitted.
Forward-backward gives each word of a text its probability; a document's score is a
logistic function of its highest word probability and of the expected number of toxic words, fitted
on the labelled documents; offsets list the words above one half.

A sequence ends where the text goes on with a line break or after `.`, `!` or `?`, or after 128 words.

Defined results: null, empty and wordless texts get the score of a document without toxic
words; without labels of both classes every score is the share of class 1 (0.0 without labels);
repeated documents give one row each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.crf import Chain, sequences
from orrery.llm.samples import class_share, held_out, labelled
from orrery.llm.textblocks import Hashes, blocks, lean, mix64, trim

BUCKETS = 1 << 18
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
LEAST_RATIO = 20.0
#: One in so many sequences without marked words takes part in the fit.
SHARE = 8
FIT_BLOCK = 1 << 18
BLOCK = 1 << 20

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 13, 33, 46, 63]] = True


def _features(words) -> np.ndarray:
    """(words, features): unreduced 64-bit feature hashes."""
    hashes = Hashes(words.data)
    size = words.end - words.start
    out = [hashes.of(words.start, words.end)]
    for k in PREFIXES:
        out.append(np.where(size > k, hashes.of(words.start, np.minimum(words.start + k, words.end)) + np.uint64(k), np.uint64(k)))
    for k in SUFFIXES:
        out.append(np.where(size > k, hashes.of(np.maximum(words.end - k, words.start), words.end) + np.uint64(16 + k), np.uint64(16 + k)))
    return mix64(np.stack(out, axis=1))


def _breaks(words) -> np.ndarray:
    """Whether a word is the first of its sequence."""
    ends = np.append(0, np.cumsum(_BREAK[words.block.data]))
    first = np.zeros(len(words), dtype=bool)
    first[1:] = ends[words.start[1:]] > ends[words.end[:-1]]
    first[words.first[:-1][words.count > 0]] = True
    return first


class Tagger:
    def __init__(self):
        self.chain, self.blend, self.share = None, None, 0.0

    def fit(self, table: pa.Table, share: float | None = None) -> Tagger:
        """table: text, y (0 or 1); share: that of class 1 among all documents, where the table has another."""
        y = table.column("y").to_numpy()
        self.share = share if share is not None else float(y.mean()) if len(y) else 0.0
        if len(np.unique(y)) < 2:
            return self
        table = table.filter(pa.array(_unlike(table)))
        y = table.column("y").to_numpy()
        if len(np.unique(y)) < 2:
            return self
        marks = self._marks(table, y)
        trim()
        parts = []
        for block in blocks(table.column("text"), FIT_BLOCK):
            words = block.words()
            if not len(words):
                continue
            features = _features(words)
            toxic = np.isin(features[:, :5], marks).any(axis=1) & (y[block.lo : block.hi][words.row] == 1)
            # sequences of toxic documents, and a share of the others
            first = _breaks(words)
            number = np.cumsum(first) - 1
            seat = np.flatnonzero(first)
            keep = np.maximum.reduceat(toxic, seat) | (features[seat, 0] % np.uint64(SHARE) == 0)
            keep = keep[number]
            parts.append(((features[keep] % np.uint64(BUCKETS)).astype(np.int32), toxic[keep].astype(np.int64), first[keep]))
        if not any(len(p[0]) for p in parts):
            return self
        ids, state, first = (np.concatenate(x) for x in zip(*parts))
        del parts
        trim()
        self.chain = Chain(BUCKETS, 2).fit(ids, state, *sequences(first))
        x = np.concatenate([self._evidence(block)[0] for block in blocks(table.column("text"), FIT_BLOCK)])
        weight = np.where(y == 1, self.share / y.mean(), (1 - self.share) / (1 - y.mean()))
        self.blend = _logistic(x, y, weight)
        trim()
        return self

    def _marks(self, table: pa.Table, y: np.ndarray) -> np.ndarray:
        """Feature hashes that tell toxic documents, by the likelihood ratio of their document counts."""
        seen = {kind: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for kind in (0, 1)}
        for block in blocks(table.column("text"), FIT_BLOCK):
            words = block.words()
            features = _features(words)[:, :5]
            for kind in (0, 1):
                at = y[block.lo : block.hi][words.row] == kind
                row = np.repeat(words.row[at], features.shape[1])
                flat = features[at].ravel()
                order = np.lexsort((flat, row))
                flat, row = flat[order], row[order]
                new = np.ones(len(flat), dtype=bool)
                new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
                seen[kind] = _added(*seen[kind], flat[new])
        (clean, b0), (toxic, a) = seen[0], seen[1]
        slot = np.minimum(np.searchsorted(clean, toxic), max(0, len(clean) - 1))
        b = np.where(clean[slot] == toxic, b0[slot], 0) if len(clean) else np.zeros_like(a)
        n1, n0 = (y == 1).sum(), (y == 0).sum()
        rate = (a + b) / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (a * np.log(a / (n1 * rate)) + np.where(b > 0, b * np.log(b / (n0 * rate)), 0))
        return toxic[(ratio > LEAST_RATIO) & (a >= 3) & (b / n0 <= 0.02 * a / n1)]

    def _evidence(self, block) -> tuple[np.ndarray, object, np.ndarray]:
        words = block.words()
        chance = np.zeros(len(words))
        if len(words):
            ids = (_features(words) % np.uint64(BUCKETS)).astype(np.int32)
            chance = self.chain.marginals(self.chain.scores(ids), *sequences(_breaks(words)))[0][:, 1]
        top = np.full(block.rows, 1e-6)
        np.maximum.at(top, words.row, chance)
        many = np.bincount(words.row, weights=np.where(chance >= 0.1, chance, 0), minlength=block.rows)
        top = np.minimum(top, 1 - 1e-6)
        return np.stack([np.log(top / (1 - top)), np.log1p(many)], axis=1), words, chance

    def score(self, block) -> tuple[np.ndarray, object, np.ndarray]:
        """Score of each row, the words, and the probability of each word."""
        if self.chain is None:
            return np.full(block.rows, self.share), None, np.zeros(0)
        x, words, chance = self._evidence(block)
        return 1 / (1 + np.exp(-(x @ self.blend[1:] + self.blend[0]))), words, chance


def _added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts, with the occurrences of more."""
    keys, counts = np.concatenate([keys, more]), np.concatenate([counts, np.ones(len(more), np.int64)])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def _unlike(table: pa.Table, slots: int = 3) -> np.ndarray:
    """Rows that share none of a few min-hashes of word shingles with a row before them: copies do not vote again and again."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for block in blocks(table.column("text"), FIT_BLOCK):
        words = block.words()
        grams, row = words.grams(words.hashes(), 5)
        edge = np.searchsorted(row, np.arange(block.rows))
        least = [np.minimum.reduceat(mix64(grams + np.uint64(k + 1)), np.minimum(edge, max(0, len(grams) - 1))) if len(grams) else np.zeros(block.rows, np.uint64) for k in range(slots)]
        for r in range(block.rows):
            own = {(k, int(least[k][r])) for k in range(slots)} if words.count[r] else set()
            keep.append(bool(words.count[r]) and not own & seen)
            seen |= own
    return np.array(keep, dtype=bool)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (constant first) by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w


def _score(batches, model):
    tagger = model.value
    for batch in batches:
        for block in blocks(batch.column(1), BLOCK):
            score, words, chance = tagger.score(block)
            at = np.flatnonzero(chance > 0.5)
            row = words.row[at] if len(at) else at
            begin = np.append(0, np.cumsum((block.data & 0xC0) != 0x80))  # code points before each byte
            base = begin[block.offset[row]]
            spans = pa.StructArray.from_arrays([pa.array(begin[words.start[at]] - base if len(at) else at), pa.array(begin[words.end[at]] - base if len(at) else at)], ["start", "end"])
            cuts = pa.array(np.searchsorted(row, np.arange(block.rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.rows), pa.array(score), pa.ListArray.from_arrays(cuts, spans)], ["doc_id", "score", "offsets"])


def _acceptable(batches, model, text: int, threshold: float):
    for batch in batches:
        for block in blocks(batch.column(text), BLOCK):
            yield batch.slice(block.lo, block.rows).filter(pa.array(model.value.score(block)[0] < threshold))


def _fitted(docs: DataFrame, labels: DataFrame):
    """The tagger, broadcast."""
    table = labelled(docs, labels, "toxic")
    return docs.sparkSession.sparkContext.broadcast(Tagger().fit(table, class_share(labels, "toxic")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, offsets (code points of toxic words, end exclusive)."""
    model = _fitted(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = texts.mapInArrow(lean(lambda b: _score(b, model)), "doc_id bigint, score double, offsets array<struct<start:bigint,end:bigint>>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "offsets")


def acceptable(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that score under the threshold, all columns as they are.

    Each row is judged by its own text, whatever its doc_id: null, shared or repeated.
    """
    model, text = _fitted(docs, labels), docs.columns.index("text")
    return docs.mapInArrow(lean(lambda b: _acceptable(b, model, text, threshold)), docs.schema)
