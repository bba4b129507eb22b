"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its words (hashed, weighted 1 + ln(times), scaled to length one) and
a fixed set of structure statistics and metadata computed from the text (`STATISTICS`).  The score is
the logistic of w0 + sum(w x) + 1/2 sum_f((sum v_f x)**2 - sum v_f**2 x**2): pairwise interactions of
rank `RANK` in time linear in the words, by the sum-of-squares identity.  Labels, language,
source and id are no inputs.

Defined results: null, empty and wordless texts are scored by their statistics alone; without
labels of both classes every score is the share of class 1 (0.0 without labels); repeated documents give
one row each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.samples import class_share, held_out, labelled
from orrery.llm.textblocks import blocks, lean, mix64, trim

BUCKETS = 1 << 17
RANK = 8
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "words_per_line", "share_digits", "share_upper", "share_space",
    "share_marks", "share_pipes", "share_symbols", "share_stops", "share_exclaims", "share_non_ascii", "distinct_words",
    "most_frequent_word", "repeated_lines", "no_words", "stutters",
)

_KIND = np.zeros((256, 9), dtype=bool)
_KIND[48:58, 0] = True
_KIND[65:91, 1] = True
_KIND[[9, 10, 13, 32], 2] = True
_KIND[[44, 58, 59, 34, 39, 40, 41, 45], 3] = True
_KIND[124, 4] = True
_KIND[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 126], 5] = True
_KIND[46, 6] = True
_KIND[[33, 63], 7] = True
_KIND[128:, 8] = True


def features(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each distinct word, and the statistics (rows, len(STATISTICS))."""
    words = block.words()
    hashes = words.hashes()
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1]))[: len(hashes)]
    stutters = np.bincount(words.row, weights=again, minlength=block.rows)
    order = np.lexsort((hashes, words.row))
    hashes, row = hashes[order], words.row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(hashes)))
    row, bucket, value = row[at], (hashes[at] % np.uint64(BUCKETS)).astype(np.int64), 1 + np.log(times)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=block.rows))
    value = value / norm[row]

    size = np.diff(block.offset)
    cut = lambda mask: np.diff(np.append(0, np.cumsum(mask))[block.offset])
    breaks = block.data == 10
    lines = cut(breaks) + 1
    many = np.maximum(words.count, 1)
    most = np.zeros(block.rows)
    np.maximum.at(most, row, times)
    distinct = np.bincount(row, minlength=block.rows)
    line = block.words(lower=False, table=_LINE)
    key = mix64(line.hashes() + line.row.astype(np.uint64))
    lines_distinct = np.zeros(block.rows)
    if len(key):
        first = np.unique(key, return_index=True)[1]
        lines_distinct = np.bincount(line.row[first], minlength=block.rows)
    held = np.bincount(words.row, weights=words.end - words.start, minlength=block.rows)
    kinds = [cut(_KIND[:, k][block.data]) / np.maximum(size, 1) for k in range(_KIND.shape[1])]
    statistics = np.stack(
        [np.log1p(size) / 10, np.log1p(words.count) / 8, np.log1p(lines) / 5, held / many / 10, np.minimum(5, words.count / lines / 20),
         *kinds, distinct / many, most / many, 1 - lines_distinct / np.maximum(line.count, 1), words.count == 0, stutters / many],
        axis=1,
    )
    return row, bucket, value, statistics


_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


class Machine:
    """w0, w, v over BUCKETS word features followed by the statistics."""

    def __init__(self):
        self.w0, self.share = 0.0, 0.0
        self.w = self.v = None

    def _sums(self, row, column, value, rows):
        """Linear sums and, for each factor, sums and sums of squares."""
        linear = np.bincount(row, weights=self.w[column] * value, minlength=rows)
        part = self.v[column] * value[:, None]
        edge = np.searchsorted(row, np.arange(rows + 1))
        total = np.vstack([np.zeros(RANK), np.cumsum(part, axis=0)])
        square = np.append(0, np.cumsum((part**2).sum(axis=1)))
        return linear, total[edge[1:]] - total[edge[:-1]], square[edge[1:]] - square[edge[:-1]]

    def logits(self, row, column, value, rows):
        linear, total, square = self._sums(row, column, value, rows)
        return self.w0 + linear + 0.5 * ((total**2).sum(axis=1) - square), total

    def fit(self, table: pa.Table, share: float | None = None, steps: int = 500, rate: float = 0.05, decay: float = 1e-5) -> Machine:
        """Logistic loss by AdaGrad: at least 12 passes and `steps` steps, over batches of 16 to 256 documents.

        share: that of class 1 among all documents, where the table has another; the constant follows it.
        """
        y = table.column("y").to_numpy().astype(np.float64)
        self.share = float(y.mean()) if len(y) else 0.0
        if len(np.unique(y)) < 2:
            return self
        parts = []
        stats = []
        for block in blocks(table.column("text")):
            row, bucket, value, statistics = features(block)
            parts.append((row + block.lo, bucket, value))
            stats.append(statistics)
        row, column, value = (np.concatenate(x) for x in zip(*parts))
        stats = np.concatenate(stats)
        self.center, self.spread = stats.mean(axis=0), stats.std(axis=0) + 1e-3
        row, column, value = self._joined(row, column, value, stats)
        trim()
        random = np.random.default_rng(3)
        n = BUCKETS + len(STATISTICS)
        self.w, self.v = np.zeros(n), random.normal(0, 0.02, (n, RANK))
        self.w0 = float(np.log(self.share / (1 - self.share)))
        gw, gv, g0 = np.full(n, 1e-8), np.full((n, RANK), 1e-8), 1e-8
        edge = np.searchsorted(row, np.arange(len(y) + 1))
        size = max(16, min(256, len(y) // 32))
        for _ in range(max(12, -(-steps * size // len(y)))):
            for docs in np.array_split(random.permutation(len(y)), max(1, len(y) // size)):
                docs = np.sort(docs)
                many = edge[docs + 1] - edge[docs]
                at = np.repeat(edge[docs] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
                r, c, x = np.repeat(np.arange(len(docs)), many), column[at], value[at]
                z, total = self.logits(r, c, x, len(docs))
                off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]) / len(docs)
                own, place = np.unique(c, return_inverse=True)
                slope = np.bincount(place, weights=off[r] * x, minlength=len(own)) + decay * self.w[own]
                gw[own] += slope**2
                self.w[own] -= rate * slope / np.sqrt(gw[own])
                for k in range(RANK):
                    d = off[r] * (x * total[r, k] - self.v[c, k] * x * x)
                    slope = np.bincount(place, weights=d, minlength=len(own)) + decay * self.v[own, k]
                    gv[own, k] += slope**2
                    self.v[own, k] -= rate * slope / np.sqrt(gv[own, k])
                g0 += off.sum() ** 2
                self.w0 -= rate * off.sum() / np.sqrt(g0)
        trim()
        if share is not None and 0 < share < 1:
            self.w0 += float(np.log(share / (1 - share)) - np.log(self.share / (1 - self.share)))
            self.share = share
        return self

    def _joined(self, row, column, value, stats):
        """Words and scaled statistics as one list of features, sorted by row."""
        scaled = np.clip((stats - self.center) / self.spread, -4, 4) / 4
        rows = np.concatenate([row, np.repeat(np.arange(len(stats)), stats.shape[1])])
        columns = np.concatenate([column, np.tile(BUCKETS + np.arange(stats.shape[1]), len(stats))])
        order = np.argsort(rows, kind="stable")
        return rows[order], columns[order], np.concatenate([value, scaled.ravel()])[order]

    def score(self, block) -> np.ndarray:
        if self.w is None:
            return np.full(block.rows, self.share)
        z, _ = self.logits(*self._joined(*features(block)), block.rows)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(batches, model):
    machine = model.value
    for batch in batches:
        for block in blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.rows), pa.array(machine.score(block))], ["doc_id", "score"])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score."""
    model = docs.sparkSession.sparkContext.broadcast(Machine().fit(labelled(docs, labels, "quality"), class_share(labels, "quality")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = texts.mapInArrow(lean(lambda b: _score(b, model)), "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score")
