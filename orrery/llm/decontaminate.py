"""Benchmark decontamination as a prefix-filtered set join.

A window is `size` consecutive words of a benchmark item (an item of fewer words, but not
none, is one window).  Exact containment of a window needs every one of its words, so its
necessary prefix is one word: the rarest, by counts over all documents.  Documents are
probed with these anchor words only; a match fixes where the window would have to start,
length and positional bounds drop starts that do not fit into the document, and the rest
are verified word by word over the item-sized window.

The benchmark goes to the executors in chunks of at most `chunk_bytes` of text; any number
of chunks is processed, and their results are merged per document.

Defined results: null or wordless documents give n_words 0 and no hit; null or wordless
items have no window; items without an id mark words but are not listed; repeated items
count once per id; repeated documents give one row each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.textblocks import blocks, lean, mix64

WINDOW = 13
CHUNK_BYTES = 8 << 20

_SPAN = "array<struct<first:bigint,last:bigint>>"


#: Candidate places that are verified at a time.
CANDIDATES = 1 << 18


class Windows:
    """The distinct windows of one benchmark chunk, and the items that hold each."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        ids, rows = np.array([i for i, t in items if i is not None], dtype=np.int64), []
        self.items = np.unique(ids)
        sequence, start, length, owner = [], [], [], []
        base = 0
        for block in blocks(texts):
            words = block.words()
            sequence.append(words.hashes())
            for row in range(block.rows):
                n = int(words.count[row])
                if n:
                    at = np.arange(max(1, n - size + 1)) + words.first[row] + base
                    start.append(at)
                    length.append(np.full(len(at), min(n, size)))
                    owner.append(np.full(len(at), block.lo + row))
            base += len(words)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.sequence = np.concatenate(sequence) if sequence else np.zeros(0, np.uint64)
        self.start, self.length, rows = join(start), join(length), join(owner)
        listed = np.array([-1 if i is None else int(np.searchsorted(self.items, i)) for i, _ in items], dtype=np.int64)
        key = np.zeros(len(self.start), dtype=np.uint64)
        for k in range(int(self.length.max(initial=0))):
            here = self.sequence[np.minimum(self.start + k, len(self.sequence) - 1)]
            key = np.where(k < self.length, mix64(key + here + np.uint64(k + 1)), key)
        _, one, number = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.length = self.start[one], self.length[one]
        m = len(self.items) + 1
        code = np.unique(number.ravel() * m + listed[rows] + 1) if len(rows) else np.zeros(0, np.int64)
        pairs = np.stack([code // m, code % m - 1], axis=1)
        self._hold(pairs[pairs[:, 1] >= 0])
        self.vocabulary = np.unique(self.sequence)

    def _hold(self, pairs: np.ndarray) -> None:
        """pairs (window, item), sorted: item[edge[w] : edge[w + 1]] are the items of window w."""
        self.item = pairs[:, 1]
        self.edge = np.searchsorted(pairs[:, 0], np.arange(len(self.start) + 1))

    def anchored(self, counts: np.ndarray) -> Windows:
        """Choose each window's rarest word (then the lower hash, then the earlier place) and index the windows by it."""
        rank = np.empty(len(self.vocabulary), dtype=np.int64)
        rank[np.lexsort((self.vocabulary, counts))] = np.arange(len(rank))
        ranks = rank[np.searchsorted(self.vocabulary, self.sequence)]
        best, place = np.full(len(self.start), len(rank), dtype=np.int64), np.zeros(len(self.start), dtype=np.int64)
        for k in range(int(self.length.max(initial=0))):
            here = np.where(k < self.length, ranks[np.minimum(self.start + k, len(ranks) - 1)], len(rank))
            place = np.where(here < best, k, place)
            best = np.minimum(here, best)
        order = np.argsort(best, kind="stable")
        many = np.diff(self.edge)[order]
        held = self.item[_runs(self.edge[order], many)]
        self.start, self.length, self.place = self.start[order], self.length[order], place[order]
        self._hold(np.stack([np.repeat(np.arange(len(order)), many), held], axis=1))
        used, first = np.unique(best[order], return_index=True)
        by_rank = np.argsort(rank)
        words = self.vocabulary[by_rank[used]]
        order = np.argsort(words)
        self.anchors = words[order]
        self.first, self.last = first[order], np.append(first, len(best))[1:][order]
        return self

    def hits(self, hashes: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in a block of words: (position of the first word, window)."""
        if not len(self.anchors) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.anchors, hashes), len(self.anchors) - 1)
        at = np.flatnonzero(self.anchors[slot] == hashes)
        slot = slot[at]
        many = (self.last - self.first)[slot]
        total, found, lo = np.cumsum(many), [], 0
        while lo < len(at):  # a bounded number of candidates at a time
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CANDIDATES, side="right")))
            part = slice(lo, hi)
            found.append(self._verified(hashes, row, first, np.repeat(at[part], many[part]), _runs(self.first[slot[part]], many[part])))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _verified(self, hashes: np.ndarray, row: np.ndarray, first: np.ndarray, position: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = position - self.place[window]
        fits = (begin >= first[row[position]]) & (begin + self.length[window] <= first[row[position] + 1])
        begin, window = begin[fits], window[fits]
        for k in range(int(self.length.max())):
            inside = k < self.length[window]
            same = ~inside | (hashes[np.minimum(begin + k, len(hashes) - 1)] == self.sequence[np.minimum(self.start[window] + k, len(self.sequence) - 1)])
            begin, window = begin[same], window[same]
        return begin, window


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] numbers), then those of first[1], and so on."""
    return np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())


def _count(batches, vocabulary):
    total = np.zeros(len(vocabulary), dtype=np.int64)
    for batch in batches:
        for block in blocks(batch.column(0)):
            hashes = block.words().hashes()
            slot = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            total += np.bincount(slot[vocabulary[slot] == hashes], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["word", "n"])


def _probe(batches, windows):
    for batch in batches:
        for block in blocks(batch.column(1)):
            words = block.words()
            begin, window = windows.hits(words.hashes(), words.row, words.first)
            step = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, begin + windows.length[window], -1)
            covered = np.zeros(len(words) + 2, dtype=bool)
            covered[1:-1] = np.cumsum(step[:-1]) > 0
            edge = np.zeros(len(words) + 1, dtype=bool)
            edge[words.first] = True
            opens = np.flatnonzero(covered[1:] & (~covered[:-1] | edge))
            closes = np.flatnonzero(covered[:-1] & (~covered[1:] | edge))
            owner = words.row[opens] if len(opens) else opens
            hit = np.bincount(owner, weights=closes - opens, minlength=block.rows).astype(np.int64)
            seen = np.unique(words.row[begin] * max(1, len(windows.start)) + window) if len(begin) else begin
            window = seen % max(1, len(windows.start))
            many = np.diff(windows.edge)[window]
            item = windows.item[_runs(windows.edge[window], many)]
            pairs = np.unique(np.repeat(seen // max(1, len(windows.start)), many) * len(windows.items) + item) if len(item) else item
            listed = pairs // max(1, len(windows.items))
            cuts = lambda rows: pa.array(np.searchsorted(rows, np.arange(block.rows + 1)), pa.int32())
            spans = pa.StructArray.from_arrays([pa.array(opens - words.first[owner]), pa.array(closes - words.first[owner])], ["first", "last"])
            ids = pa.array(windows.items[pairs % max(1, len(windows.items))] if len(pairs) else pairs)
            lo = batch.slice(block.lo, block.rows)
            yield pa.RecordBatch.from_arrays(
                [lo.column(0), lo.column(2), pa.array(words.count), pa.array(hit), pa.ListArray.from_arrays(cuts(owner), spans), pa.ListArray.from_arrays(cuts(listed), ids)],
                ["doc_id", "text_key", "n_words", "n_hit", "spans", "item_ids"],
            )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans (hit word ranges, end exclusive), item_ids (sorted numerically)."""
    return _contamination(docs, benchmark, size, chunk_bytes).drop("text_key")


def _contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """contamination() with text_key, a hash of the text that was judged."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_key"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    schema = f"doc_id bigint, text_key bigint, n_words bigint, n_hit bigint, spans {_SPAN}, item_ids array<bigint>"
    found = []
    for k in range(chunks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k) if chunks > 1 else items
        windows = Windows([tuple(r) for r in part.collect()], size)  # at most about chunk_bytes
        counts = np.zeros(len(windows.vocabulary), dtype=np.int64)
        if len(counts):
            vocabulary = windows.vocabulary
            for word, n in texts.select("text").mapInArrow(lean(lambda b, v=vocabulary: _count(b, v)), "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect():
                counts[word] = n
        index = docs.sparkSession.sparkContext.broadcast(windows.anchored(counts))
        found.append(texts.mapInArrow(lean(lambda b, w=index: _probe(b, w.value)), schema))
    if chunks == 1:
        return found[0]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    merged = rows.groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"),
        (F.count(F.lit(1)) / chunks).cast("int").alias("times"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    covered = "aggregate(spans, named_struct('n', 0L, 'edge', 0L), (a, s) -> named_struct('n', a.n + greatest(0L, s.last - greatest(s.first, a.edge)), 'edge', greatest(a.edge, s.last)), a -> a.n)"
    return merged.withColumn("n_hit", F.expr(covered)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc_id", "text_key", "n_words", "n_hit", "spans", "item_ids")


def is_contaminated() -> F.Column:
    """The share of hit words that marks a document: a twentieth."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, all columns as they are.

    A row goes by its own text, whatever its doc_id: null, shared or repeated.
    """
    bad = _contamination(docs, benchmark).where(is_contaminated()).select(F.col("text_key").alias("__bad_text")).distinct()
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["__bad_text"], "left_anti")
