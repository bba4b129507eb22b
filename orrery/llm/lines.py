"""Line deduplication by a segment-partition edit join.

Lines within `edits` edits (insert, delete or replace one character) of each other are linked.  A line is split
into edits + 1 segments of even length; of two lines within that distance at least one segment of the
one occurs in the other, near its own place.  So each line of n characters is indexed by its segments and probes
the indexes of the lengths n - edits to n with the substrings whose start is compatible with the edits left and
right of them.  Keys that only one line uses are dropped.  Lines that share a key meet in cells of bounded size and are verified
there by banded bit-parallel edit distance, all pairs of a cell at once; only what connects leaves the cell.

The texts of lines that met are fetched by a second pass over the documents, which a bitmap of fixed size
(2 MB, from the ids of these lines) spares from shipping most others; beyond some 1e8 lines that met it spares none,
and each line's text is shuffled once.  A line's id is a 64-bit hash of its bytes: among n different lines
n * n / 4e19 are taken for copies of another.

Defined results: a line is what stands between line breaks; blank lines are never repeated; two lines are near if both have `least` characters and
`edits` edits lead from one to the other, shorter lines (of which two edits change much) only if they are equal; exact copies of a line are one line with many places;
the first place of a class, by doc_id and line number, is kept; null doc_ids come first; null and empty texts have one blank line;
repeated documents are repeated places, of which one (the first as the rows are read) is kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from orrery.llm.buckets import compare
from orrery.llm.common import cut, kept
from orrery.llm.components import components
from orrery.llm.textblocks import Hashes, blocks, lean, mix64

EDITS = 2
LEAST = 20
BITMAP = 1 << 24
#: Line ids that a task remembers while it makes keys.
REMEMBER = 1 << 19

_LINE = np.ones(256, dtype=bool)
_LINE[10] = False
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 11, 12, 13, 32]] = True


class Lines:
    """The non-empty lines of a block: bytes start..end, row, number in the row, id, whether all blank."""

    def __init__(self, block):
        words = block.words(lower=False, table=_LINE)
        self.data, self.start, self.end, self.row = block.data, words.start, words.end, words.row
        view = memoryview(block.data)
        self.id = np.array([xxh3_64_intdigest(view[a:z]) for a, z in zip(self.start.tolist(), self.end.tolist())], dtype=np.uint64).view(np.int64)
        breaks = np.append(0, np.cumsum(block.data == 10))
        self.number = breaks[self.start] - breaks[block.offset[self.row]]
        blank = np.append(0, np.cumsum(_BLANK[block.data]))
        self.solid = blank[self.end] - blank[self.start] < self.end - self.start


def _places(batches):
    for batch in batches:
        for block in blocks(batch.column(2)):
            lines = Lines(block)
            at = np.flatnonzero(lines.solid)
            row = pa.array(lines.row[at] + block.lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(lines.number[at]), pa.array(lines.id[at])], ["doc_id", "row", "line_no", "line_id"])


class Seen:
    """Line ids that a task has met, so that a frequent line gives its keys once and not with every block.

    At most `most` ids are remembered; beyond that those met again stay, and then all go.  So a line leaves a task once for every
    `most` / 2 other lines there, however often it occurs.
    """

    def __init__(self, most: int = REMEMBER):
        self.most, self.ids, self.again = most, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def fresh(self, ids: np.ndarray) -> np.ndarray:
        """Which of these different, sorted ids are new; they are old from now on."""
        known = np.isin(ids, self.ids, assume_unique=True)
        self.again = np.union1d(self.again, ids[known])
        if len(self.ids) + len(ids) > self.most:
            self.ids, self.again = (self.again if len(self.again) <= self.most // 2 else ids[:0]), ids[:0]
        self.ids = np.union1d(self.ids, ids)
        return ~known


def segment_keys(batches, edits: int, least: int, remember: int | None = None):
    """(key, line_id, indexed): what each line is indexed under and what it probes for."""
    seen = Seen(remember or REMEMBER)
    for batch in batches:
        for block in blocks(batch.column(0)):
            lines, hashes = Lines(block), Hashes(block.data)
            char = np.flatnonzero((block.data & 0xC0) != 0x80)
            edge = np.append(char, len(block.data))
            first, size = np.searchsorted(char, lines.start), np.searchsorted(char, lines.end) - np.searchsorted(char, lines.start)
            at = np.unique(lines.id, return_index=True)[1]  # copies in one block are one line
            at = at[lines.solid[at] & (size[at] >= least)]
            at = at[seen.fresh(lines.id[at])]
            first, size, ids = first[at], size[at], lines.id[at]
            out = []
            for shorter in range(edits + 1):
                length = size - shorter
                for i in range(edits + 1):
                    base, longer = length // (edits + 1), length % (edits + 1)
                    place = i * base + np.maximum(0, i - (edits + 1 - longer))
                    width = base + (i >= edits + 1 - longer)
                    for move in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
                        begin = place + move
                        fits = (length >= least) & (begin >= 0) & (begin + width <= size)
                        low = edge[np.minimum(first + np.maximum(begin, 0), len(edge) - 1)]
                        high = edge[np.minimum(first + np.maximum(begin, 0) + width, len(edge) - 1)]
                        key = mix64(hashes.of(low[fits], np.maximum(low, high)[fits]) + (length[fits] * 64 + i).astype(np.uint64))
                        out.append((key.view(np.int64), ids[fits], np.full(int(fits.sum()), shorter == 0 and move == 0)))
            if out and len(at):
                key, line, indexed = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(line), pa.array(indexed)], ["key", "line_id", "indexed"])


def _texts(batches, bitmap: np.ndarray):
    for batch in batches:
        for block in blocks(batch.column(0)):
            lines = Lines(block)
            bit = (lines.id.view(np.uint64) % np.uint64(BITMAP)).astype(np.int64)
            at = np.flatnonzero(lines.solid & ((bitmap[bit >> 3] >> (bit & 7)) & 1).astype(bool))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(lines.id[at]), pa.array([block.data[a:z].tobytes() for a, z in zip(lines.start[at], lines.end[at])], pa.binary())], ["line_id", "line"])


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of the column line_id, of BITMAP bits whatever the number of ids: bits are joined by grouped ORs, word by word."""
    word = F.shiftright("line_id", 6).bitwiseAND((BITMAP >> 6) - 1).alias("word")
    words = ids.select(word, F.expr("shiftleft(1L, cast(line_id & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    out = np.zeros(BITMAP >> 6, dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def within(left: list[np.ndarray], right: list[np.ndarray], edits: int) -> np.ndarray:
    """Whether each pair of character arrays is within so many edits: a band of 2 * edits + 1 diagonals as bits."""
    swap = [len(a) < len(b) for a, b in zip(left, right)]
    long = [b if s else a for a, b, s in zip(left, right, swap)]
    short = [a if s else b for a, b, s in zip(left, right, swap)]
    m, n = np.array([len(x) for x in long]), np.array([len(x) for x in short])
    rows, columns = int(m.max(initial=0)), int(n.max(initial=0))
    pattern = np.full((rows + 2 * edits + columns + 2, len(m)), -1, dtype=np.int64)
    text = np.full((columns, len(m)), -2, dtype=np.int64)
    for k, (a, b) in enumerate(zip(long, short)):
        pattern[edits : edits + len(a), k] = a
        text[: len(b), k] = b
    band = 2 * edits + 1
    full = np.uint64((1 << band) - 1)
    one = np.uint64(1)
    # bit j of column i stands for row i + j - edits; the last bit's diagonal is followed until it meets
    # the longer line's end, then that row is followed to the shorter line's end
    up = np.full(len(m), np.uint64(((1 << (edits + 1)) - 1) << edits), dtype=np.uint64)
    down = np.zeros(len(m), dtype=np.uint64)
    far = np.full(len(m), edits, dtype=np.int64)
    for i in range(columns):
        same = np.zeros(len(m), dtype=np.uint64)
        for j in range(band):
            same |= (pattern[i + j] == text[i]).astype(np.uint64) << np.uint64(j)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        plus = (down | ~(diagonal | up)) & full
        minus = diagonal & up
        live = i < n
        sliding = i < m - edits
        last = np.uint64(band - 1)
        far += live & sliding & ((diagonal >> last) & one == 0)
        bit = np.clip(m - 1 - i + edits, 0, band - 1).astype(np.uint64)
        far += np.where(live & ~sliding, ((plus >> bit) & one).astype(np.int64) - ((minus >> bit) & one).astype(np.int64), 0)
        up = (minus | ~((diagonal >> one) | plus)) & full
        down = (diagonal >> one) & plus
    return (far <= edits) & (m - n <= edits)


def _close(edits: int):
    def prepare(table: pa.Table):
        indexed = table.column("indexed").to_numpy(zero_copy_only=False)
        lines = [np.frombuffer(x.decode().encode("utf-32-le"), dtype=np.uint32) for x in table.column("line").to_pylist()]
        size = np.array([len(x) for x in lines])
        ids = table.column("line_id").to_numpy()

        def test(left, right):
            return (indexed[left] | indexed[right]) & (np.abs(size[left] - size[right]) <= edits)

        def settle(left, right):
            low, high = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
            _, one, back = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True, return_inverse=True)
            good = np.zeros(len(one), dtype=bool)
            order = np.argsort(size[left[one]], kind="stable")
            for lo in range(0, len(order), 512):
                at = order[lo : lo + 512]
                good[at] = within([lines[k] for k in left[one[at]]], [lines[k] for k in right[one[at]]], edits)
            return good[back.ravel()]

        return test, settle

    return prepare


def _near(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """Links between line ids: id, n, root."""
    texts = docs.select("text")
    # one exchange serves the search for keys of several lines and the rows under these keys; a line's copies are one in each task before it
    keyed = texts.mapInArrow(lean(lambda b: segment_keys(b, edits, least)), "key bigint, line_id bigint, indexed boolean").repartition("key")
    shared = keyed.groupBy("key").agg(F.min("line_id").alias("a"), F.max("line_id").alias("z"), F.max("indexed").alias("any")).where("a < z and any").select("key")
    met = cut(keyed.join(shared.hint("shuffle_hash"), "key").groupBy("key", "line_id").agg(F.max("indexed").alias("indexed")))
    ids = met.select("line_id").distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))
    lines = texts.mapInArrow(lean(lambda b: _texts(b, bitmap.value)), "line_id bigint, line binary").dropDuplicates(["line_id"])
    found = kept(lines.join(ids, "line_id", "left_semi"), "lines")
    return cut(compare(met.join(found, "line_id"), "key", "line_id", _close(edits), 256))

def _classed(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """line_classes of docs (doc_id, row, text) with the row of each line."""
    near = _near(docs, edits, least)
    labels = components(near.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "line_id")
    # written, so that a row keeps its number
    places = cut(docs.select("doc_id", "row", "text").mapInArrow(lean(_places), "doc_id bigint, row bigint, line_no bigint, line_id bigint"))
    first = F.min(F.struct("doc_id", "row", "line_no")).alias("first")  # nulls come first
    by_line = places.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), first)
    named = by_line.join(labels, "line_id", "left").withColumn("label", F.coalesce("label", "line_id"))
    classes = named.groupBy("label").agg(F.sum("n").alias("n_places"), F.count(F.lit(1)).alias("n_lines"), F.min("first").alias("first")).where("n_places > 1")
    repeated = named.select("line_id", "label").join(classes, "label").drop("label")
    out = places.join(repeated, "line_id", "left")
    alone = F.col("first").isNull()
    home = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = alone | (F.col("row") == F.col("first.row")) & (F.col("line_no") == F.col("first.line_no"))
    return out.select("doc_id", "row", "line_no", home.alias("class_doc_id"), F.coalesce("first.line_no", "line_no").alias("class_line_no"), F.coalesce("n_places", F.lit(1)).alias("n_places"), F.coalesce("n_lines", F.lit(1)).alias("n_lines"), kept.alias("kept"))


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """One row per line that is not blank: doc_id, line_no (from 0), class_doc_id and class_line_no (first place of its class), n_places, n_lines (different lines of the class), kept."""
    return _classed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text"), edits, least).drop("row")


def without_repeats(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """docs with the text reduced to blank lines and the first place of each class; the columns stay as they are.

    A line goes by its own row, whatever else has the row's doc_id; of rows with equal id, and of repeated rows, one is the first.
    """
    held = cut(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    gone = _classed(held.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "row", F.col("doc.text").alias("text")), edits, least)
    gone = gone.where("not kept").groupBy("row").agg(F.collect_set("line_no").alias("gone"))
    joined = held.join(gone, "row", "left")
    stay = F.filter(F.split("doc.text", "\n"), lambda x, i: ~F.array_contains("gone", i.cast("long")))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(stay, "\n"))
    return joined.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")
