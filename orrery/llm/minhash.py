"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

Signatures.  A document is the set of its distinct five-word shingles, all of weight 1: links are
decided by the Jaccard similarity of these sets, and only equal weights make the signatures estimate it
(a line repeated twenty times would otherwise weigh as much as four).
A shingle of weight w sends Poisson arrivals of rate w; the points come from a hash of the
shingle, so equal shingles send equal points in every document.  Each arrival falls into
one of `components` slots, and a slot keeps the shingle that arrived first.  A shingle stops
as soon as its next arrival is later than the latest slot of its document, so long
documents need little more than one arrival for each shingle.  The share of equal slots
estimates the probability Jaccard similarity, which equals Jaccard for equal weights.  prob_min_hash()
itself takes any weights.

Candidates.  `rows` slots make a band; documents that agree in any of `bands` bands meet.
At Jaccard 0.8 a pair is missed with probability (1 - 0.8**4)**24 = 3e-6.  A bucket is not
expanded into its pairs: each member is compared with four pivots (least and greatest
key, least and greatest scrambled key), which is every pair of a bucket of three.  A bucket
whose members are then in one component is settled.  The members of the others meet
once more, where one of their first nine slots agrees (a pair at 0.8 never meets with probability
5e-7), in cells of bounded rows and bytes; there pairs of different components are compared by their sets of shingles, and
only what connects leaves the cell (a spanning forest, linear in the members).  So no link between components is lost, and no task
or shuffle holds the pairs of a group.  In a group that stays in many components the cells compare all pairs: that work, and
the copies of rows that the cells take, grow with the square of the group.

Verification.  Pairs whose signatures agree too little are dropped (below 0.55; a pair at 0.8
falls there with probability 1e-9), the rest are compared by the exact Jaccard similarity
of their sets of 64-bit shingle hashes, read from whole texts.

Identity.  Texts with one 64-bit hash count as one; among n different texts that happens n * n / 4e19 times (once in
6e9 texts).

Defined results: exact copies of a text are one node and share a class; null, empty and
wordless texts are each a class of their own; a text of one to four words has one shingle;
class_id is the least doc_id of the class; a null doc_id never names a class (it is null
where every document of a class has none); repeated rows give one row each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.buckets import compare
from orrery.llm.common import cut, kept
from orrery.llm.components import components
from orrery.llm.textblocks import blocks, lean, mix64

SHINGLE = 5
#: Text bytes of the pairs that are verified at a time.
PAIR_BYTES = 4 << 20
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
LEAST_ESTIMATE = 0.55
MEETING_SLOTS = 9

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(0xA0761D6478BD642F)


def distinct_shingles(block, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row: (row, hash), sorted by row."""
    words = block.words()
    grams, row = words.grams(words.hashes(), n)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return row[new], grams[new]


def prob_min_hash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, components: int) -> np.ndarray:
    """(rows, components): the element that arrives first in each slot; 0 for rows without elements."""
    first = np.full(rows * components, np.inf)
    winner = np.zeros(rows * components, dtype=np.uint64)
    latest = np.full(rows, np.inf)
    active, clock, drawn, burst = np.arange(len(element)), np.zeros(len(element)), 0, 1
    while len(active):
        own = element[active]
        draw = mix64(own[:, None] + _GOLD * (drawn + 1 + np.arange(burst)).astype(np.uint64)[None, :])
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        time = clock[active][:, None] + np.cumsum(-np.log(uniform) / weight[active][:, None], axis=1)
        slot = (mix64(draw ^ _SLOT) % np.uint64(components)).astype(np.int64) + (row[active] * components)[:, None]
        early = time < latest[row[active]][:, None]
        at, when = slot[early], time[early]
        np.minimum.at(first, at, when)
        won = when == first[at]
        winner[at[won]] = np.broadcast_to(own[:, None], early.shape)[early][won]
        latest = first.reshape(rows, components).max(axis=1)
        clock[active] = time[:, -1]
        active = active[time[:, -1] < latest[row[active]]]
        drawn, burst = drawn + burst, min(64, burst * 2)
    return winner.reshape(rows, components)


def _signatures(batches, bands: int, rows: int):
    for batch in batches:
        for block in blocks(batch.column(1)):
            row, element = distinct_shingles(block)
            sig = prob_min_hash(row, element, np.ones(len(element)), block.rows, bands * rows)
            has = np.bincount(row, minlength=block.rows) > 0
            key = batch.column(0).slice(block.lo, block.rows).filter(pa.array(has))
            sig = sig[has]
            band = np.full((len(sig), bands), np.uint64(7))
            for k in range(rows):
                band = mix64(band * _GOLD + sig.reshape(len(sig), bands, rows)[:, :, k])
            low = (sig & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    key,
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * bands, pa.int32()), pa.array(band.ravel().view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * MEETING_SLOTS, pa.int32()), pa.array(sig[:, :MEETING_SLOTS].ravel().view(np.int64))),
                    pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer((np.arange(len(sig) + 1) * bands * rows).astype(np.int32)), pa.py_buffer(low.tobytes())]),
                ],
                ["key", "bands", "slots", "signature"],
            )


def _slots(column: pa.Array) -> np.ndarray:
    offset = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offset[0] : offset[-1]]
    return data.reshape(len(column), -1)


def _agreeing(batches, least: float):
    for batch in batches:
        if batch.num_rows:
            share = (_slots(batch.column(2)) == _slots(batch.column(3))).mean(axis=1)
            yield batch.select([0, 1]).filter(pa.array(share >= least))


def jaccard(left: pa.Array, right: pa.Array, n: int = SHINGLE) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of each pair of texts."""
    sets = []
    for texts in (left, right):
        parts = []
        for block in blocks(texts):
            row, element = distinct_shingles(block, n)
            parts.append((row + block.lo, element))
        sets.append([np.concatenate(x) for x in zip(*parts)])
    (ra, ea), (rb, eb) = sets
    both_row, both = np.concatenate([ra, rb]), np.concatenate([ea, eb])
    order = np.lexsort((both, both_row))
    same = (both[order][1:] == both[order][:-1]) & (both_row[order][1:] == both_row[order][:-1])
    shared = np.bincount(both_row[order][1:][same], minlength=len(left))
    union = np.bincount(both_row, minlength=len(left)) - shared
    return shared / np.maximum(union, 1)


def _verified(batches, least: float):
    for batch in batches:
        size = np.cumsum(_bytes(batch.column(2)) + _bytes(batch.column(3)))
        lo = 0
        while lo < batch.num_rows:  # a bounded number of bytes at a time
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PAIR_BYTES, side="right")))
            part = batch.slice(lo, hi - lo)
            yield part.select([0, 1]).filter(pa.array(jaccard(part.column(2), part.column(3)) >= least))
            lo = hi


def _bytes(texts: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy().astype(np.int64)


def _sets(batches):
    """(key, set): the distinct shingles of a text, 8 bytes each."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            row, element = distinct_shingles(block)
            edge = np.searchsorted(row, np.arange(block.rows + 1)).astype(np.int64) * 8
            held = pa.Array.from_buffers(pa.large_binary(), block.rows, [None, pa.py_buffer(edge), pa.py_buffer(element)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.rows), held.cast(pa.binary())], ["key", "set"])


def _links(pairs: DataFrame, unique: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys that are similar enough; a written table."""
    sig = unique.select("key", "signature")
    likely = (
        pairs.join(sig.withColumnsRenamed({"key": "a", "signature": "sa"}), "a")
        .join(sig.withColumnsRenamed({"key": "b", "signature": "sb"}), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(lean(lambda x: _agreeing(x, LEAST_ESTIMATE)), "a bigint, b bigint")
    )
    full = (
        likely.join(texts.withColumnsRenamed({"key": "a", "text": "ta"}), "a")
        .join(texts.withColumnsRenamed({"key": "b", "text": "tb"}), "b")
        .select("a", "b", "ta", "tb")
    )
    return cut(full.mapInArrow(lean(lambda x: _verified(x, similarity)), "a bigint, b bigint"))


def _bridging(similarity: float):
    """For cells: pairs of different components that meet first in this slot, agree enough, and are similar."""

    def prepare(table: pa.Table):
        label, slot = table.column("label").to_numpy(), table.column("slot").to_numpy()
        slots = table.column("slots").combine_chunks().flatten().to_numpy().reshape(-1, MEETING_SLOTS)
        signature = _slots(table.column("signature").combine_chunks())
        held = table.column("set").combine_chunks()
        edge = np.frombuffer(held.buffers()[1], dtype=np.int32)[held.offset : held.offset + len(held) + 1] // 8
        number = np.frombuffer(held.buffers()[2] or b"", dtype=np.uint64)[edge[0] : edge[-1]]
        edge = edge.astype(np.int64) - edge[0]
        size = np.diff(edge)
        number = np.unique(number, return_inverse=True)[1].astype(np.int32)

        def test(left, right):
            mask = label[left] != label[right]
            mask[mask] = np.minimum(size[left[mask]], size[right[mask]]) >= similarity * np.maximum(size[left[mask]], size[right[mask]]) - 1e-9
            at = np.flatnonzero(mask)
            first = (slots[left[at]] == slots[right[at]]).argmax(axis=1) == slot[left[at]]
            at = at[first]
            agree = (signature[left[at]] == signature[right[at]]).mean(axis=1) >= LEAST_ESTIMATE
            mask[:] = False
            mask[at[agree]] = True
            return mask

        def settle(left, right):
            shared = np.zeros(len(left), dtype=np.int64)
            order = np.argsort(left, kind="stable")
            present = np.zeros(number.max(initial=0) + 1, dtype=np.int32)
            for group in np.split(order, np.flatnonzero(np.diff(left[order])) + 1):
                own = number[edge[left[group[0]]] : edge[left[group[0]] + 1]]
                present[own] = 1
                many = size[right[group]]
                at = np.repeat(edge[right[group]] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
                shared[group] = np.add.reduceat(present[number[at]], np.append(0, np.cumsum(many)[:-1]))
                present[own] = 0
            return shared / (size[left] + size[right] - shared) >= similarity

        return test, settle

    return prepare


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id, kept (doc_id is its class's class_id)."""
    named, labels = _labelled(docs, similarity, bands, rows)
    nodes = named.groupBy("key").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    classes = nodes.groupBy("label").agg(F.min("least").alias("class_id"))
    by_key = nodes.join(classes, "label").select("key", "class_id")
    out = named.select("doc_id", "key", _worded().alias("worded")).join(by_key, "key")
    return out.select("doc_id", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _worded() -> F.Column:
    return F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _labelled(docs: DataFrame, similarity: float, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text, key of the text), and the component (node, label) of each key that is linked."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("key"))
    texts = named.select("key", "text")
    unique = cut(texts.mapInArrow(lean(lambda x: _signatures(x, bands, rows)), "key bigint, bands array<bigint>, slots array<bigint>, signature binary").dropDuplicates(["key"]))
    member = unique.select("key", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "key")
    scrambled = F.xxhash64("key", F.lit(17))
    pivots = (
        member.groupBy("bucket")
        .agg(F.min("key").alias("p0"), F.max("key").alias("p1"), F.min_by("key", scrambled).alias("p2"), F.max_by("key", scrambled).alias("p3"))
        .where("p0 < p1")
    )
    met = cut(member.join(pivots, "bucket"))  # what is alone in all its buckets goes no further
    compared = met.select("key", F.explode(F.array("p0", "p1", "p2", "p3")).alias("pivot")).where("key <> pivot")
    pairs = compared.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
    found = kept(texts.dropDuplicates(["key"]).join(met.select("key").distinct(), "key", "left_semi"), "texts")
    links = _links(pairs, unique, found, similarity)
    labels = components(links)

    placed = met.select("bucket", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    unsettled = placed.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("n")).where("l0 < l1 and n > 3").select("bucket")
    left = placed.join(unsettled, "bucket", "left_semi").select("key", "label").distinct()
    sets = found.mapInArrow(lean(_sets), "key bigint, set binary")
    left = left.join(unique.select("key", "slots", "signature"), "key").join(sets, "key")
    meeting = left.select("*", F.posexplode("slots").alias("slot", "value")).withColumn("meet", F.xxhash64("slot", "value")).drop("value")
    bridges = compare(meeting, "meet", "key", _bridging(similarity), weight=F.octet_length("set")).select(F.col("id").alias("a"), F.col("root").alias("b"))
    return named, components(links.union(cut(bridges)))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, all columns as they are: that of the least doc_id, a null doc_id last.

    A row goes by its own text, whatever else has its doc_id; of rows with equal id one stays, by a hash of text
    and row.  Of null, empty and wordless texts one row of each doc_id and text stays (null is an id here).
    """
    labels = _labelled(docs, similarity)[1].select(F.col("node").alias("key"), "label")
    whole = [c for c, kind in docs.dtypes if "map<" not in kind]
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.xxhash64(*whole).alias("row"), _worded().alias("worded")).join(labels, "key", "left")
    # wordless texts are classes by id
    told = told.withColumn("label", F.coalesce("label", "key")).withColumn("own", F.when(~F.col("worded"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    least = told.groupBy("label", "own").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "row")).alias("one"))
    stay = least.select(F.col("one.key").alias("__key"), F.col("one.row").alias("__row"))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("__key"), F.xxhash64(*whole).alias("__row"))
    return keyed.join(stay, ["__key", "__row"], "left_semi").dropDuplicates(["__key", "__row"]).select("doc.*")
