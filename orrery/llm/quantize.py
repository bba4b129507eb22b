"""Product quantisation of vectors in integers, with codebooks searched by slices of bitmasks.

A vector's components become integers, the vector is cut into parts, and each part position has a codebook of
up to 256 entries.  Rounds of assigning every part to its nearest entry and replacing each entry by the floor of its parts'
mean fit the codebooks; a last pass assigns again.  Everything is integer arithmetic, so results do not depend on how rows are dealt.

Search.  For each dimension the entries' coordinates are sorted, and place i of the order carries the mask (64-bit words)
of the i entries before it.  Two binary searches give the slice of entries whose coordinate lies within a radius of a query's; the
slice's mask is the difference of two prefix masks, and the AND over all dimensions leaves the entries of a cube around the query.  The
initial radius is about half the distance (largest coordinate difference) between an entry and its nearest fellow; queries without an entry in
their cube double it.  The best entry of a cube bounds the distance, and where that bound lies outside the cube, the cube of the bound holds every
entry that can be nearest.  So candidates are exact, ties included; the least index wins.

On Spark: each round is one scan (vectors are pruned to one column), summed inside tasks to one row for each part and entry,
then by grouped sums.  The driver holds the codebooks only (entries x dimensions integers).  Nothing is cached or shuffled but sums.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are rows of another length than the most
common one (the greater of equally frequent ones), which no codebook fits; a length that `parts` does not divide is cut at i * length // parts.  The
first codebook takes the smallest vec_ids (rows with equal ids by their vectors, null ids last); fewer rows than entries make a smaller codebook.  Repeated rows count as often
as they come; null labels are one label; an empty table gives no rows; other columns are ignored.  A component so large that
a part's squared distance could leave 64 bits (beyond some 1e5 at 64 dimensions and scale 1024) stops the job with an error, as no result in 64-bit integers exists.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut
from orrery.llm.textblocks import lean
from orrery.llm.vectors import common_length, finite, floors

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Queries that are compared at a time.
BLOCK = 4096
#: From this share of candidates on, distances come from one matrix product instead of pair by pair.
DENSE = 1 / 16


class Slices:
    """One codebook: an exact search for the nearest entry."""

    def __init__(self, book: np.ndarray):
        entries, width = book.shape
        words = -(-entries // 64)
        self.book = book
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.take_along_axis(book, order, axis=0).T.copy()
        self.prefix = np.zeros((width, entries + 1, words), dtype=np.uint64)
        for d in range(width):
            own = np.zeros((entries, words), dtype=np.uint64)
            own[np.arange(entries), order[:, d] // 64] = np.uint64(1) << (order[:, d] % 64).astype(np.uint64)
            np.bitwise_or.accumulate(own, axis=0, out=self.prefix[d, 1:])
        apart = np.abs(book[:, None, :] - book[None, :, :]).max(axis=2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.radius = max(1, int(np.median(apart.min(axis=1))) // 2) if entries > 1 else 1

    def cube(self, queries: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(queries, words): masks of the entries within the radius in every dimension."""
        mask = np.full((len(queries), self.prefix.shape[2]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for d, (line, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(line, queries[:, d] - radius, side="left")
            high = np.searchsorted(line, queries[:, d] + radius, side="right")
            mask &= prefix[high] ^ prefix[low]
        return mask

    def _best(self, queries: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry under each mask and its squared distance; -1 for an empty mask."""
        inside = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(self.book)].astype(bool)
        if inside.mean() >= DENSE:
            most = 2 * max(np.abs(queries).max(initial=0), np.abs(self.book).max())
            kind = np.float64 if int(most) ** 2 * queries.shape[1] < 1 << 53 else np.int64  # both exact
            x, c = queries.astype(kind), self.book.astype(kind)
            distance = ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
            distance[~inside] = np.iinfo(np.int64).max
            entry = distance.argmin(axis=1)
            distance = distance[np.arange(len(entry)), entry]
            return np.where(inside.any(axis=1), entry, -1), distance
        query, entry = np.nonzero(inside)
        out, least = np.full(len(queries), -1), np.full(len(queries), np.iinfo(np.int64).max)
        if len(query):
            apart = ((queries[query] - self.book[entry]) ** 2).sum(axis=1)
            first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            low = np.minimum.reduceat(apart, first)
            many = np.diff(np.append(first, len(query)))
            least[query[first]] = low
            out[query[first]] = np.minimum.reduceat(np.where(apart == np.repeat(low, many), entry, len(self.book)), first)
        return out, least

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry and its squared distance."""
        found = [self._nearest(queries[lo : lo + BLOCK]) for lo in range(0, len(queries), BLOCK)]
        entry, distance = zip(*found) if found else ((np.zeros(0, np.int64),), (np.zeros(0, np.int64),))
        return np.concatenate(entry), np.concatenate(distance)

    def _nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        radius = np.full(len(queries), self.radius)
        entry, distance = np.full(len(queries), -1), np.zeros(len(queries), dtype=np.int64)
        left = np.arange(len(queries))
        while len(left):
            best, apart = self._best(queries[left], self.cube(queries[left], radius[left]))
            hit = best >= 0
            entry[left[hit]], distance[left[hit]] = best[hit], apart[hit]
            left = left[~hit]
            radius[left] *= 2
        bound = np.sqrt(distance.astype(np.float64)).astype(np.int64) + 1
        open_ = np.flatnonzero(bound > radius)
        if len(open_):
            entry[open_], distance[open_] = self._best(queries[open_], self.cube(queries[open_], bound[open_]))
        return entry, distance


def edges(dim: int, parts: int) -> list[int]:
    return [i * dim // parts for i in range(parts + 1)]


def _limit(dim: int, parts: int) -> int:
    return math.isqrt(((1 << 63) - 1) // max(np.diff(edges(dim, parts)).max(), 1)) // 4


def _sums(batches, books: list[np.ndarray], dim: int, scale: int):
    """part, entry, n and sums of the parts that this task assigns."""
    search, cuts = [Slices(b) for b in books], edges(dim, len(books))
    n = [np.zeros(len(b), dtype=np.int64) for b in books]
    total = [np.zeros_like(b) for b in books]
    for batch in batches:
        own = floors(batch.column(0), dim, scale, _limit(dim, len(books)))
        for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            entry, _ = search[p].nearest(own[:, lo:hi])
            order = np.argsort(entry, kind="stable")
            used, first, many = np.unique(entry[order], return_index=True, return_counts=True)
            if len(used):
                n[p][used] += many
                total[p][used] += np.add.reduceat(own[order, lo:hi], first, axis=0)
    for p, (many, sums) in enumerate(zip(n, total)):
        used = np.flatnonzero(many)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, dtype=np.int32)), pa.array(used.astype(np.int32)), pa.array(many[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])


def _codes(batches, books: list[np.ndarray], dim: int, scale: int):
    search, cuts = [Slices(b) for b in books], edges(dim, len(books))
    for batch in batches:
        own = floors(batch.column(2), dim, scale, _limit(dim, len(books)))
        found = [s.nearest(own[:, lo:hi]) for s, lo, hi in zip(search, cuts, cuts[1:])]
        code = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
        error = np.sum([distance for _, distance in found], axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["vec_id", "label", "code", "error"])


def codebooks(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """One codebook (entries, width) for each part, fitted on all vectors (vec_id, vector: finite, of this length)."""
    if entries > 256:
        raise ValueError("a code is one byte: 256 entries at most")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).toArrow()
    start = floors(first.column("vector").combine_chunks(), dim, scale, _limit(dim, parts))
    cuts = edges(dim, parts)
    books = [start[:, lo:hi].copy() for lo, hi in zip(cuts, cuts[1:])]
    for _ in range(rounds):
        held = books
        summed = vectors.select("vector").mapInArrow(lean(lambda b, held=held: _sums(b, held, dim, scale)), "part int, entry int, n bigint, sums array<bigint>")
        one = summed.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
        found = one.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(20,0)")).alias("sum")).toArrow()
        books = [b.copy() for b in held]
        for part, entry, at, n, total in zip(*(found.column(c).to_pylist() for c in ("part", "entry", "at", "n", "sum"))):
            books[part][entry, at] = int(total) // n
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, comma-joined, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def quantized(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(one row per kept vector: vec_id, label, code (a byte for each part), error, label_error; the codebooks)."""
    spark, kind = vectors.sparkSession, vectors.schema["label"].dataType.simpleString()
    sound = finite(vectors)
    dim = common_length(sound)
    if not dim:
        return spark.createDataFrame([], f"vec_id bigint, label {kind}, code binary, error bigint, label_error bigint"), []
    fit = sound.where(F.size("vector") == dim)
    books = codebooks(fit, dim, parts, entries, rounds, scale)
    coded = cut(fit.mapInArrow(lean(lambda b: _codes(b, books, dim, scale)), f"vec_id bigint, label {kind}, code binary, error bigint"))
    by_label = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("own"))).drop("own"), books
