"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

Codes.  A unit vector o is rotated by random orthogonal matrices (a fixed seed for each
dimension) and reduced to the signs of its coordinates.  With the first rotation's signs s
the factor f = <s, o> / sqrt(D) is stored, and <s, q> / (f sqrt(D)) is an unbiased estimate of
<o, q>: its error is sqrt(1 - <o, q>**2) sqrt(1 - f**2) / f times a coordinate of a random
direction in D - 1 dimensions.  Pairs whose estimate lies more than `DEVIATIONS` standard errors
below what the least cosine allows are rejected; all others are computed exactly, in double
precision, from the vectors.

Candidates.  Vectors meet where labels and a whole band of code bits agree.  At cosine
0.93 a bit agrees with probability 0.88; a band has about as many bits as the logarithm of
the largest label's rows, and there are as many bands as bring the probability that a pair at the least cosine
never meets under 1e-5.  Inside a bucket all pairs are compared in bounded cells, and a pair
counts only in the first band that it shares, so links are counted once.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and null labels, link with nothing; vectors of different lengths do not link; rows with one
vec_id are one vector (the least by label, then embedding, counts); rows without vec_id are returned without
links, with a null component and kept false; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.buckets import compare
from orrery.llm.common import cut
from orrery.llm.components import components
from orrery.llm.textblocks import mix64

COSINE = 0.93
MISS = 1e-5
DEVIATIONS = 6.0
SEED = 20240611


@functools.lru_cache(maxsize=8)
def rotation(dim: int, bits: int) -> np.ndarray:
    """(dim, bits rounded up to whole rotations): orthogonal matrices side by side."""
    made = []
    for k in range(-(-bits // dim)):
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).standard_normal((dim, dim)))
        made.append(q * np.sign(np.diag(r)))
    return np.concatenate(made, axis=1)


def plan(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a band and number of bands for a largest label of so many rows."""
    agree = 1 - math.acos(cosine) / math.pi
    width = min(20, max(8, math.ceil(math.log2(max(2, rows)))))
    return width, math.ceil(math.log(miss) / math.log(1 - agree**width))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _bands(bits: np.ndarray, width: int, bands: int) -> np.ndarray:
    powers = (1 << np.arange(width)).astype(np.int64)
    return bits[:, : width * bands].reshape(len(bits), bands, width) @ powers


def _encode(batches, width: int, bands: int, single: bool):
    for batch in batches:
        ids, label, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        size = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
        first = vectors.offsets.to_numpy()[:-1]
        flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
        for dim in np.unique(size[size > 0]):
            at = np.flatnonzero(size == dim)
            own = flat[first[at][:, None] + np.arange(dim)]
            sound = np.isfinite(own).all(axis=1)
            sound[sound] = (own[sound] != 0).any(axis=1)
            at, own = at[sound], own[sound]
            if not len(at):
                continue
            unit = _unit(own)
            turned = unit @ rotation(int(dim), width * bands)
            signs = turned > 0
            factor = np.abs(turned[:, :dim]).sum(axis=1) / math.sqrt(dim)
            band = _bands(signs, width, bands)
            key = mix64(band.astype(np.uint64) + (np.arange(bands) * (1 << 32)).astype(np.uint64))
            key = mix64(key + mix64(label[at].astype(np.int64).view(np.uint64) * np.uint64(4096) + np.uint64(dim))[:, None])
            listed = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), listed(own.astype(np.float32), pa.float32()) if single else listed(own, pa.float64()), pa.array([c.tobytes() for c in np.packbits(signs, axis=1)], pa.binary()), pa.array(factor), listed(key.view(np.int64), pa.int64())],
                ["vec_id", "vector", "code", "factor", "buckets"],
            )


def _square(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in double precision, and the length of each list."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy().astype(np.float64), np.diff(lists.offsets.to_numpy())


def _linked(width: int, bands: int, cosine: float):
    def prepare(table: pa.Table):
        band = table.column("band").to_numpy()
        factor = table.column("factor").to_numpy()
        values, sizes = _square(table.column("vector"))
        codes = table.column("code").to_pylist()
        start = np.append(0, np.cumsum(sizes))
        made = {}
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            unit = _unit(values[start[at][:, None] + np.arange(dim)])
            bits = np.unpackbits(np.frombuffer(b"".join(codes[k] for k in at), np.uint8).reshape(len(at), -1), axis=1)
            slot = np.zeros(len(sizes), dtype=np.int64)
            slot[at] = np.arange(len(at))
            made[int(dim)] = slot, unit, unit @ rotation(int(dim), width * bands)[:, :dim], bits[:, :dim].astype(np.float64) * 2 - 1, _bands(bits.astype(np.int64), width, bands)
        spread = math.sqrt(1 - cosine**2) * DEVIATIONS

        def test(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            mask = np.zeros(len(left), dtype=bool)
            for dim, (slot, unit, turned, signs, code_bands) in made.items():
                pick = np.flatnonzero((sizes[left] == dim) & (sizes[right] == dim))
                a, b, f = slot[left[pick]], slot[right[pick]], factor[left[pick]]
                estimate = np.einsum("ij,ij->i", signs[a], turned[b]) / (f * math.sqrt(dim))
                error = spread * np.sqrt(np.maximum(0, 1 - f**2)) / f / math.sqrt(max(1, dim - 1))
                keep = estimate >= cosine - error - 1e-9
                pick, a, b = pick[keep], a[keep], b[keep]
                keep = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                pick, a, b = pick[keep], a[keep], b[keep]
                mask[pick] = (code_bands[a] == code_bands[b]).argmax(axis=1) == band[left[pick]]
            return mask

        return test, None

    return prepare


def near_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, block: int = 512) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "float" if single else "double"  # single precision travels as it is; all arithmetic is double
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    one = named.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    labelled = one.where("label is not null and embedding is not null")
    most = labelled.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    width, bands = plan(most, cosine, miss)
    coded = cut(labelled.select("vec_id", "label", "embedding").mapInArrow(lambda x: _encode(x, width, bands, single), f"vec_id bigint, vector array<{kind}>, code binary, factor double, buckets array<bigint>"))
    rows = coded.select("vec_id", "vector", "code", "factor", F.posexplode("buckets").alias("band", "bucket"))
    found = cut(compare(rows, "bucket", "vec_id", _linked(width, bands, cosine), block))
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    out = one.select("vec_id").join(links.withColumnRenamed("id", "vec_id"), "vec_id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "vec_id").alias("component_id"))
    nameless = named.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
