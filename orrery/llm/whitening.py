"""Whitening of embeddings by principal components, refined in mixed precision.

Components become integers x = floor(scale * c) + shift.  One scan sums them exactly; a second scan sums products of the integers
less the floor of their mean, so what is multiplied is centred and the sums are exact; the driver turns them into the
covariance as quotients of integers.  Only sums of the size of the covariance (dimensions squared) ever reach it.

Refinement.  Eigenvectors of the covariance in single precision are the start.  Each step of the iteration of Ogita and Aishima takes four
matrix products in extended precision: R = I - X'X (how far X is from orthogonal) and S = X'AX (how far from diagonal) give a
correction E that is added as X + XE, and the error squares each time.  Where two eigenvalues are nearer to each other than the step can
tell, their eigenvectors are only made orthogonal; such clusters are solved on their own: the small matrix X'(A - m)X of the
cluster, m its mean, is diagonalised in double precision and X turned by its eigenvectors, which shows the cluster's inner
gaps at their own scale, and the steps go on.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are rows of another length than the most common one
(the greater of equally frequent ones); every other row is in the fit list, as often as it comes, whatever its vec_id.  A component along which
nothing varies (an eigenvalue of at most 2**-52 times dimensions of the largest) has null for whitened and is not in identity_error, which is 0 where no component varies; explained
is 0 where the trace is 0.  Vectors of fewer dimensions than `most` have as many components as dimensions; deviation is null where it does not fit into 64 bits; an empty table gives no rows; other
columns are ignored.  An x beyond 2**40 stops the job with an error.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut
from orrery.llm.textblocks import lean
from orrery.llm.vectors import common_length, finite, floors

SCALE, SHIFT, MOST = 64, 1_000_000, 32
LIMIT = 1 << 40
STEPS = 30
FAR = 200
_WIDE = np.longdouble


def _whole(batch: pa.RecordBatch, column: int, dim: int, scale: int, shift: int) -> np.ndarray:
    return floors(batch.column(column), dim, scale, LIMIT) + shift


def _product(own: np.ndarray) -> np.ndarray:
    """own' own, exactly: in doubles, 64-bit or unbounded integers, whichever holds all its sums."""
    most = int(np.abs(own).max(initial=0)) ** 2 * len(own)
    if most < 1 << 53:
        return (own.T.astype(np.float64) @ own.astype(np.float64)).astype(np.int64).astype(object)
    if most < 1 << 63:
        return (own.T @ own).astype(object)
    return own.T.astype(object) @ own.astype(object)


def _totals(batches, dim: int, scale: int, shift: int):
    n, total = 0, np.zeros(dim, dtype=object)
    for batch in batches:
        own = _whole(batch, 0, dim, scale, shift)
        n += len(own)
        total += own.sum(axis=0).astype(object)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["at", "n", "total"])


def _products(batches, dim: int, scale: int, shift: int, centre: np.ndarray):
    total, some = np.zeros((dim, dim), dtype=object), False
    for batch in batches:
        total += _product(_whole(batch, 0, dim, scale, shift) - centre)
        some = True
    if some:
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i * dim + j), pa.array(map(Decimal, total[i, j]), pa.decimal128(38, 0))], ["at", "total"])


def exact_covariance(vectors: DataFrame, dim: int, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, list[int], list[list[Fraction]]]:
    """(rows n, sums S, covariance with divisor n as fractions) of the vectors' integers."""
    one = vectors.select("vector")
    found = one.mapInArrow(lean(lambda b: _totals(b, dim, scale, shift)), "at bigint, n bigint, total decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    n, sums = found[0]["n"], [0] * dim
    for row in found:
        sums[row["at"]] = int(row["total"])
    middle = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    centre = np.array(middle, dtype=np.int64)
    made = one.mapInArrow(lean(lambda b: _products(b, dim, scale, shift, centre)), "at bigint, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    out = [[Fraction(0)] * dim for _ in range(dim)]
    for at, total in zip(made.column("at").to_pylist(), made.column("total").to_pylist()):
        i, j = divmod(at, dim)
        out[i][j] = out[j][i] = Fraction(n * int(total) - rest[i] * rest[j], n * n)
    return n, sums, out


def _clusters(values: np.ndarray, reach) -> list[np.ndarray]:
    """Places of eigenvalues that hang together by gaps of at most `reach`, two or more each."""
    order = np.argsort(values)
    return [c for c in np.split(order, np.flatnonzero(np.diff(values[order]) > reach) + 1) if len(c) > 1]


def refined(a: np.ndarray, x: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of the symmetric matrix a in extended precision, from approximate eigenvectors x."""
    a, x = a.astype(_WIDE), x.astype(_WIDE)
    one, size = np.eye(len(a), dtype=_WIDE), np.sqrt((a * a).sum(dtype=_WIDE))
    floor = 8 * len(a) * np.finfo(_WIDE).eps
    for _ in range(steps):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        away = s - np.diag(np.diag(s))
        if np.abs(r).max() <= floor and np.abs(away).max() <= floor * size:
            break
        reach = FAR * (np.sqrt((away * away).sum()) + size * np.sqrt((r * r).sum()))  # so no correction exceeds 1 / FAR
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= reach
        x = x + x @ np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        for own in _clusters(values, reach):
            part = x[:, own]
            small = part.T @ (a @ part) - values[own].mean() * (part.T @ part)
            top = np.abs(small).max()
            if top > 0:
                turn = np.linalg.eigh((small / top).astype(np.float64))[1].astype(_WIDE)
                turn += turn @ (np.eye(len(own), dtype=_WIDE) - turn.T @ turn) / 2  # orthogonal to the wider precision
                x[:, own] = part @ turn
    for _ in range(2):  # where gaps are as small as rounding, the last step need not have left X orthogonal
        x = x + x @ (one - x.T @ x) / 2
    values = np.array([v @ (a @ v) / (v @ v) for v in x.T])
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def principal(covariance: list[list[Fraction]]) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns), correct to double precision."""
    high = np.array([[float(v) for v in row] for row in covariance])
    low = np.array([[float(v - Fraction(h)) for v, h in zip(row, near)] for row, near in zip(covariance, high.tolist())])
    top = float(np.abs(high).max()) or 1.0
    start = np.linalg.eigh((high / top).astype(np.float32))[1]
    return refined(high.astype(_WIDE) + low.astype(_WIDE), start)


def _projected(batch: pa.RecordBatch, column: int, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(x less the floor of its mean, whitened)"""
    own = _whole(batch, column, model["dim"], model["scale"], model["shift"]) - model["centre"]
    return own, (own - model["rest"]) @ model["axes"]


def _moments(batches, model: dict):
    """n, mean and centred products of the whitened vectors of this task, batches joined as they come."""
    k = model["axes"].shape[1]
    n, mean, products = 0, np.zeros(k), np.zeros((k, k))
    for batch in batches:
        if not batch.num_rows:
            continue
        white = _projected(batch, 0, model)[1]
        middle = white.mean(axis=0)
        own, apart = white - middle, middle - mean
        products += own.T @ own + np.outer(apart, apart) * (n * len(white) / (n + len(white)))
        mean = mean + apart * (len(white) / (n + len(white)))
        n += len(white)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "products"])


def _spread(batches, mean: np.ndarray):
    """Products around the mean of all rows, from those around each task's own."""
    k = len(mean)
    total = np.zeros((k, k))
    for batch in batches:
        for n, own, products in zip(*(batch.column(c).to_pylist() for c in range(3))):
            apart = np.array(own) - mean
            total += np.array(products).reshape(k, k) + n * np.outer(apart, apart)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["at", "total"])


def _identity_error(vectors: DataFrame, model: dict, n: int) -> float:
    k = model["axes"].shape[1]
    if not k:
        return 0.0
    tasks = cut(vectors.select("vector").mapInArrow(lean(lambda b: _moments(b, model)), "n bigint, mean array<double>, products array<double>"))
    sums = tasks.select("n", F.posexplode("mean").alias("at", "mean")).groupBy("at").agg((F.sum(F.col("n") * F.col("mean")) / n).alias("mean")).collect()
    mean = np.zeros(k)
    for row in sums:
        mean[row["at"]] = row["mean"]
    made = tasks.mapInArrow(lambda b: _spread(b, mean), "at bigint, total double").groupBy("at").agg(F.sum("total").alias("total"))
    unit = F.when(F.col("at") % (k + 1) == 0, 1.0).otherwise(0.0)
    return made.agg(F.max(F.abs(F.col("total") / n - unit))).first()[0]


def _rows(batches, model: dict, n: int, components: int):
    rest, k = model["whole_rest"], model["axes"].shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        own, white = _projected(batch, 1, model)
        most = n * (int(np.abs(own).max()) + 1)
        if most * most * model["dim"] < 1 << 63:
            deviation = pa.array(((own * n - rest) ** 2).sum(axis=1))
        else:
            exact = ((own.astype(object) * n - rest.astype(object)) ** 2).sum(axis=1)
            deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
        if k < components:
            white = np.concatenate([white, np.full((len(white), components - k), np.nan)], axis=1)
        row = np.repeat(np.arange(len(own)), components)
        number = np.tile(np.arange(1, components + 1, dtype=np.int32), len(own))
        flat = white.ravel()
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(number), deviation.take(pa.array(row)), pa.array(flat, mask=number > k)], ["vec_id", "component", "deviation", "whitened"])


def whitened(vectors: DataFrame, most: int = MOST, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per kept vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    sound = finite(vectors)
    dim = common_length(sound)
    if not dim:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    fit = sound.where(F.size("vector") == dim)
    n, sums, covariance = exact_covariance(fit, dim, scale, shift)
    values, axes = principal(covariance)
    components = min(most, dim)
    live = int((values[:components] > dim * 2.0**-52 * max(values[0], 0)).sum())
    trace = float(sum(covariance[i][i] for i in range(dim)))
    explained = [max(0.0, float(v)) / trace if trace else 0.0 for v in values[:components]]
    middle = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    model = {
        "dim": dim, "scale": scale, "shift": shift, "centre": np.array(middle, dtype=np.int64), "rest": np.array([r / n for r in rest]),
        "whole_rest": np.array(rest, dtype=np.int64), "axes": (axes[:, :live] / np.sqrt(values[:live])).astype(np.float64),
    }
    error = _identity_error(fit, model, n)
    rows = fit.select("vec_id", "vector").mapInArrow(lean(lambda b: _rows(b, model, n, components)), "vec_id bigint, component int, deviation bigint, whitened double")
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("component"))
    return rows.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
