"""Whitening of vectors by LOBPCG over distributed covariance products.

The covariance is never formed: each step multiplies it with a block of vectors, Y^T (Y B) / n over centred rows, summed
over all tasks. A Rayleigh-Ritz step on the span of the iterate, its residuals and the directions before gives the next
iterate. It ends where the residuals of the wanted pairs, taken from a product of their own, certify them. The driver
holds blocks of dimension x columns only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Columns of the iterate beyond the wanted ones, the norm of a certified residual by the greatest eigenvalue, and eigenvalues by it that count as none.
GUARD, CERTIFIED, NONE = 8, 1e-12, 1e-11
#: Scaled entries beyond it are taken as it, so that they are whole doubles.
MOST = float(1 << 52)
_SMALL = 1 << 62


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of rows whose vector is not null and holds finite numbers only: x = floor(64 c) + 1000000 as longs; |floor(64 c)| beyond 2^52 counts as 2^52."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    whole = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(MOST)), F.lit(-MOST))) + SHIFT
    return vectors.where(F.col(vector_col).isNotNull()).where(ok).select(F.col(id_col).alias("vec_id"), F.transform(v, whole).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their (rows, dims) matrix of x, some megabytes at a time."""
    step = max(1, 1_000_000 // dims)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            b = batch.slice(at, step)
            yield b, b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for _, x in _matrices(batches, dims):
            total += x.sum(0).astype(object) if np.abs(x).max() < _SMALL // len(x) else x.astype(object).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int64()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["pos", "value"])

    rows = fit.mapInArrow(add, "pos long, value decimal(38,0)").groupBy("pos").agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect()
    out = {r["pos"]: int(r["value"]) for r in rows}
    return [out[k] for k in range(dims)]


class Centre:
    """The mean as whole part and fraction by dimension, so that centred values are exact to the last bit of a double."""

    def __init__(self, sums: list[int], n: int):
        self.n = n
        self.whole, self.rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        d = x - self.whole
        if int(np.abs(d).max(initial=0) + 1) * self.n < int((_SMALL // max(1, x.shape[1])) ** 0.5):
            return ((d * self.n - self.rest) ** 2).sum(1).tolist()
        exact = ((d.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def _collected(fit: DataFrame, partial: Callable[[np.ndarray], np.ndarray], size: int, dims: int) -> np.ndarray:
    """The sum over all rows of partial(matrix), an array of `size` numbers whatever the number of rows: summed in each task, then by position."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _matrices(batches, dims):
            total += partial(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), pa.array(total)], ["pos", "value"])

    out = np.zeros(size)
    for r in fit.mapInArrow(add, "pos long, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect():
        out[r["pos"]] = r["value"]
    return out


def covariance_product(fit: DataFrame, centre: Centre, b: np.ndarray) -> tuple[np.ndarray, float]:
    """V b and the trace of V: one pass over the fit list."""
    dims, k = b.shape

    def partial(x: np.ndarray) -> np.ndarray:
        y = centre.centred(x)
        return np.append((y.T @ (y @ b)).ravel(), np.square(y).sum())

    out = _collected(fit, partial, dims * k + 1, dims) / centre.n
    return out[:-1].reshape(dims, k), float(out[-1])


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the block's part outside the span of `against` (orthonormal columns)."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    for _ in range(2):
        if not block.shape[1]:
            break
        block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10]
    return block[:, : len(block) - against.shape[1]]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 0, most: int = 1000) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, falling, unit eigenvectors and the greatest residual of a symmetric matrix's `wanted` greatest pairs.

    Residuals are norms of V x - e x, by the greatest eigenvalue. Iteration ends when they are CERTIFIED and stop
    falling; where `most` steps do not reach that, ArithmeticError is raised. Columns that have converged stay in the span.
    """
    k = min(dims, wanted + GUARD)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, k)))[0]
    q, p, last = x, np.zeros((dims, 0)), np.inf
    for _ in range(most):
        aq = product(q)
        t = q.T @ aq
        e, c = np.linalg.eigh((t + t.T) / 2)
        e, c = e[::-1][:k], c[:, ::-1][:, :k]
        if q.shape[1] > k:
            p = q[:, k:] @ c[k:]
        x, ax = q @ c, aq @ c
        r = ax - x * e
        norms = np.linalg.norm(r, axis=0)
        top = max(e[0], 0.0)
        worst = norms[:wanted].max(initial=0.0)
        if top <= 0 or (worst <= CERTIFIED * top and worst > last / 2):
            return e[:wanted], x[:, :wanted], worst / top if top > 0 else 0.0
        last = worst
        x = np.linalg.qr(x)[0]  # against rounding
        q = np.concatenate([x, _orthonormal(np.concatenate([r, p], axis=1), x)], axis=1)
    raise ArithmeticError(f"residuals of {worst / top:.1e} after {most} steps")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component.

    Rows whose vector is null or holds a null or non-finite entry go; null and repeated ids stay. The fit counts each
    different x vector once. Shorter vectors are filled with entries of 0. There are as many components as dimensions
    and directions with variance, `components` at most: none for an empty table or one different vector. Components of equal eigenvalues are
    any orthonormal ones. deviation is null beyond 64 bits.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vector_col)
    most, least = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.min(F.size("x")), F.lit(0))).first()
    if least != most:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), most - F.size("x"))))
    none = spark.createDataFrame([], schema)
    if not most:
        return none
    fit = written(rows.select("x").distinct(), "fit-list")
    n = fit.count()
    centre = Centre(_sums(fit, most), n)
    trace = 0.0

    def product(b: np.ndarray) -> np.ndarray:
        nonlocal trace
        out, trace = covariance_product(fit, centre, b)
        return out

    e, x, _ = lobpcg(product, most, min(components, most))
    real = e > NONE * max(e[0], 0.0)
    e, x = e[real], x[:, real]
    k = len(e)
    if not k:
        return none
    x = x * np.sign(x[np.abs(x).argmax(0), np.arange(k)])
    basis = x / np.sqrt(e)

    def outer(m: np.ndarray) -> np.ndarray:
        w = centre.centred(m) @ basis
        return (w.T @ w).ravel()

    error = float(np.abs(_collected(fit, outer, k * k, most).reshape(k, k) / n - np.eye(k)).max())
    explained = e / trace

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, m in _matrices(batches, most):
            w = centre.centred(m) @ basis
            row, size = np.repeat(np.arange(len(m)), k), len(m) * k
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(size, n)), pa.array(centre.deviations(m), pa.int64()).take(pa.array(row)),
                    pa.array(w.ravel()), pa.array(np.tile(explained, len(m))), pa.array(np.full(size, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(emit, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of embeddings whitened by the first 16 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
