"""Embedding whitening along the leading eigenvectors of the covariance, found by LOBPCG.

Entries become integers (``SCALE`` times the entry, rounded down, plus ``OFFSET``), so that the mean is exact: n and the sums S.  A centred row is
x - S/n, with the whole part of the mean taken off in integers first.

LOBPCG (Knyazev 2001).  The iterate is a block of ``components`` + ``GUARD`` orthonormal directions.  Each step takes the iterate, its
residuals and the block of previous directions, makes them orthonormal (what depends on the others is dropped), multiplies the covariance
with that basis in one distributed pass over the centred rows, and takes the leading vectors of the small problem on the basis (Rayleigh-Ritz) as the
next iterate.  The covariance itself is never formed.  Residuals are those of fresh products, and the wanted ones must fall to ``CERTIFIED`` times the
largest eigenvalue, else the operator fails; it goes on to ``TARGET`` while that still helps.  Where iterate, residuals and directions span the
whole space, as 32 + 8 directions of 64 dimensions soon do, a step is exact.

Scale.  Every pass is narrow: a task multiplies its rows and sends one matrix of dimensions times basis columns, which a few tasks add up; the driver
holds such matrices and never a row.  Nothing is broadcast that grows with the table.  The whitened covariance, for ``identity_error``, is measured on the
whitened values in a pass of its own.

Cases.  Vectors that are null, empty, or hold null or non-finite entries go, and so do entries of 2**40 / SCALE and more (no embedding has them; the sums would not fit).  Lengths differ: the most
frequent one is whitened (of equally frequent ones the largest), vectors of other lengths go, as they have no covariance with the rest.  Null id, repeated ids and rows:
rows of their own.  A direction without variance (one vector, equal vectors, fewer vectors than components): whitened and explained are 0,
and it takes no part in identity_error.  ``deviation`` is null where it doesn't fit 64 bits.  Empty table: no rows.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import cut, finite_rows, summed

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
GUARD, MAX_STEPS, SEED = 8, 300, 12
#: Largest residual, over the largest eigenvalue, that is accepted, and the one at which steps end.
CERTIFIED, TARGET = 1e-10, 1e-14
#: An eigenvalue of at most this part of the trace counts as none.
NO_VARIANCE = 1e-13
LARGEST = 1 << 40
SLICE = 2_048
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _integers(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, x of the rows that remain, whatever their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for size in set(pc.list_value_length(column).drop_null().to_pylist()) - {0}:
                at, values = finite_rows(column, size)
                x = np.floor(np.clip(values, -LARGEST, LARGEST) * SCALE)
                fits = (np.abs(x) < LARGEST).all(1)
                x = x[fits].astype(np.int64) + OFFSET
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * size, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[fits])), lists], names=["vec_id", "x"])

    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("x")).mapInArrow(run, "vec_id bigint, x array<bigint>")


def _slices(batches: Iterator[pa.RecordBatch], at: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _totals(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and the sums by dimension, exact."""

    def find(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, n = [0] * dims, 0
        for _, x in _slices(batches, 0, dims):
            n += len(x)
            total = [a + b for a, b in zip(total, x.sum(0).tolist())]
        return np.array([[n, 0], *[[s >> 32, s & 0xFFFFFFFF] for s in total]], np.int64)  # in two halves, which can't overflow

    found = summed(rows.select("x"), find)
    return int(found[0, 0]), [(int(hi) << 32) + int(lo) for hi, lo in found[1:]]


class Centred:
    """Rows less the exact mean: ``base`` is its whole part and ``rest`` what is left, times n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)**2."""
        x = x - self.base
        largest = self.n * (int(np.abs(x).max(initial=0)) + 1)
        if largest * largest * x.shape[1] < 2**63:
            return ((self.n * x - self.rest) ** 2).sum(1).tolist()
        rest = self.rest.tolist()
        exact = (sum((self.n * a - r) ** 2 for a, r in zip(row, rest)) for row in x.tolist())
        return [s if s < 2**63 else None for s in exact]


def _product(rows: DataFrame, mean: Centred, basis: np.ndarray) -> np.ndarray:
    """Covariance times basis, and the trace of the covariance as a last column (in its first row)."""
    dims = len(basis)

    def find(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((dims, basis.shape[1] + 1))
        for _, x in _slices(batches, 0, dims):
            c = mean.rows(x)
            total[:, :-1] += c.T @ (c @ basis)
            total[0, -1] += (c * c).sum()
        return total

    return summed(rows.select("x"), find) / mean.n


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block has outside of ``against``; directions of rounding only are dropped."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):  # once more for what rounding has left
        block = block - against @ (against.T @ block)
    if not block.size:
        return np.empty((len(against), 0))
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, size > 1e-10][:, : len(against) - against.shape[1]]
    left = left - against @ (against.T @ left)
    return np.linalg.qr(left)[0]


def lobpcg(product, dims: int, wanted: int, guard: int = GUARD, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """Largest eigenvalues, their vectors, the trace, the largest relative residual and the number of steps; ``product(basis)`` as ``_product``."""
    block = min(dims, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, block)))[0]
    residual, previous = np.empty((dims, 0)), np.empty((dims, 0))
    best, stale = None, 0
    for step in range(1, MAX_STEPS + 1):
        basis = np.hstack([x, _orthonormal(np.hstack([residual, previous]), x)])
        times = product(basis)
        times, trace = times[:, :-1], float(times[0, -1])
        small = basis.T @ times
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:block], vectors[:, ::-1][:, :block]
        x, residual, previous = basis @ vectors, times @ vectors, basis[:, block:] @ vectors[block:]
        x, r = np.linalg.qr(x)
        x = x * np.sign(np.diag(r))  # as it was, but for rounding
        residual = residual - x * values
        largest = float(np.linalg.norm(residual[:, :wanted], axis=0).max() / values[0]) if values[0] > 0 else 0.0
        if best is None or largest < best[3]:
            stale = 0 if best is None or largest < best[3] / 2 else stale + 1
            best = values[:wanted], x[:, :wanted], trace, largest, step
        else:
            stale += 1
        if largest <= TARGET or (best[3] <= CERTIFIED and stale >= 3):
            break
    if best[3] > CERTIFIED:
        raise ArithmeticError(f"residual {best[3]:.2g} after {MAX_STEPS} steps; {CERTIFIED:.2g} is asked for")
    return best


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row for each remaining vector and component."""
    spark = vectors.sparkSession
    table = cut(_integers(vectors, vec_id, embedding), "whiten-rows")
    most = table.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not most:
        return spark.createDataFrame([], OUT)
    dims = most[0]["d"]
    rows = table.where(F.size("x") == dims)
    mean = Centred(*_totals(rows, dims))
    k = min(components, dims)
    values, directions, trace, _, _ = lobpcg(lambda basis: _product(rows, mean, basis), dims, k)
    has = values > NO_VARIANCE * trace
    scaled = np.where(has, directions / np.sqrt(np.where(has, values, 1.0)), 0.0)
    explained = np.where(has, values / (trace or 1.0), 0.0)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k + 1, k))
        for _, x in _slices(batches, 0, dims):
            w = mean.rows(x) @ scaled
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        return total

    found = summed(rows.select("x"), moments) / mean.n
    off = found[:k] - np.outer(found[k], found[k]) - np.diag(has.astype(float))
    error = float(np.abs(off).max())
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _slices(batches, 1, dims):
            n = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), k)))
            deviation = pa.array(mean.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
            constant = lambda v, kind: pa.array(np.full(n * k, v), kind)
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), constant(mean.n, pa.int64()), deviation]
            columns += [pa.array((mean.rows(x) @ scaled).ravel()), pa.array(np.tile(explained, n)), constant(error, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, OUT)
