"""K-means whose result depends on the rows alone, not on their order or partitions.

Vectors are scaled to [0, 1] by feature and become integers of 2**``BITS``, so that sums are exact in any order.  Seeding is k-means++ (Arthur and Vassilvitskii 2007) as a race: a row's
digest is a number u in (0, 1], and the next centre is the row with the least -ln(u) / squared distance to its nearest centre, which picks rows with odds in
proportion to that distance.  A round is one narrow pass, in which tasks assign their rows and add them up; the driver gets sums of fixed size.  An empty cluster keeps its centre; ties go to the smaller number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators import models, svm
from strandloom.sums import summed

BITS, ROUNDS = 16, 20


def digest(*keys: str) -> Column:
    """A number in (0, 1] from a row's keys."""
    return (F.conv(F.substring(F.md5(F.concat_ws("_", *keys)), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52))


def whole(x: np.ndarray, scale: models.MinMax) -> np.ndarray:
    return np.floor(scale.apply(x) * 2**BITS + 0.5).astype(np.int64)


def far(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, exact: of 4 million features and fewer, all sums are below 2**53."""
    a, b = v.astype(np.float64), centres.astype(np.float64)
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def _next(rows: DataFrame, scale: models.MinMax, centres: np.ndarray) -> np.ndarray | None:
    """The row that wins the race; without centres, the one of least digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in svm.slices(batches):
            v, u = whole(svm.matrix(batch.column(0)), scale), batch.column(1).to_numpy()
            if not len(v):
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                key = -np.log(u) / far(v, centres).min(1) if len(centres) else u
            key = np.where(np.isnan(key), np.inf, key)
            i = min(np.flatnonzero(key == key.min()).tolist(), key=lambda i: (u[i], v[i].tolist()))
            found = float(key[i]), float(u[i]), v[i].tolist()
            if np.isfinite(found[0]) and (best is None or found < best):
                best = found
        if best:
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "u", "v"), best))], pa.schema([("key", pa.float64()), ("u", pa.float64()), ("v", pa.list_(pa.int64()))]))

    won = rows.select("z", "u").mapInArrow(run, "key double, u double, v array<bigint>").orderBy("key", "u", "v").limit(1).collect()
    return np.array(won[0].v) if won else None


def fit(rows: DataFrame, k: int, keys: tuple[str, ...], rounds: int = ROUNDS) -> tuple[models.MinMax, np.ndarray] | None:
    """Scaler and centres of ``rows`` (z and the columns ``keys``, which tell rows apart); fewer than ``k`` if there are fewer different rows, None without rows."""
    some = rows.select(F.size("z").alias("n")).first()
    if some is None:
        return None
    dims = some.n
    scale = svm.value_range(rows, dims)
    raced = rows.select("z", digest(*keys).alias("u"))
    centres = np.empty((0, dims), np.int64)
    for _ in range(k):
        if (won := _next(raced, scale, centres)) is None:
            break
        centres = np.vstack([centres, won])
    for _ in range(rounds):

        def find(batches: Iterator[pa.RecordBatch], now: np.ndarray = centres) -> np.ndarray:
            out = np.zeros((len(now), dims + 1), np.int64)
            for batch in svm.slices(batches):
                if batch.num_rows:
                    v = whole(svm.matrix(batch.column(0)), scale)
                    mine = far(v, now).argmin(1)
                    for j in np.unique(mine).tolist():
                        out[j] += np.append(v[mine == j].sum(0), (mine == j).sum())
            return out

        sums = summed(rows.select("z"), find)
        new = np.where(sums[:, -1:] > 0, sums[:, :-1] // np.maximum(sums[:, -1:], 1), centres)
        if (new == centres).all():
            break
        centres = new
    return scale, centres


def assigned(z: Column, scale: models.MinMax, centres: np.ndarray) -> Column:
    """The number of the nearest centre."""

    @F.pandas_udf(T.IntegerType())
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(far(whole(np.stack(rows.to_numpy()), scale), centres).argmin(1) if len(rows) else [], dtype="int32")

    return run(z)
