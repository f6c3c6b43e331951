"""Kernel classifiers of any number of labelled rows: a cascade of exact machines, or random Fourier features.

Cascade (Graf et al. 2005).  Rows are dealt to chunks of about ``CHUNK`` by a digest; each chunk is an Arrow group that trains by itself and keeps its support vectors,
which are dealt and trained again until ``MERGE`` or fewer are left; the driver trains on these.  Then all rows are checked in a narrow pass, and those that violate the
solution most join the support vectors for the next training, until none does by more than ``SLACK``: what is left out then has weight 0 in the exact solution too.

Where classes overlap, support vectors are a share of all rows and no longer fit one machine (above ``MERGE``, or without an end after ``ROUNDS``), and a pass takes rows times support vectors.
Then the kernel is approximated by ``FEATURES`` random Fourier features (Rahimi and Recht 2007) and a linear machine of squared hinge loss is trained on all rows by Newton steps, whose gradient and
curvature tasks add up; the driver holds features squared.  Its only optimum doesn't depend on where the steps begin; they begin at the optimum of ``SAMPLE`` rows of least digest, so few passes over all rows are left.

Which of the two it is, tables above ``TRIED`` chunks tell beforehand: the support vectors of a quarter and of all of a chunk are carried on to all rows as a power.

Tables of at most ``CHUNK`` rows are trained by the driver alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import models
from strandloom.session import cut
from strandloom.sums import summed

CHUNK, MERGE, ROUNDS = 4_000, 6_000, 20
#: Violating rows that join a training, at most, and the violation that is left.
JOIN, SLACK = 1_500, 5e-3
FEATURES, NEWTON_STEPS, STEPS = 1_024, 30, (1.0, 0.5, 0.25, 0.0625)
SLICE = 2_048
#: Chunks above which support vectors are foretold, kernel values of a pass over all rows at most, and rows that Newton steps begin with.
TRIED, EVALUATIONS, SAMPLE = 16, 2e9, 16_000


@dataclass
class Fourier:
    """A linear classifier of random Fourier features; the last weight is the offset."""

    gamma: float
    weights: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([models.random_features(x, self.gamma, len(self.weights) - 1), np.ones((len(x), 1), x.dtype)])

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.decision(x), -500, 500)))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; no Python object is made."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def value_range(rows: DataFrame, dims: int) -> models.MinMax:
    """``models.MinMax`` of all vectors ``z``."""
    def find(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.full((2, dims), -np.inf)
        for batch in slices(batches):
            x = matrix(batch.column(0))
            out = np.maximum(out, [-x.min(0), x.max(0)])
        return out

    low, high = summed(rows.select("z"), find, np.maximum)
    return models.MinMax(-low, high)


def _moments(rows: DataFrame, dims: int, scale=None) -> np.ndarray:
    """Number, sums and sums of squares of (scaled) vectors."""

    def find(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((3, dims))
        for batch in slices(batches):
            x = matrix(batch.column(0))
            x = scale.apply(x) if scale else x
            out += [np.full(dims, len(x)), x.sum(0), (x * x).sum(0)]
        return out

    return summed(rows.select("z"), find)


def standard(rows: DataFrame, dims: int) -> models.Standard:
    """``models.Standard`` of all vectors ``z``."""
    n, total, squares = _moments(rows, dims)
    mean = total / n
    deviation = np.sqrt(np.maximum(squares / n - mean**2, 0))
    return models.Standard(mean, np.where(deviation < 1e-12, 1.0, deviation))


def auto_gamma(rows: DataFrame, dims: int, scale) -> float:
    """``models.auto_gamma`` of all scaled rows."""
    n, total, squares = _moments(rows, dims, scale)
    size = n.sum()
    return 0.5 / (dims * max(float(squares.sum() / size - (total.sum() / size) ** 2), 1e-9))


def _costs(y: np.ndarray, cost: tuple[float, float]) -> np.ndarray:
    return np.where(y > 0, cost[0], cost[1])


def _reduced(rows: DataFrame, n: int, scale, gamma: float, cost: tuple[float, float]) -> DataFrame:
    """The support vectors of chunks; a chunk of one class has none."""
    chunks = -(-n // CHUNK)

    def train(group: pa.Table) -> pa.Table:
        order = np.argsort(group["row"].to_numpy(), kind="stable")
        group = group.take(pa.array(order)).select(["row", "label", "z"])
        y = group["label"].to_numpy().astype(float)
        if len(set(y)) < 2:
            return group.slice(0, 0)
        x = scale.apply(matrix(group["z"].combine_chunks()))
        return group.take(pa.array(models.train_svm(x, y, _costs(y, cost), gamma).used))

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(n)), F.lit(chunks)))
    return cut(dealt.groupBy("chunk").applyInArrow(train, "row bigint, label int, z array<double>"), "support")


def _violators(rows: DataFrame, scale, model: models.SVM, known: np.ndarray) -> list:
    """The rows that violate the solution most, ``JOIN`` at most."""
    known = np.sort(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            y = batch.column(1).to_numpy()
            short = 1 - y * model.decision(scale.apply(matrix(batch.column(2))))
            bad = np.flatnonzero((short > SLACK) & ~np.isin(batch.column(0).to_numpy(), known))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(bad)) for c in batch.columns], pa.array(short[bad])], names=["row", "label", "z", "short"])

    found = rows.select("row", "label", "z").mapInArrow(run, "row bigint, label int, z array<double>, short double")
    return found.orderBy(F.desc("short"), "row").limit(JOIN).collect()


def _cascade(rows: DataFrame, n: int, scale, gamma: float, cost: tuple[float, float]) -> models.SVM | None:
    """The exact classifier of all rows; None if its support vectors are too many for one machine."""
    left, size = rows, n
    while size > MERGE:
        left, before = _reduced(left, size, scale, gamma, cost), size
        size = left.count()
        if size > MERGE and size > 0.8 * before:
            return None
    held = {r.row: (r.label, r.z) for r in left.collect()}
    for _ in range(ROUNDS):
        ids = np.array(sorted(held), np.int64)
        y = np.array([held[i][0] for i in ids], float)
        if len(set(y)) < 2:
            return None
        model = models.train_svm(scale.apply(np.array([held[i][1] for i in ids])), y, _costs(y, cost), gamma)
        ids = ids[model.used]
        bad = _violators(rows, scale, model, ids)
        if not bad:
            return model
        held = {i: held[i] for i in ids.tolist()} | {r.row: (r.label, r.z) for r in bad}
        if len(held) > MERGE:
            return None
    return None


def _least(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and vectors of the ``n`` rows of least digest, whatever the partitions."""
    found = rows.orderBy(F.xxhash64("label", "z"), "row").limit(n).select("label", "z").toArrow().combine_chunks()
    return found["label"].to_numpy().astype(float), matrix(found["z"].combine_chunks())


def _foretold(y: np.ndarray, x: np.ndarray, n: int, gamma: float, cost: tuple[float, float]) -> float:
    """Support vectors of ``n`` rows, from those of a chunk and of a quarter of it; 0 where that can't be told."""
    if len(set(y[: len(y) // 4])) < 2:
        return 0.0
    few, many = (len(models.train_svm(x[:m], y[:m], _costs(y[:m], cost), gamma).weights) for m in (len(y) // 4, len(y)))
    return many * (n / len(y)) ** min(1.0, max(0.0, math.log(many / few, 4)))


def _newton(passed, start: np.ndarray) -> np.ndarray:
    """The weights of least half their squares plus summed costs.

    passed: of columns of weights, the summed costs; with ``curved``, those at the only column in the last row, gradient in the first and curvature between them.
    A step is tried whole in the pass that the next one needs; shorter ones are measured together.
    """
    ridge = np.append(np.ones(len(start) - 1), 1e-6)
    own = lambda w: 0.5 * (ridge[:, None] * w * w).sum(0)
    w = start[:, None]
    found = passed(w, True)
    for _ in range(NEWTON_STEPS):
        gradient, now = found[0] + ridge * w[:, 0], found[-1, 0] + own(w)[0]
        step = np.linalg.solve(found[1:-1] + np.diag(ridge), gradient)
        if gradient @ step < 1e-6 * max(now, 1e-9):
            break
        tried = w - step[:, None]
        ahead = passed(tried, True)
        if ahead[-1, 0] + own(tried)[0] >= now:
            tried = w - step[:, None] * np.array(STEPS[1:])
            costs = passed(tried, False)[0] + own(tried)
            if costs.min() >= now:
                break
            tried = tried[:, [int(costs.argmin())]]
            ahead = passed(tried, True)
        w, found = tried, ahead
    return w[:, 0]


def _fourier(rows: DataFrame, n: int, scale, gamma: float, cost: tuple[float, float], n_features: int | None = None) -> Fourier:
    """Newton steps on half the squared weights plus the costs of squared shortfalls.  Features are of single precision here, sums of double."""
    n_features = n_features or FEATURES
    size = n_features + 1

    def added(batches: Iterator[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, curved: bool) -> np.ndarray:
        out = np.zeros((size + 2, size) if curved else (1, weights.shape[1]))
        model = Fourier(gamma, weights[:, 0])
        for y, x in batches:
            f = model.features(x.astype(np.float32))
            c = _costs(y, cost)
            short = np.maximum(0, 1 - y[:, None] * (f @ weights))
            if not curved:
                out[0] += (c[:, None] * short**2).sum(0)
                continue
            on = short[:, 0] > 0
            f, root = f[on], np.sqrt(2 * c[on])
            out[0] -= (2 * c[on] * y[on] * short[on, 0]) @ f
            g = f * root[:, None].astype(np.float32)
            out[1:-1] += g.T @ g
            out[-1, 0] += (c * short[:, 0] ** 2).sum()
        return out

    def passed(weights: np.ndarray, curved: bool) -> np.ndarray:
        def find(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            return added(((b.column(0).to_numpy().astype(float), scale.apply(matrix(b.column(1)))) for b in slices(batches)), weights, curved)

        return summed(rows.select("label", "z"), find)

    start = np.zeros(size)
    if n > 2 * SAMPLE:
        y, z = _least(rows, SAMPLE)
        x = scale.apply(z)
        parts = [(y[i : i + SLICE], x[i : i + SLICE]) for i in range(0, len(y), SLICE)]
        start = _newton(lambda weights, curved: added(iter(parts), weights, curved) * (n / len(y)), start)
    return Fourier(gamma, _newton(passed, start))


def fit(labelled: DataFrame, *, scale: str = "range", cost: float = 100.0, balanced: bool = False, gamma: float | str = "auto", approximate: bool = False):
    """Scaler and classifier of ``labelled``: label (1 or -1) and z (vectors of one length); None if a class is missing.

    scale: "range" or "standard".  balanced: costs by class, inverse to their numbers.  gamma: "auto" as in ``models``, or "scale", twice that.
    """
    rows = cut(labelled.select("label", "z").where("label is not null and z is not null").withColumn("row", F.monotonically_increasing_id()), "labelled")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(-1, 0)
    if not n_pos or not n_neg:
        return None
    n, dims = n_pos + n_neg, rows.select(F.size("z")).first()[0]
    costs = (cost * n / (2 * n_pos), cost * n / (2 * n_neg)) if balanced else (cost, cost)
    scaler = value_range(rows, dims) if scale == "range" else standard(rows, dims)
    value = auto_gamma(rows, dims, scaler) if isinstance(gamma, str) else gamma
    value = 2 * value if gamma == "scale" else value
    if not approximate:
        if n <= CHUNK:
            sample = rows.orderBy(F.xxhash64("label", "z"), "row").toPandas()  # whatever the partitions
            y = sample["label"].to_numpy().astype(float)
            return scaler, models.train_svm(scaler.apply(np.stack(sample["z"].to_numpy())), y, _costs(y, costs), value)
        expected = 0.0
        if n > TRIED * CHUNK:
            y, z = _least(rows, CHUNK)
            expected = _foretold(y, scaler.apply(z), n, value, costs)
        if expected <= MERGE and expected * n <= EVALUATIONS and (model := _cascade(rows, n, scaler, value, costs)):
            return scaler, model
    return scaler, _fourier(rows, n, scaler, value, costs)
