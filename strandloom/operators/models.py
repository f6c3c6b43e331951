"""Models in numpy, applied to DataFrames by Arrow UDFs: scaling, kernels, a soft-margin SVM, and a small perceptron.

Training data are bounded by the caller; the models are arrays of fixed size and are broadcast with the UDF.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose kernel values are made at a time.
DECIDED = 128
KERNELS = ("linear", "poly", "rbf", "sigmoid", "precomputed")


def kernel(a: np.ndarray, b: np.ndarray, kind: str = "rbf", gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> np.ndarray:
    """Kernel matrix of rows of a and b; precomputed: a already is that matrix."""
    if kind == "precomputed":
        return a
    dots = a @ b.T
    if kind == "linear":
        return dots
    if kind == "poly":
        return (gamma * dots + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * dots + coef0)
    if kind != "rbf":
        raise ValueError(f"unknown kernel {kind}; known: {KERNELS}")
    return np.exp(-gamma * np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * dots))


@dataclass
class MinMax:
    """Scaling to [0, 1]; a feature without range becomes 0."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray) -> MinMax:
        return cls(x.min(axis=0), x.max(axis=0))

    def apply(self, x: np.ndarray) -> np.ndarray:
        span = self.high - self.low
        flat = span < 1e-12
        return np.where(flat, 0.0, (x - self.low) / np.where(flat, 1.0, span))


@dataclass
class Standard:
    """Scaling to mean 0 and population deviation 1."""

    mean: np.ndarray
    deviation: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray) -> Standard:
        d = x.std(axis=0)
        return cls(x.mean(axis=0), np.where(d < 1e-12, 1.0, d))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.deviation


def auto_gamma(x: np.ndarray) -> float:
    """Half of one over features times the variance of all scaled values."""
    return 0.5 / (x.shape[1] * max(float(x.var()), 1e-9))


@dataclass
class SVM:
    """A soft-margin classifier: support vectors, their weights (alpha times label), the offset, and which of the training rows they are."""

    vectors: np.ndarray
    weights: np.ndarray
    offset: float
    gamma: float
    kind: str = "rbf"
    used: np.ndarray | None = None

    def decision(self, x: np.ndarray) -> np.ndarray:
        if self.kind != "rbf":
            return kernel(x, self.vectors, self.kind, self.gamma) @ self.weights - self.offset
        out, size = np.empty(len(x)), (self.vectors * self.vectors).sum(1)
        for i in range(0, len(x), DECIDED):  # in place and in slices that stay in the cache
            part = x[i : i + DECIDED]
            near = part @ self.vectors.T
            near *= 2
            near -= size
            near -= (part * part).sum(1)[:, None]
            np.minimum(near, 0, out=near)
            near *= self.gamma
            out[i : i + DECIDED] = np.exp(near, out=near) @ self.weights
        return out - self.offset

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.decision(x), -500, 500)))


def _gram(x: np.ndarray, kind: str, gamma: float) -> np.ndarray:
    """The kernel matrix of rows with themselves, made in slices."""
    out = np.empty((len(x), len(x)))
    for i in range(0, len(x), 512):
        out[i : i + 512] = kernel(x[i : i + 512], x, kind, gamma)
    return out


def train_svm(x: np.ndarray, y: np.ndarray, c: float | np.ndarray = 100.0, gamma: float | None = None, kind: str = "rbf", tolerance: float = 1e-3, max_steps: int | None = None) -> SVM:
    """Sequential minimal optimisation with second-order choice of the working pair (Fan, Chen and Lin 2005); y is +1 or -1, c may be by row."""
    gamma = auto_gamma(x) if gamma is None else gamma
    y = y.astype(float)
    n = len(y)
    bound = np.broadcast_to(np.asarray(c, float), (n,))
    gram = x if kind == "precomputed" else _gram(x, kind, gamma)
    diagonal = np.diag(gram).copy()
    alpha = np.zeros(n)
    value = y.copy()  # -y times the gradient of the dual
    can_up = np.where(y > 0, alpha < bound, alpha > 0)
    can_down = np.where(y > 0, alpha > 0, alpha < bound)
    no_up, no_down = np.where(can_up, 0.0, -np.inf), np.where(can_down, 0.0, np.inf)
    gap, curve = np.empty(n), np.empty(n)
    for _ in range(max_steps or max(100_000, 100 * n)):
        i = int(np.add(value, no_up, out=gap).argmax())
        top = gap[i]
        if top - np.add(value, no_down, out=gap).min() < tolerance:
            break
        np.subtract(top, value, out=gap)
        np.multiply(gram[i], -2, out=curve)
        curve += diagonal[i] + diagonal
        np.maximum(curve, 1e-12, out=curve)
        j = int(np.where(can_down & (gap > 0), gap * gap / curve, -np.inf).argmax())
        step = gap[j] / curve[j]
        # both weights move along y by the same amount, within their boxes
        room_i = bound[i] - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else bound[j] - alpha[j]
        step = min(step, room_i, room_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        value -= step * (gram[i] - gram[j])
        for k in (i, j):
            below, above = alpha[k] < bound[k], alpha[k] > 0
            can_up[k], can_down[k] = (below, above) if y[k] > 0 else (above, below)
            no_up[k], no_down[k] = 0.0 if can_up[k] else -np.inf, 0.0 if can_down[k] else np.inf
    slope = -y * value
    free = (alpha > 1e-12) & (alpha < bound - 1e-12)
    if free.any():
        offset = float((y * slope)[free].mean())
    else:
        value = -y * slope
        top = value[np.where(y > 0, alpha < bound, alpha > 0)].max(initial=-np.inf)
        low = value[np.where(y > 0, alpha > 0, alpha < bound)].min(initial=np.inf)
        offset = -(top + low) / 2 if math.isfinite(top) and math.isfinite(low) else 0.0
    used = alpha > 1e-12
    return SVM(x[used], (alpha * y)[used], offset, gamma, kind, np.flatnonzero(used))


@dataclass
class Perceptron:
    """One hidden layer of rectified units and one sigmoid output; scores are sigmoid(logit / temperature)."""

    scale: Standard
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 2.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, self.scale.apply(x) @ self.w1.T + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train_perceptron(x: np.ndarray, y: np.ndarray, hidden: int = 100, epochs: int = 20, batch: int = 32, rate: float = 1e-3, seed: int = 42, validation: float = 0.1) -> Perceptron:
    """Adam on the logistic loss; the epoch of the best validation F1 is kept, and the rate halves when the loss has stalled for five."""
    rng = np.random.default_rng(seed)
    scale = Standard.fit(x)
    z, y = scale.apply(x), y.astype(float)
    order = rng.permutation(len(y))
    held = order[: max(1, int(len(y) * validation))]
    used = order[len(held) :] if len(order) > len(held) else order
    d = z.shape[1]
    p = [rng.normal(0, math.sqrt(2 / d), (hidden, d)), np.zeros(hidden), rng.normal(0, math.sqrt(2 / hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    best, best_f1, least, stalled, t = [a.copy() for a in p], -1.0, math.inf, 0, 0
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), batch):
            rows = used[at : at + batch]
            h = z[rows] @ p[0].T + p[1]
            r = np.maximum(h, 0)
            error = 1 / (1 + np.exp(-np.clip(r @ p[2] + p[3][0], -500, 500))) - y[rows]
            back = (error[:, None] * p[2]) * (h > 0) / len(rows)
            grads = [back.T @ z[rows], back.sum(0), r.T @ error / len(rows), np.array([error.mean()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        logit = np.maximum(z[held] @ p[0].T + p[1], 0) @ p[2] + p[3][0]
        f1 = scores_of(y[held] > 0.5, logit > 0)["f1"]
        loss = float(np.mean(np.logaddexp(0, logit) - y[held] * logit))
        if f1 > best_f1:
            best, best_f1 = [a.copy() for a in p], f1
        stalled = 0 if loss < least else stalled + 1
        least = min(least, loss)
        if stalled > 5:
            rate, stalled = rate / 2, 0
    return Perceptron(scale, best[0], best[1], best[2], float(best[3][0]))


def scores_of(truth: np.ndarray, said: np.ndarray) -> dict[str, float]:
    """Accuracy, precision, recall and F1; 0 where a denominator is."""
    tp, fp, fn = int((truth & said).sum()), int((~truth & said).sum()), int((truth & ~said).sum())
    part = lambda a, b: a / b if b else 0.0
    precision, recall = part(tp, tp + fp), part(tp, tp + fn)
    return {"tp": tp, "fp": fp, "fn": fn, "accuracy": part(int((truth == said).sum()), len(truth)), "precision": precision, "recall": recall, "f1": part(2 * precision * recall, precision + recall)}


def applied(function, vector: Column) -> Column:
    """A column of ``function``, from a matrix to a vector of numbers, on a column of arrays."""

    @F.pandas_udf(T.DoubleType())
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(function(np.stack(rows.to_numpy())) if len(rows) else [], dtype="float64")

    return run(vector)


def class_weight(n_pos: int, n_neg: int, meta: bool = False) -> float:
    """Weight of the heuristic score against the classifier's: lower where negatives are many."""
    if meta:
        return 1.5
    if n_pos and n_neg / n_pos >= 10:
        return 1.25 - 0.108 * math.log(n_neg / n_pos)
    return 1.0


def trainable(n_pos: int, n_neg: int) -> bool:
    return n_pos >= 5 and n_neg >= 5 and n_neg // n_pos <= 75


def random_features(x: np.ndarray, gamma: float, n: int = 512, seed: int = 7) -> np.ndarray:
    """Random Fourier features of the RBF kernel (Rahimi and Recht 2007), for linear training beyond a bounded sample."""
    w, offset = _directions(x.shape[1], gamma, n, seed, x.dtype.char)
    out = x @ w
    out += offset
    np.cos(out, out=out)
    out *= out.dtype.type(math.sqrt(2 / n))
    return out


@lru_cache(maxsize=4)
def _directions(dims: int, gamma: float, n: int, seed: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = rng.normal(0, math.sqrt(2 * gamma), (dims, n))
    return w.astype(kind), rng.uniform(0, 2 * math.pi, n).astype(kind)
