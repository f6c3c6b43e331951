"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

Statistics.  Of the whole text: shares of kinds of characters, lengths of words and lines, and how much of it repeats (words, adjacent words,
lines).  They are standardised by the training rows' means and deviations and stopped at ``STOP`` deviations.

Kernel.  ``FEATURES`` cosines of random projections (Rahimi and Recht 2007) approximate a Gaussian kernel of width ``WIDTH`` times the root of the
number of statistics, which is how far apart standardised rows lie.  A ridge regression of the label on the features is fitted by its normal
equations, whose matrix every task adds up over its own rows.

Calibration.  Labelled rows of one digest remainder, ``CALIBRATION``, are kept out of the regression.  Their outputs, in ``BINS`` equal bins, and labels
are made monotone by pooling adjacent violators; between the centres of pools the score is linear, so that the order within a pool stays.

Scale.  Texts are read once, by a narrow pass that writes a row of statistics for each; training reads that table, joined with the labels by id, and never a text.  The driver
gets sums of fixed size: features squared, and two counts a bin.  All labelled training rows are used, no sample.

Cases.  Null text: like an empty one; both have a score, that of statistics all 0.  Null doc_id: scored, neither held out nor learned from.  Null quality, or a label of an
unknown document: not learned from; a quality above 0 counts as 1.  Several rows or labels of one id: each pair of them counts.  Labels missing or all of one kind: every score is the share of
label 1, 0.5 without labels.  No labels in the calibration's part: the regression's output, between 0 and 1, is the score.  Very long texts: whole, in pieces of ``PIECE`` characters for what is counted
by character.  Empty table: no rows.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import cut, map_texts, summed

FEATURES, WIDTH, RIDGE, SEED = 256, 1.0, 1e-4, 13
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
BINS, LOW, HIGH = 2_000, -0.5, 1.5
STOP = 5.0
THRESHOLD = 0.3
PIECE = 1 << 20
SLICE = 4_096
#: Kinds of characters: others, letters in lower and in upper case, digits, blanks, line breaks, stops, other marks of plain text, signs.
_OTHER, _LOWER, _UPPER, _DIGIT, _BLANK, _BREAK, _STOP, _MARK, _SIGN = range(9)
_LINE = re.compile(r"[^\n]+")
NAMES = (
    "lower upper digit stop mark sign other word_length words_per_line line_length distinct_words top_word same_as_last distinct_pairs "
    "same_lines wordless stop_words capital_words shout_words sign_words"
).split()


def _kinds() -> np.ndarray:
    out = np.full(129, _SIGN, np.uint8)  # 128 stands for all that is not ASCII
    for kind, characters in ((_BLANK, " \t\r\f\v"), (_BREAK, "\n"), (_STOP, ".?!"), (_MARK, ",;:'\"()-"), (_DIGIT, "0123456789")):
        out[[ord(c) for c in characters]] = kind
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[128] = _LOWER, _UPPER, _OTHER
    return out


_KINDS = _kinds()


def _counted(text: str) -> np.ndarray:
    out = np.zeros(9)
    for i in range(0, len(text), PIECE):
        codes = np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        out += np.bincount(_KINDS[np.minimum(codes, 128)], minlength=9)
    return out


def statistics(text: str | None) -> list[float]:
    """The statistics ``NAMES`` of a text; all 0 if it has no words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(NAMES)
    n, kinds = len(words), _counted(text)
    shown = max(1.0, kinds.sum() - kinds[_BLANK] - kinds[_BREAK])
    times = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = Counter(x[0].strip() for x in _LINE.finditer(text))
    n_lines = lines.total()
    shares = [kinds[k] / shown for k in (_LOWER, _UPPER, _DIGIT, _STOP, _MARK, _SIGN, _OTHER)]
    of_words = lambda good: sum(c for w, c in times.items() if good(w)) / n
    return [float(x) for x in (
        *shares, math.log1p(shown / n), math.log1p(n / n_lines), math.log1p(len(text) / n_lines), math.log(n / len(times)) / math.log(n + 1), max(times.values()) / (n + 4),
        sum(map(str.__eq__, words, words[1:])) / n, pairs / n if n > 1 else 1.0, 1 - len(lines) / n_lines, of_words(lambda w: not any(map(str.isalpha, w))),
        of_words(lambda w: w[-1] in ".?!"), of_words(lambda w: w[0].isupper() and not w.isupper()), of_words(lambda w: len(w) > 1 and w.isupper()), of_words(lambda w: not (w[-1].isalnum() or w[-1] in ".?!,;:'\")-")),
    )]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(_fold(doc_id) == HELD_OUT, F.lit(False))


def _fold(doc_id: str) -> Column:
    return F.crc32(F.col(f"`{doc_id}`").cast("string")) % FOLDS


@dataclass
class Model:
    """What scoring needs, of fixed size; without ``weights``, every score is ``prior``."""

    prior: float
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None
    directions: np.ndarray | None = None
    phases: np.ndarray | None = None
    weights: np.ndarray | None = None
    centres: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, rows: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a last one that is always 1."""
        z = np.clip((rows - self.mean) / self.deviation, -STOP, STOP)
        waves = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.prior)
        raw = self.raw(rows)
        return np.clip(raw if self.centres is None else np.interp(raw, self.centres, self.levels), 0.0, 1.0)


def pooled(centres: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of bins by pooling adjacent violators: the pools' mean places and levels, both rising."""
    pools: list[list[float]] = []  # sum of places, ones, count
    for c, y, n in zip(centres.tolist(), ones.tolist(), counts.tolist()):
        if n:
            pools.append([c * n, y, n])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def statistics_of(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, stats of every document, written once."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return cut(map_texts(slim, "text", ("doc_id",), lambda texts: [[statistics(t) for t in texts]], "stats array<double>"), "quality-statistics")


def _batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def fit(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """The model of labelled documents that are not held out; ``stats`` as ``statistics_of`` makes them."""
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.col(f"`{label}`") > 0).cast("int").alias("y"))
    known = known.where(F.col("y").isNotNull() & (_fold("doc_id") != HELD_OUT))
    rows = cut(stats.join(known, "doc_id").select((_fold("doc_id") == CALIBRATION).cast("int").alias("last"), "y", "stats"), "quality-training")

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((len(NAMES) + 1, 2))
        for batch, x in _batches(batches, 2):
            total[:-1] += np.stack([x.sum(0), (x * x).sum(0)], 1)
            total[-1] += len(x), batch.column(1).to_numpy().sum()
        return total

    found = summed(rows, moments)
    n, ones = found[-1]
    if not n or ones in (0, n):
        return Model(float(ones / n) if n else 0.5)
    mean = found[:-1, 0] / n
    deviation = np.sqrt(np.maximum(found[:-1, 1] / n - mean**2, 0))
    rng = np.random.default_rng(seed)
    model = Model(float(ones / n), mean, np.where(deviation > 1e-9, deviation, 1.0))
    model.directions = rng.standard_normal((len(NAMES), features)) / (width * math.sqrt(len(NAMES)))
    model.phases = rng.uniform(0, 2 * math.pi, features)

    def equations(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((features + 2, features + 1))
        for batch, x in _batches(batches, 1):
            f = model.features(x)
            total[:-1] += f.T @ f
            total[-1] += f.T @ batch.column(0).to_numpy()
        return total

    found = summed(rows.where("last = 0").select("y", "stats"), equations)
    penalty = ridge * max(1.0, found[-2, -1]) * np.eye(features + 1)  # times the rows; the constant is not penalised
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(found[:-1] + penalty, found[-1])

    def bins(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, BINS), np.int64)
        for batch, x in _batches(batches, 1):
            at = np.clip((model.raw(x) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
            y = batch.column(0).to_numpy()
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at[y > 0], minlength=BINS)
        return total

    counts, ones = summed(rows.where("last = 1").select("y", "stats"), bins)
    if counts.sum():
        model.centres, model.levels = pooled(LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS, ones, counts)
    return model


def score(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 if the score is at least ``threshold``) of every row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, 1):
            found = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
