"""Banks of scorers, a table with a perceptron for each GC bin: training from labelled frames, saving, and the default bank.

``train_bank`` trains a scorer for each GC bin from frames with labels.  Of each bin and class it takes the ``PER_BIN`` frames of least digest (Spark keeps so many a
task and bin before it shuffles, so a bin may hold any share of all frames).  A bin with fewer than ``LEAST`` frames of a class borrows: it is widened by a bin on both sides
until both classes have as many, and takes the nearest ``PER_BIN`` of them.  Each bin is then one Arrow group that trains by itself, all bins in parallel, and is measured on its held-out frames.

The default bank is trained on synthetic sequences of ``BANDS`` of GC content, a task for each band, and kept in the shared
folder, so that it is trained once for a cluster and not by every prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandloom.functions import codes, zcurve
from strandloom.functions import sequence as S
from strandloom.operators import gcbins, models
from strandloom.session import cut, exists, publish, shared_dir

#: Middle of the GC bands that have a model of their own.
BANDS = (0.28, 0.36, 0.44, 0.52, 0.60, 0.68)
#: To be raised with any change of the training.
VERSION = 2
SAMPLES, EPOCHS = 900, 8
#: Frames of a bin and class that train its scorer, at most, and those below which it borrows from its neighbours.
PER_BIN, LEAST = 2_000, 200
#: The share of frames held out, in 256ths of a digest's first byte.
HELD_OUT = 26
MEASURES = "low int, high int, n_pos bigint, n_neg bigint, held_out bigint, accuracy double, precision double, recall double, f1 double"
COLUMNS = "bin int, mean array<double>, std array<double>, w1 array<array<double>>, b1 array<double>, w2 array<double>, b2 double"


def synthetic(rng: np.random.Generator, gc: float, n: int) -> tuple[list[str], np.ndarray]:
    """Coding sequences with a codon bias, and others without one, of a GC content."""
    letters = np.array(list("ACGT"))
    base = np.array([1 - gc, gc, gc, 1 - gc]) / 2
    place = [np.array([1.3, 0.8, 1.4, 0.5]), np.array([1.25, 0.9, 0.7, 1.15])]
    third = np.clip(gc + 1.2 * (gc - 0.5), 0.05, 0.95)
    coding = [base * place[0], base * place[1], np.array([1 - third, third, third, 1 - third]) / 2]
    stops = set(codes.stops(11))

    def triplets(shares: list[np.ndarray], m: int) -> list[str]:
        columns = [letters[np.minimum(np.searchsorted(np.cumsum(p / p.sum()), rng.random(m), "right"), 3)] for p in shares]
        return list(map("".join, zip(*columns)))

    seqs, truth = [], []
    for k in range(n):
        m = int(rng.integers(30, 400))
        if k % 4 == 1:  # a coding sequence out of frame is no gene
            body = "".join(triplets(coding, m))[1 + (k // 4) % 2 :]
            body = body[: len(body) // 3 * 3]
        else:
            body = "".join(t for t in triplets(coding if k % 2 == 0 else [base] * 3, m) if t not in stops)
        seqs.append(f"ATG{body}TAA")
        truth.append(float(k % 2 == 0))
    return seqs, np.array(truth)


def trained(gc: float) -> models.Perceptron:
    """The model of a GC band."""
    seqs, truth = synthetic(np.random.default_rng(round(gc * 100)), gc, SAMPLES)
    return models.train_perceptron(zcurve.encode_many(seqs), truth, epochs=EPOCHS)


def _row(k: int, m: models.Perceptron) -> tuple:
    return k, m.scale.mean.tolist(), m.scale.deviation.tolist(), m.w1.tolist(), m.b1.tolist(), m.w2.tolist(), float(m.b2)


def digest() -> Column:
    """Of a labelled frame's name and sequence; the first byte decides what is held out, the rest is the order of frames."""
    return F.md5(F.concat_ws(" ", "name", "sequence"))


def held_out() -> Column:
    """Whether a labelled frame is held out of training: its digest decides."""
    return F.conv(F.substring(digest(), 1, 2), 16, 10).cast("int") < HELD_OUT


def reservoirs(labelled: DataFrame, rows: int = PER_BIN) -> DataFrame:
    """bin, label, held, h, sequence: of each bin and class the frames of least digest.  ``labelled``: name, sequence (a frame's bases), label 1 or 0."""
    seq = F.upper("sequence")
    gc = F.coalesce(S.gc_fraction(F.col("sequence")), F.lit(0.0))
    kept = labelled.where("label is not null and sequence is not null").select("name", seq.alias("sequence"), F.col("label").cast("int").alias("label"))
    kept = kept.select(F.least(gcbins.wanted_bin(gc), F.lit(gcbins.N_BINS - 2)).alias("bin"), "label", held_out().alias("held"), F.substring(digest(), 3, 30).alias("h"), "sequence")
    place = F.row_number().over(Window.partitionBy("bin", "label").orderBy("h", "sequence"))
    return kept.withColumn("r", place).where(F.col("r") <= rows).drop("r")


def widths(counts: dict[tuple[int, int], int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(bin, low, high): each bin with the least number of neighbours on both sides that gives both classes ``least`` frames, or all bins.  ``counts``: by bin and label."""
    out = []
    for b in range(gcbins.N_BINS - 1):
        for w in range(gcbins.N_BINS):
            if all(sum(counts.get((k, label), 0) for k in range(b - w, b + w + 1)) >= least for label in (0, 1)):
                break
        out.append((b, max(0, b - w), min(gcbins.N_BINS - 2, b + w)))
    return out


def dealt(sample: DataFrame, rows: int = PER_BIN, least: int = LEAST) -> DataFrame:
    """target, low, high and the columns of ``sample``: for each bin its training frames, own and borrowed, the nearest first."""
    counts = {(r["bin"], r["label"]): r["count"] for r in sample.where("not held").groupBy("bin", "label").count().collect()}
    plan = sample.sparkSession.createDataFrame(widths(counts, least), "target int, low int, high int")
    near = sample.join(F.broadcast(plan), F.col("bin").between(F.col("low"), F.col("high")))
    place = F.row_number().over(Window.partitionBy("target", "label").orderBy(F.abs(F.col("bin") - F.col("target")), "h", "bin", "sequence"))
    return near.withColumn("r", place).where(F.col("r") <= rows).drop("r")


def train_bank(labelled: DataFrame, rows: int = PER_BIN, least: int = LEAST, **options) -> DataFrame:
    """``COLUMNS`` and ``MEASURES`` (on held-out frames), a row for each GC bin.  ``options``: of ``models.train_perceptron``.  Labels of one kind only give no scorer."""
    sample = cut(reservoirs(labelled, rows), "bank-sample")
    vectors = sample.withColumn("z", zcurve.zcurve(3)(F.col("sequence")))
    groups = dealt(cut(vectors, "bank-vectors"), rows, least).select("target", "low", "high", "label", "held", "h", "z")
    names = [c.split()[0] for c in f"{COLUMNS}, {MEASURES}".split(", ")]
    schema = to_arrow_schema(_parse_datatype_string(f"{COLUMNS}, {MEASURES}"))

    def train(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["label"].to_numpy(), np.array(group["h"].to_pylist())))  # groups come in any order
        x = np.array(group["z"].to_pylist())[order]
        y, held = group["label"].to_numpy()[order].astype(float), group["held"].to_numpy()[order]
        if len(set(y[~held])) < 2:
            return schema.empty_table()
        net = models.train_perceptron(x[~held], y[~held], **options)
        found = models.scores_of(y[held] > 0, net.logits(x[held]) > 0)
        n_pos, n = int(y[~held].sum()), int((~held).sum())
        first = group.slice(0, 1).to_pylist()[0]
        row = (*_row(first["target"], net), first["low"], first["high"], n_pos, n - n_pos, int(held.sum()), *(found[k] for k in ("accuracy", "precision", "recall", "f1")))
        return pa.Table.from_pylist([dict(zip(names, row))], schema)

    return groups.groupBy("target").applyInArrow(train, f"{COLUMNS}, {MEASURES}")


def save_bank(spark: SparkSession, bank: dict[int, models.Perceptron], path: str) -> None:
    """A table of scorers by GC bin."""
    spark.createDataFrame([_row(k, m) for k, m in sorted(bank.items())], COLUMNS).write.mode("overwrite").parquet(path)


def load_bank(spark: SparkSession, path: str) -> dict[int, models.Perceptron]:
    """Scorers by GC bin; the table has one row for each bin."""
    arrays = lambda r: models.Perceptron(models.Standard(np.array(r.mean), np.array(r.std)), np.array(r.w1), np.array(r.b1), np.array(r.w2), r.b2)
    return {r.bin: arrays(r) for r in spark.read.parquet(path).collect()}


def _train(spark: SparkSession) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                yield pd.DataFrame([_row(int(k), trained(BANDS[k]))], columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return spark.range(0, len(BANDS), 1, len(BANDS)).mapInPandas(run, COLUMNS)


def default_bank(spark: SparkSession) -> dict[int, models.Perceptron]:
    """A model for each GC bin but the last, which has none: that of the nearest band."""
    path = f"{shared_dir(spark)}/strandloom/bank-v{VERSION}"
    if not exists(spark, f"{path}/_SUCCESS"):
        publish(_train(spark), path)
    bands = load_bank(spark, path)
    middle = [t - 0.005 for t in gcbins.thresholds()]
    return {i: bands[min(range(len(BANDS)), key=lambda b: abs(BANDS[b] - m))] for i, m in enumerate(middle)}
