"""Classifiers of many rows against exact ones of all rows."""

import numpy as np
import pandas as pd
import pytest

from strandloom.operators import models, svm
from strandloom.plans import predict


def two_clouds(n, seed=1, gap=1.2, dims=6):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(n) < 0.4, 1, -1)
    return rng.normal(size=(n, dims)) + gap * y[:, None] * np.array([1, 1, 0.5, 0, 0, 0])[:dims], y


def table_of(spark, x, y):
    return spark.createDataFrame(pd.DataFrame({"label": y.tolist(), "z": x.tolist()})).selectExpr("cast(label as int) as label", "z", "'x' as row", "1 as chunk").repartition(6)


def test_cascade_equals_the_exact_machine(spark, monkeypatch):
    x, y = two_clouds(2_400)
    scale = models.MinMax.fit(x)
    want = models.train_svm(scale.apply(x), y.astype(float), 100.0)
    monkeypatch.setattr(svm, "CHUNK", 500)
    monkeypatch.setattr(svm, "MERGE", 1_200)
    found_scale, found = svm.fit(table_of(spark, x, y))
    assert isinstance(found, models.SVM) and np.allclose(found_scale.low, scale.low) and np.isclose(found.gamma, want.gamma)
    other, _ = two_clouds(3_000, seed=2)
    a, b = want.decision(scale.apply(other)), found.decision(scale.apply(other))
    assert (np.sign(a) == np.sign(b)).mean() > 0.998 and np.abs(a - b).max() < 0.2 and abs(len(found.vectors) - len(want.vectors)) < 0.02 * len(want.vectors)


def test_costs_by_class_and_small_tables(spark):
    x, y = two_clouds(300)
    scale, found = svm.fit(table_of(spark, x, y), scale="standard", cost=1.0, balanced=True, gamma="scale")
    own = models.Standard.fit(x)
    weight = np.where(y > 0, len(y) / 2 / (y > 0).sum(), len(y) / 2 / (y < 0).sum())
    z = own.apply(x)
    want = models.train_svm(z, y.astype(float), weight, 1.0 / (z.shape[1] * z.var()))
    assert np.isclose(found.gamma, want.gamma) and np.allclose(found.decision(scale.apply(x)), want.decision(z), atol=0.02)
    rows = table_of(spark, x, y)
    assert svm.fit(rows.where("label = 1")) is None and svm.fit(rows.limit(0)) is None


@pytest.mark.parametrize("asked", [True, False])
def test_random_features_where_classes_overlap(spark, monkeypatch, asked):
    x, y = two_clouds(4_000, gap=0.35)
    monkeypatch.setattr(svm, "CHUNK", 600)
    monkeypatch.setattr(svm, "MERGE", 700)  # far fewer than the support vectors
    monkeypatch.setattr(svm, "FEATURES", 256)
    scale, found = svm.fit(table_of(spark, x, y), cost=1.0, approximate=asked)
    assert isinstance(found, svm.Fourier)
    want = models.train_svm(models.MinMax.fit(x).apply(x), y.astype(float), 1.0)
    other, truth = two_clouds(3_000, seed=5, gap=0.35)
    a, b = want.decision(models.MinMax.fit(x).apply(other)) > 0, found.decision(scale.apply(other)) > 0
    assert (a == b).mean() > 0.9 and (b == (truth > 0)).mean() > (a == (truth > 0)).mean() - 0.02
    f = found.features(scale.apply(x))  # the optimum: no gradient
    short = np.maximum(0, 1 - y * (f @ found.weights))
    gradient = np.append(found.weights[:-1], 1e-6 * found.weights[-1]) - 2 * f.T @ (y * short)
    assert np.abs(gradient).max() < 1.0 and np.abs(2 * f.T @ y).max() > 100


def test_many_support_vectors_are_foretold(spark, monkeypatch):
    """No cascade is begun that would end without a machine, and few passes over all rows are made."""
    x, y = two_clouds(4_000, gap=0.35)
    table = table_of(spark, x, y)
    for name, value in (("CHUNK", 200), ("MERGE", 700), ("FEATURES", 128), ("SAMPLE", 1_500)):
        monkeypatch.setattr(svm, name, value)
    passes, summed = [], svm.summed
    monkeypatch.setattr(svm, "summed", lambda rows, find, *more: passes.append(1) or summed(rows, find, *more))
    monkeypatch.setattr(svm, "_reduced", lambda *a: pytest.fail("a chunk was trained"))
    scale, found = svm.fit(table, cost=1.0)
    assert isinstance(found, svm.Fourier) and len(passes) <= 8
    f = found.features(scale.apply(x))
    gradient = np.append(found.weights[:-1], 1e-6 * found.weights[-1]) - 2 * f.T @ (y * np.maximum(0, 1 - y * (f @ found.weights)))
    assert np.abs(gradient).max() < 1.0


def test_classifiers_are_saved(spark, tmp_path):
    x, y = two_clouds(200)
    for approximate in (False, True):
        scale, machine = svm.fit(table_of(spark, x, y), approximate=approximate)
        predict.save_classifier(spark, f"file://{tmp_path}/m", scale, machine)
        scale2, back = predict.load_classifier(spark, f"file://{tmp_path}/m")
        assert type(back) is type(machine) and np.allclose(back.probability(scale2.apply(x)), machine.probability(scale.apply(x)))


def plain_self_train(z, positive, rounds=20):
    pos, neg = np.flatnonzero(positive), np.flatnonzero(~positive)
    for k in range(rounds + 1):
        rows = np.concatenate((pos, neg))
        y = np.concatenate((np.ones(len(pos)), -np.ones(len(neg))))
        scale = models.Standard.fit(z[rows])
        x = scale.apply(z[rows])
        cost = len(rows) / 2 / np.where(y > 0, len(pos), len(neg)) if k else 10.0
        machine = models.train_svm(x, y, cost, 1.0 / (x.shape[1] * x.var()))
        score = machine.probability(scale.apply(z))
        pos, neg = np.flatnonzero(score > 0.7), np.flatnonzero(score <= 0.31)
        if not len(pos) or not len(neg) or (k and len(neg) / len(pos) >= 8):
            break
    return scale, machine


def test_self_training_of_all_rows(spark):
    x, y = two_clouds(500, seed=3, gap=1.0)
    rng = np.random.default_rng(4)
    first = np.where(rng.random(500) < 0.15, y < 0, y > 0)  # some labels wrong
    table = spark.createDataFrame(pd.DataFrame({"z": x.tolist(), "positive": first.tolist()})).repartition(4)
    scale, found = predict.self_train(table, max_iter=3)
    own, want = plain_self_train(x, first, 3)
    a, b = want.decision(own.apply(x)), found.decision(scale.apply(x))
    assert (np.sign(a) == np.sign(b)).mean() > 0.99 and ((b > 0) == (y > 0)).mean() > 0.9
    assert predict.self_train(table.where("positive")) is None
