"""Clusters, whitening and the quality classifier against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import clustering, quality, whitening

CLASHING = ("cluster", "x", "upper", "distance", "component", "n", "stats", "score", "h")


def vectors_of(spark, rows, kind="array<float>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(5)


def plain_clusters(rows, clusters, rounds, dims):
    """K-means with Python's integers."""
    kept = [(k, [math.floor(256 * float(c)) for c in v]) for k, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"2:{k}".encode()).hexdigest(), x) for k, x in kept if k is not None)[:clusters]
    now = [x for _, x in first]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for r in range(rounds + 1):
        mine = [min(range(len(now)), key=lambda j: (far(x, now[j]), j)) for _, x in kept]
        if r < rounds:
            members = [[x for (_, x), m in zip(kept, mine) if m == j] for j in range(len(now))]
            now = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(members, now)]
    return sorted((repr(k), m, far(x, now[m])) for (k, x), m in zip(kept, mine)), now


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters_equal_plain_k_means(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 6))
    rows = [(i, (centres[rng.integers(9)] + spread * rng.normal(size=6)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(60)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, rows[8][1])]
    rows += [(800, None), (801, []), (802, [1.0] * 5), (803, [1.0] * 5 + [None]), (804, [1.0] * 5 + [float("nan")]), (805, [float("inf")] * 6)]
    rows += [(810 + i, [float(rng.integers(-2, 3)) for _ in range(6)]) for i in range(80)]  # ties
    found, centroids = clustering.cluster(vectors_of(spark, rows), clusters=20, dims=6)
    want, final = plain_clusters(rows, 20, 5, 6)
    assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want and centroids.tolist() == final
    totals = clustering.with_totals(found, centroids).collect()
    assert {r.inertia for r in totals} == {sum(d for *_, d in want)}
    for r in totals:
        assert r.cluster_inertia == sum(d for _, m, d in want if m == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, final[r.cluster])).encode()).hexdigest()


def test_clusters_of_few_no_and_huge_vectors(spark):
    assert clustering.cluster(vectors_of(spark, [(1, None)]))[0].count() == 0
    assert clustering.with_totals(*clustering.cluster(vectors_of(spark, [(1, None)]))).count() == 0
    rows = [(1, [3e5, -5e5]), (2, [5e5, 5e5]), (3, [6e5, 0.0]), (4, [-5.2e5, -5.2e5]), (5, [5e5, 4.9e5])]  # the third is out of range
    found, _ = clustering.cluster(vectors_of(spark, rows, "array<double>"), clusters=3, dims=2)
    assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in found.collect()) == plain_clusters([r for r in rows if r[0] != 3], 3, 5, 2)[0]


def test_filters_save_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (60, 8))
    x = centres[rng.integers(60, size=4000)] + rng.integers(-40, 40, (4000, 8))
    group = clustering.grouped(centres)
    assert group.max() + 1 == 6
    now, state, spent = centres + rng.integers(-200, 200, (60, 8)), None, 0
    for _ in range(6):
        if state is None:
            state = clustering.assign(x, now, group)
        else:
            new = np.stack([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else now[j] for j in range(60)])
            *state, measured = clustering.reassign(x, *state, new, np.sqrt(((new - now) ** 2).sum(1)), group)
            now, spent = new, spent + measured
        assert (state[0] == clustering.squared(x, now).argmin(1)).all()
        root = np.sqrt(clustering.squared(x, now))
        mine = root[np.arange(len(x)), state[0]]
        root[np.arange(len(x)), state[0]] = np.inf
        assert (state[1] >= mine - 1e-6).all() and all((state[2][:, g] <= root[:, group == g].min(1) + 1e-6).all() for g in range(6))  # bounds hold
    assert spent < 0.1 * 5 * x.shape[0] * 60


def plain_whitening(rows, k):
    """Rows, covariance and eigenvectors by the whole matrix."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return centred @ vectors / np.sqrt(values), values / (centred**2).sum() * n, [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(9)
    mixed = rng.normal(size=(70, 70)) * np.linspace(3, 0.5, 70)
    good = [(i, (rng.normal(size=70) @ mixed + 5).astype(np.float32).tolist()) for i in range(600)]
    odd = [(None, good[3][1]), (7, good[7][1]), (9, good[8][1])]
    bad = [(700, None), (701, []), (702, [1.0] * 69), (703, [1.0] * 69 + [None]), (704, [float("nan")] * 70), (705, [float("-inf")] * 70)]
    rows = good + odd
    out = whitening.whiten(vectors_of(spark, rows + bad)).collect()
    assert len(out) == 32 * len(rows) and {r.n for r in out} == {len(rows)} and 0 <= out[0].identity_error < 1e-9 and len({r.identity_error for r in out}) == 1
    want, explained, deviation = plain_whitening(rows, 32)
    by_row = {}
    for r in out:
        by_row.setdefault((repr(r.vec_id), r.deviation), {})[r.component] = r
    ordered = [by_row[repr(k), d] for (k, _), d in zip(rows, deviation)]
    got = np.array([[r[j].whitened for j in range(1, 33)] for r in ordered])
    signs = np.sign((got * want).sum(0))
    assert np.abs(got * signs - want).max() < 1e-7
    assert np.allclose([ordered[0][j].explained for j in range(1, 33)], explained, rtol=1e-9)


def test_lobpcg_takes_steps_and_certifies():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    size = np.concatenate([[9, 9, 8.9, 7, 6.5, 6.4], np.linspace(6, 0.1, 294)])
    matrix = (q * size) @ q.T
    calls = []

    def product(basis):
        calls.append(basis.shape[1])
        trace = np.zeros((300, 1))
        trace[0] = np.trace(matrix)
        return np.hstack([matrix @ basis, trace])

    values, vectors, trace, residual, steps = whitening.lobpcg(product, 300, 6, guard=4)
    assert steps > 10 and max(calls) == 30 and residual <= whitening.CERTIFIED and math.isclose(trace, size.sum())
    assert np.allclose(values, size[:6], rtol=1e-12) and np.abs(matrix @ vectors - vectors * values).max() < 1e-8 and np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-12


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [None])])).count() == 0
    for rows in ([(1, [0.5, 2.0])], [(i, [0.25, -1.0]) for i in range(5)]):
        out = whitening.whiten(vectors_of(spark, rows)).collect()
        assert len(out) == 2 * len(rows) and all((r.whitened, r.explained, r.identity_error, r.deviation) == (0, 0, 0, 0) for r in out)
    line = [(i, [float(i), float(2 * i), 1.0]) for i in range(9)] + [(50, [1.0, 2.0])]  # one direction; another length goes
    out = whitening.whiten(vectors_of(spark, line)).collect()
    assert len(out) == 27 and out[0].identity_error < 1e-12
    first = sorted(abs(r.whitened) for r in out if r.component == 1)
    assert np.allclose(first, sorted(abs(i - 4) / math.sqrt(20 / 3) for i in range(9)))
    assert all(r.whitened == 0 and r.explained == 0 for r in out if r.component > 1)


def test_deviation_beyond_doubles():
    mean = whitening.Centred(10**6, [7, 10**12 + 3])
    x = np.array([[3 * 10**5, 10**6], [-(10**7), 5 * 10**6]])
    want = [sum((10**6 * a - s) ** 2 for a, s in zip(row, (7, 10**12 + 3))) for row in x.tolist()]
    assert mean.deviation(x) == [v if v < 2**63 else None for v in want] and None in mean.deviation(x * 10)


def plain_isotonic(y):
    """Every level is the largest lower mean: max over starts of min over ends."""
    return [max(min(sum(y[a : b + 1]) / (b + 1 - a) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]


def test_pooling_equals_plain_isotonic_regression():
    rng = np.random.default_rng(2)
    y = (rng.random(60) < np.linspace(0.1, 0.9, 60)).astype(int)
    centres, levels = quality.pooled(np.arange(60.0), y, np.ones(60, int))
    want = plain_isotonic(y.tolist())
    assert np.allclose(levels, sorted(set(want))) and (np.diff(centres) > 0).all() and (np.diff(levels) > 0).all()
    assert quality.pooled(np.arange(3.0), np.array([0, 2, 0]), np.array([0, 4, 0]))[1].tolist() == [0.5]


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(8)
    p = len(quality.NAMES)
    model = quality.Model(0.5, np.zeros(p), np.ones(p), rng.standard_normal((p, 20_000)) / math.sqrt(p), rng.uniform(0, 2 * math.pi, 20_000))
    x = rng.normal(size=(12, p))
    f = model.features(x)[:, :-1]
    assert np.abs(f @ f.T - np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * p))).max() < 0.05


def test_statistics_of_odd_texts():
    assert len(quality.NAMES) == len(quality.statistics("a b"))
    for text in (None, "", " \n", "\ud800", "!!", "一二三。\n四", "a" * 3_000_000, "word " * 300_000, "\x00\x01 \x02"):
        found = quality.statistics(text)
        assert len(found) == len(quality.NAMES) and all(map(math.isfinite, found))
    long = "Some words of plain prose, 12 of them. And | more $$$\n" * 30_000  # several pieces
    assert np.allclose(quality._counted(long), 30_000 * quality._counted("Some words of plain prose, 12 of them. And | more $$$\n"))


def test_quality_tells_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats = quality.statistics_of(docs)
    model = quality.fit(stats, labels)
    assert (np.diff(model.levels) > 0).all()
    found = quality.score(stats, model).withColumn("held_out", quality.held_out())
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    # labels of held-out rows change nothing
    changed = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score(stats, quality.fit(stats, changed)).collect()}
    assert all(math.isclose(again[r.doc_id], r.score, abs_tol=1e-6) for r in rows)


def test_quality_of_odd_tables(spark, docs_of):
    rng = random.Random(6)
    good = [" ".join(rng.choice("the of and water house light people again".split()) for _ in range(40)) + "." for _ in range(60)]
    bad = ["SPAM!! " * rng.randint(5, 60) for _ in range(60)]
    texts = good + bad + [None, "", "x", "plain words here.", "no id"]
    ids = list(range(120)) + [200, 201, 7, 7, None]
    docs = docs_of(texts, ids=ids, extra=True)
    labels = spark.createDataFrame([(i, int(i < 60), "x") for i in range(120)] + [(200, None, "x"), (None, 1, "x"), (999, 0, "x"), (3, 1, "x")], "doc_id long, quality int, stats string")
    stats = quality.statistics_of(docs)
    out = quality.score(stats, quality.fit(stats, labels)).collect()
    assert len(out) == len(texts) and sum(r.predicted == (r.doc_id < 60) for r in out if r.doc_id is not None and r.doc_id < 120 and r.doc_id != 7) == 119
    for few, prior in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0)):
        assert {r.score for r in quality.score(stats, quality.fit(stats, few)).collect()} == {prior}
    assert quality.score(quality.statistics_of(docs.limit(0)), quality.fit(stats, labels)).count() == 0
    no_last = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 4)
    assert quality.fit(stats, no_last).centres is None and all(0 <= r.score <= 1 for r in quality.score(stats, quality.fit(stats, no_last)).collect())
