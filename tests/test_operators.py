import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandloom.operators import gcbins, genes, metrics, models, orfs, overlap, tis
from tests.test_orfs import dna, scaffolds


def test_gc_bins_equal_the_recurrence(spark):
    rng = random.Random(4)
    for n in (0, 1, 5, 400):
        values = sorted(rng.choice([rng.random(), 0.2 + 0.01 * rng.randint(0, 70), rng.uniform(0.3, 0.4)]) for _ in range(n))
        limits, j, want = [*gcbins.thresholds(), 9.0], 0, {}
        for i, v in enumerate(values):
            if np.float32(v) > np.float32(limits[j]) and j < gcbins.N_BINS - 1:
                j += 1
            want[i] = j
        rows = spark.createDataFrame(list(enumerate(values)), "i long, gc double")
        assert {r.i: r.bin for r in gcbins.assign_bins(rows, "gc", ("i",)).collect()} == want


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        a, n = rng.randint(0, 20_000), 3 * rng.randint(30, 1500)
        rows.append((rng.randint(0, 1), rng.choice("+-"), a, a + n, n, 40_000))
    rows += [(0, "+", 39_000, 1_000, 2_000, 40_000), (0, "+", 39_500, 2_000, 2_500, 40_000)]
    table = spark.createDataFrame(rows, "scaffold_id long, strand string, t_start int, end int, len int, host_len int").distinct()
    want = set()
    for x in rows:
        for y in rows:
            if x[:2] == y[:2] and (x[2], x[3]) < (y[2], y[3]):
                ex, ey = (r[3] + (r[5] if r[3] < r[2] else 0) for r in (x, y))
                o = min(ex, ey) - max(x[2], y[2])
                if o >= 120 and (o in (x[4], y[4]) or o / min(x[4], y[4]) >= 0.6):
                    want.add((x[0], x[1], x[2], x[3], y[2], y[3], o, "INCLUDE" if o in (x[4], y[4]) else "INTERSECT"))
    assert set(map(tuple, overlap.overlaps(table, bin_size=512).collect())) == want == set(map(tuple, overlap.overlaps(table).collect()))
    assert want


def test_start_profiles(spark):
    rng = random.Random(9)
    table = scaffolds(spark, [dna(rng, 4000) for _ in range(4)])
    found = orfs.with_context(orfs.find_orfs(table, with_starts=True), table)
    whole = {(r.scaffold_id, r.strand): r.seq for r in orfs.strands(table).collect()}
    keys = ["scaffold_id", "strand", "phase", "end"]
    got = tis.windows(found, ("ATG", "GTG", "TTG"), keys).collect()
    want = 0
    for r in found.collect():
        if r.len > 300:
            seq = whole[r.scaffold_id, r.strand]
            want += sum(s >= r.t_start and s >= 50 and s + 15 <= len(seq) for s in r.starts)
            want += sum(seq[p : p + 3] in ("ATG", "GTG", "TTG", "CTG") for p in range(max(50, r.t_start - 150), min(r.t_start - 3, len(seq) - 15)))
    assert len(got) == want
    assert all(r.window == whole[r.scaffold_id, r.strand][r.start - 50 : r.start + 15] for r in got)
    logs = tis.profile_logs(tis.profile_counts(tis.windows(found, ("ATG",), keys), 1), 1)
    assert all(abs(r.s - 1) < 1e-9 for r in logs.groupBy("profile", "row", F.substring("kmer", 1, 1)).agg(F.sum(F.exp("logp")).alias("s")).collect())


def test_profiles_fitted_from_counts(spark):
    """Counts of whole and cut windows, with ambiguous bases, against plain counting; fitted profiles against those of the table."""
    rng = random.Random(3)
    rows = [(rng.choice(tis.PROFILES), "".join(rng.choice("ACGTACGTACGTN") for _ in range(65))) for _ in range(300)] + [("U", "ACGTACG")]
    found = spark.createDataFrame(rows, "profile string, window string").repartition(3)
    for order in range(3):
        plain = Counter((p, i, w[i : i + order + 1]) for p, w in rows for i in range(len(w) - order) if "N" not in w[i : i + order + 1])
        logs = tis.profile_logs(tis.profile_counts(found, order), order).collect()
        assert {(r.profile, r.row, r.kmer): r.cnt - 1 for r in logs if r.cnt > 1} == plain
        assert len(logs) == 3 * (65 - order) * 4 ** (order + 1)
        counts = np.ones((3, 65 - order, 4 ** (order + 1)))
        for (p, i, k), n in plain.items():
            counts[tis.PROFILES.index(p), i, sum("ACGT".index(b) * 4**j for j, b in enumerate(reversed(k)))] += n
        assert np.allclose(tis.Profiles.fit(counts, order).table, tis.Profiles.of(logs, order).table, atol=1e-12)
    empty = tis.profile_counts(found.where("false"), 1).agg(F.count(F.lit(1)), F.max("cnt")).first()
    assert tuple(empty) == (3 * 64 * 16, 1)


def test_default_profile():
    logs = tis.default_logs()
    assert len(logs) == 3 * 63 * 64
    for r in (0, 30, 48, 49, 50, 62):
        for p in tis.PROFILES:
            assert abs(math.fsum(math.exp(x["logp"]) for x in logs if x["row"] == r and x["profile"] == p and x["kmer"][:2] == "AC") - 1) < 1e-9
    profiles = tis.Profiles.of(logs, 2)
    good = "ACTTCA" * 6 + "ATAGGAGGATTACA"[:14] + "ATG" + "GCTAAAGATGAA"
    plain = "".join("ACGT"[(7 * i * i + i) % 4] for i in range(50)) + "GTG" + "CCCCCCCCCCCC"
    a, b, c = profiles.scores([good, plain, "N" * 65], tis.AlterParams(7, 0.8, 5.2))
    assert a > b and abs(c - 1 / 7) < 1e-9


def test_alter_params():
    p = tis.alter_params({"A": 25, "C": 25, "G": 25, "T": 25})
    assert p.max_alter == 7 and abs(p.false_up + p.false_down - (p.max_alter - 1)) < 1e-9
    assert tis.alter_params({}).max_alter == tis.DEFAULT_ALTER


def test_best_start_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 10, 0.5), (1, 20, 0.9), (1, 30, 0.9)], "k long, start int, score double")
    assert tis.best_starts(rows, ["k"]).first().start == 20


def test_svm_separates_and_meets_its_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where((x**2).sum(1) > 4, 1, -1)
    svm = models.train_svm(x, y, 10.0)
    assert (np.sign(svm.decision(x)) == y).mean() > 0.97
    margin = y * svm.decision(x)
    alpha = np.zeros(len(x))
    for v, w in zip(svm.vectors, svm.weights):
        alpha[np.flatnonzero((x == v).all(1))[0]] = abs(w)
    assert (margin[alpha < 1e-9] > 1 - 1e-2).all() and (margin[alpha > 10 - 1e-6] < 1 + 1e-2).all()
    for kind in ("linear", "poly", "sigmoid", "rbf"):
        assert models.kernel(x, x, kind, 0.1).shape == (200, 200)


def test_perceptron_learns():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = models.train_perceptron(x, y, hidden=32, epochs=40, rate=5e-3)
    assert models.scores_of(y > 0.5, net.score(x) > 0.5)["f1"] > 0.9


def test_scaling_of_flat_features():
    x = np.array([[1.0, 2.0], [1.0, 4.0]])
    assert (models.MinMax.fit(x).apply(x) == [[0, 0], [0, 1]]).all()
    assert (models.Standard.fit(x).apply(x) == [[0, -1], [0, 1]]).all()


def test_metrics_without_positives(spark):
    r = metrics.classifier_metrics(spark.createDataFrame([(False, False)], "truth boolean, said boolean")).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_random_features_approximate_the_kernel():
    x = np.random.default_rng(0).normal(size=(20, 6))
    z = models.random_features(x, 0.1, 20_000)
    assert np.abs(z @ z.T - models.kernel(x, x, "rbf", 0.1)).max() < 0.05


def test_locations(spark):
    rows = [("+", False, False, 1, 30), ("-", True, False, 4, 30), ("+", False, True, 5, 60), ("+", False, False, 90, 20)]
    table = spark.createDataFrame(rows, "strand string, partial5 boolean, partial3 boolean, start int, stop int").withColumn("host_len", F.lit(100))
    assert [r[0] for r in table.select(genes.genbank_location()).collect()] == ["1..30", "complement(4..>30)", "5..>60", "join(90..100,1..20)"]


def test_vectors_stay_in_the_worker(spark):
    """Scores come from bases; no vector becomes a column."""
    from strandloom.functions import zcurve
    from strandloom.operators import models
    from strandloom.plans import predict

    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGT"), int(n))) for n in rng.integers(1, 400, 60)] + ["ACGNACG"]
    net = models.Perceptron(models.Standard(np.zeros(zcurve.DIM), np.ones(zcurve.DIM)), rng.normal(size=(4, zcurve.DIM)), np.zeros(4), rng.normal(size=4), 0.1)
    rows = spark.createDataFrame([(i, s, i % 3) for i, s in enumerate(seqs)], "i int, seq string, bin int")
    got = {r.i: r.i_score for r in predict.heuristic_scores(rows, {0: net, 1: net}).collect()}
    want = [net.score(zcurve.encode(s)[None])[0] if i % 3 < 2 else 0.0 for i, s in enumerate(seqs)]
    assert np.allclose([got[i] for i in range(len(seqs))], want, atol=1e-12)


def test_bins_by_arithmetic_equal_all_comparisons(spark):
    from strandloom.operators import gcbins

    limits = np.array(gcbins.thresholds(), np.float32)
    values = np.unique(np.concatenate([limits, np.nextafter(limits, np.float32(2)), np.nextafter(limits, np.float32(-1)), np.linspace(0, 1, 4001, dtype=np.float32)])).astype(float)
    wanted = gcbins.wanted_bin(F.col("g"))
    assert len(wanted._jc.toString()) < 6_000  # a comparison for each threshold is too long to be compiled
    got = {r.g: r.b for r in spark.createDataFrame([(float(v),) for v in values], "g double").select("g", wanted.alias("b")).collect()}
    assert [got[v] for v in values.tolist()] == [int((v > np.array(gcbins.thresholds())).sum()) for v in values]
