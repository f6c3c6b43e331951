import hashlib

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import zcurve
from strandloom.operators import gcbins, genes, models, orfs
from strandloom.plans import bank, develop
from strandloom.session import cut
from strandloom.sources import readers, writers
from tests.test_predict import planted


def test_label_train_and_banks(spark, tmp_path):
    seq, _ = planted(4, 40)
    table = spark.createDataFrame([(0, "g", seq)], "scaffold_id long, name string, sequence string")
    frames = develop.label_frames(table, min_length=120)
    assert {r.label for r in frames.select("label").distinct().collect()} >= {1, -1}
    develop.write_labelled(frames, table, f"file://{tmp_path}/labels")
    both = readers.read_labelled(spark, f"file://{tmp_path}/labels/positive.fna", f"file://{tmp_path}/labels/negative.fna")
    assert both.count() == frames.where("label is not null").count()
    assert both.select("scaffold_id").distinct().count() == both.count()
    net = models.train_perceptron(np.random.default_rng(1).normal(size=(60, zcurve.DIM)), np.tile([0.0, 1.0], 30), epochs=1)
    bank.save_bank(spark, {3: net, 4: net}, f"file://{tmp_path}/bank")
    back = bank.load_bank(spark, f"file://{tmp_path}/bank")
    x = zcurve.encode_many(["ATGGCCTAA" * 20])
    assert set(back) == {3, 4} and np.allclose(back[3].score(x), net.score(x))
    assert set(bank.default_bank(spark)) == set(range(61))


def labelled_frames(spark, bands=((0.36, 500), (0.60, 700)), copies=1):
    rows = []
    for gc, n in bands:
        seqs, truth = bank.synthetic(np.random.default_rng(int(gc * 100)), gc, n)
        rows += [(f"s{gc}_{i}", s, int(t)) for i, (s, t) in enumerate(zip(seqs, truth))]
    return rows * copies, spark.createDataFrame(rows * copies, "name string, sequence string, label int").repartition(4)


def test_a_scorer_for_each_bin(spark, tmp_path):
    rows, table = labelled_frames(spark)
    path = f"file://{tmp_path}/bank"
    bank.train_bank(table, epochs=12).write.parquet(path)
    found = {r.bin: r for r in spark.read.parquet(path).collect()}
    assert set(found) == set(range(61)) == set(bank.load_bank(spark, path))
    assert all(r.low <= r.bin <= r.high and min(r.n_pos, r.n_neg) >= bank.LEAST and r.held_out > 0 for r in found.values())
    assert found[40].low > found[17].low and max(r.n_pos for r in found.values()) > bank.LEAST  # scorers of far bins learn from other frames
    assert np.mean([r.held_out / (r.n_pos + r.n_neg + r.held_out) for r in found.values()]) < 0.2
    assert np.average([r.accuracy for r in found.values()], weights=[r.held_out for r in found.values()]) > 0.85
    again = {r.bin: r for r in bank.train_bank(table.repartition(3), epochs=12).collect()}
    assert all(np.allclose(again[k].w2, r.w2) for k, r in found.items())  # whatever the partitions


def test_reservoirs_and_borrowing_equal_a_plain_walk(spark):
    rows, table = labelled_frames(spark, ((0.30, 60), (0.32, 90), (0.50, 40)))
    rows += [("null", None, 1), ("none", "ATG", None), ("low", "atgcgcgcg", 0)]
    table = table.unionByName(spark.createDataFrame(rows[-3:], table.schema))
    limits = gcbins.thresholds()

    def bin_of(s):
        g = np.float64(np.float32(sum(c in "GC" for c in s) / len(s)))
        return min(sum(g > t for t in limits), 60)

    cut = lambda d: (d[2:], int(d[:2], 16) < bank.HELD_OUT)
    plain = {}
    for n, s, y in rows:
        if s is not None and y is not None:
            s = s.upper()
            plain.setdefault((bin_of(s), y), []).append((*cut(hashlib.md5(f"{n} {s}".encode()).hexdigest()), s))
    plain = {k: sorted(v)[:7] for k, v in plain.items()}
    sample = bank.reservoirs(table, 7)
    got = {}
    for r in sample.collect():
        got.setdefault((r.bin, r.label), []).append((r.h, r.held, r.sequence))
    assert {k: sorted(v) for k, v in got.items()} == plain
    counts = {k: sum(not held for _, held, _ in v) for k, v in plain.items()}
    for b, low, high in bank.widths(counts, 12):
        enough = lambda w: all(sum(n for (k, y), n in counts.items() if abs(k - b) <= w and y == label) >= 12 for label in (0, 1))
        w = next((w for w in range(62) if enough(w)), 61)
        assert (low, high) == (max(0, b - w), min(60, b + w))
    for r in bank.dealt(sample, 9, 12).groupBy("target", "label").count().collect():
        assert r["count"] <= 9


def test_labels_of_one_kind_give_no_scorer(spark):
    _, table = labelled_frames(spark, ((0.5, 40),))
    assert bank.train_bank(table.where("label = 1"), epochs=1).count() == 0
    assert bank.train_bank(table.limit(0), epochs=1).count() == 0


def test_two_drivers_may_publish(spark, tmp_path):
    from strandloom.session import publish

    for n in (3, 5):
        publish(spark.range(n), f"file://{tmp_path}/shared")
    assert spark.read.parquet(f"file://{tmp_path}/shared").count() == 3 and len(list(tmp_path.iterdir())) == 1


def test_vectors_of_clusters_are_no_python_lists():
    import numpy as np
    import pyarrow as pa

    from strandloom.operators import svm

    x = np.arange(12.0).reshape(4, 3)
    assert np.array_equal(svm.matrix(pa.array(x.tolist()).slice(1, 2)), x[1:3])


def test_labelled_frames_without_bases_are_numbered_by_label(spark, tmp_path):
    seqs = {f"s{i % 7}{i}": planted(i, 3)[0] for i in range(12)}
    table = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs.items())], "scaffold_id long, name string, sequence string")
    frames = cut(orfs.find_orfs(table).withColumn("score", F.lit(0.5)).withColumn("label", F.when(F.col("len") % 9 == 0, 1).when(F.col("len") % 9 == 3, -1)))
    develop.write_labelled(frames, table, f"file://{tmp_path}/plain")
    develop.write_labelled(orfs.with_sequence(frames, table), table, f"file://{tmp_path}/spelled")
    parts = lambda path: "".join(p.read_text() for p in sorted(path.glob("part-*")))
    for label, kind in ((1, "positive"), (-1, "negative")):
        rows = genes.with_coordinates(orfs.with_sequence(frames.where(F.col("label") == label), table)).collect()
        names = list(seqs)
        order = sorted(rows, key=lambda r: (names[r.scaffold_id], r.stop, r.start, r.strand))
        gff = [line.split("\t") for line in parts(tmp_path / "plain" / f"{kind}.gff").splitlines()]
        assert [(x[0], int(x[3]), int(x[4]), x[6]) for x in gff] == [(names[r.scaffold_id], r.start, r.stop, r.strand) for r in order]
        assert [x[8].split(";")[0] for x in gff] == [f"ID=orf{i:06d}" for i in range(1, len(order) + 1)]
        wrapped = lambda s: "".join(s[i : i + 80] + "\n" for i in range(0, len(s), 80))
        text = "".join(f">{names[r.scaffold_id]}:{r.start}..{r.stop}({r.strand}) score=0.500\n{wrapped(r.seq)}" for r in order)
        assert parts(tmp_path / "plain" / f"{kind}.fna") == parts(tmp_path / "spelled" / f"{kind}.fna") == text


def test_lines_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def line(i):
        made.add(1)
        return f"{i:05d}"

    rows = cut(spark.range(25_000).repartition(3).select((F.col("id") + 1).alias("ordinal")))
    assert writers.write_text(rows.select("ordinal", line("ordinal").alias("line")), f"file://{tmp_path}/lines", ["head"]) == 25_000
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "lines").glob("part-*"))]
    assert sum(parts, []) == ["head", *(f"{i:05d}" for i in range(1, 25_001))] and sum(map(bool, parts)) > 1
    assert made.value == 25_000
