import random

import numpy as np
import pytest

from strandloom.functions import codes
from strandloom.operators import models
from strandloom.plans import bank, cli, predict
from tests.simulate import revcomp


def planted(seed=1, n=70, gc=0.45):
    """A sequence with genes of biased codons at known places, and those places (start, stop, strand)."""
    rng = random.Random(seed)
    bias = [c for c in codes.amino_acids(11) if c not in codes.stops(11)]
    weight = [(3 if c[0] in "AG" else 1) * (2 if c[1] in "AC" else 1) * (1.5 if c[2] in "GC" else 1) for c in bias]
    back = lambda m: "".join(rng.choices("ACGT", [1 - gc, gc, gc, 1 - gc], k=m))
    out, truth, at = [], [], 0
    for k in range(n):
        gap = back(rng.randint(60, 250))
        gene = "ATG" + "".join(rng.choices(bias, weight, k=rng.randint(120, 350))) + "TAA"
        strand = rng.choice("+-")
        out += [gap, gene if strand == "+" else revcomp(gene)]
        truth.append((at + len(gap) + 1, at + len(gap) + len(gene), strand))
        at += len(gap) + len(gene)
    return "".join(out), truth


@pytest.fixture(scope="module")
def genome(spark):
    seq, truth = planted()
    return spark.createDataFrame([(0, "g", seq)], "scaffold_id long, name string, sequence string"), truth


@pytest.mark.parametrize("mode", ["meta", "single"])
def test_planted_genes_are_found(genome, mode):
    table, truth = genome
    found = predict.predict(table, predict.Options(mode=mode, max_iter=3)).collect()
    stop = lambda a, b, s: (s, b if s == "+" else a)
    want, got = {stop(*t) for t in truth}, {stop(r.start, r.stop, r.strand) for r in found}
    assert len(want & got) >= 0.8 * len(want)
    assert len(got) < 6 * len(want)
    assert all(0 <= r.score <= 1 for r in found)


def test_models_are_saved_and_loaded(spark, genome, tmp_path):
    table, _ = genome
    options = predict.Options(max_iter=1, cds_model=f"file://{tmp_path}/cds", tis_model=f"file://{tmp_path}/tis")
    first = predict.predict(table, options).select("start", "stop", "strand").collect()
    second = predict.predict(table, options).select("start", "stop", "strand").collect()
    assert len(set(first) & set(second)) > 0.8 * len(first)


def test_few_seeds_take_the_default_profile(spark):
    seq, truth = planted(6, 1)
    table = spark.createDataFrame([(0, "s", seq)], "scaffold_id long, name string, sequence string")
    found = predict.predict(table, predict.Options(mode="meta", threshold=0.0)).collect()
    plain = predict.predict(table, predict.Options(mode="meta", threshold=0.0, revise_tis=False)).collect()
    assert {(r.strand, r.phase, r.end) for r in found} == {(r.strand, r.phase, r.end) for r in plain}
    assert all(r.len >= 90 for r in found)


def test_a_bank_of_ones_own(spark, genome, tmp_path):
    table, _ = genome
    path = f"file://{tmp_path}/bank"
    bank.save_bank(spark, {k: m for k, m in bank.default_bank(spark).items() if k < 20}, path)
    found = predict.predict(table, predict.Options(mode="meta", revise_tis=False, threshold=-1.0, models=path))
    assert found.where("i_score = 0").count() > 0 and found.where("i_score > 0").count() > 0


def test_codes_are_told_apart(spark):
    rng = random.Random(5)
    gene = lambda: "ATG" + "".join(rng.choices(["GCA", "GAA", "AAA", "GGT", "TGA", "ATC"], k=200)) + "TAA"
    seq = "".join("".join(rng.choices("ACGT", k=90)) + gene() for _ in range(25))
    table = spark.createDataFrame([(0, "m", seq)], "scaffold_id long, name string, sequence string")
    scores = {r.code: r.score for r in predict.code_scores(table, lambda found: found.selectExpr("*", "double(len >= 300) as s")).collect()}
    assert scores[4] > scores[11]


def test_options_are_checked():
    for bad in (predict.Options(min_length=10), predict.Options(min_ratio=2), predict.Options(table=9)):
        with pytest.raises(ValueError):
            bad.check()


def test_labelling(spark, genome):
    assert models.class_weight(0, 5) == 1.0 and models.class_weight(1, 100) < 1
    table, _ = genome
    rows = predict.with_vectors(predict.orfs.with_sequence(predict.orfs.find_orfs(table, min_length=300), table))
    labelled = predict.kmeans_labels(rows)
    assert labelled.where("positive").count() > 0
    again = predict.kmeans_labels(rows.repartition(7))  # the rows alone decide
    assert sorted(labelled.select(*predict.ID, "cluster").collect()) == sorted(again.select(*predict.ID, "cluster").collect())
    assert predict.kmeans_labels(rows.limit(0)).count() == 0 and predict.kmeans_labels(rows.limit(2)).select("cluster").distinct().count() == 2
    got = predict.principal_components(rows).select("z", "pc").collect()
    z = np.array([r.z for r in got])
    _, _, axes = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    axes = [a * np.sign(a[np.abs(a).argmax()]) for a in axes[:2]]
    assert np.allclose(np.array([r.pc for r in got]), (z - z.mean(axis=0)) @ np.array(axes).T, atol=1e-8)


def test_command_line(spark, tmp_path, capsys):
    seq, _ = planted(3, 12)
    (tmp_path / "g.fa").write_text(f">g test\n{seq}\n")
    names = {k: str(tmp_path / k) for k in ("out", "faa", "fna", "pairs", "amino", "nucl")}
    args = ["-i", f"file://{tmp_path}/g.fa", "-o", names["out"], "-a", names["faa"], "-d", names["fna"], "-O", names["pairs"], "-A", names["amino"], "-D", names["nucl"], "-p", "meta", "-M", "1"]
    assert cli.main(args) == 0
    assert open(names["out"]).read().startswith("##gff-version 3") and open(names["faa"]).read().count(">") == open(names["fna"]).read().count(">") > 0
    assert cli.main(["-l", "5", "-i", "x"]) == 1
    assert cli.main([]) == 0 and "Ab initio" in capsys.readouterr().out


def test_a_loaded_classifier_needs_no_written_vectors(spark, monkeypatch):
    from strandloom.plans import catalog, predict

    names, cut = [], predict.cut
    monkeypatch.setattr(predict, "cut", lambda df, name="table": names.append(name) or cut(df, name))
    catalog.QUERIES["q70_single_predict_saved"](spark, "/root/testdata/sf0.001").collect()
    assert "scored" in names and "vectors" not in names


def test_loaded_models_need_no_shuffled_scaffolds_and_few_tables(spark, monkeypatch):
    from pathlib import Path

    from strandloom.operators import orfs
    from strandloom.plans import catalog

    short, attach = [], orfs.attach
    monkeypatch.setattr(orfs, "attach", lambda rows, scaffolds, *more: short.append(scaffolds.where(f"length <= {orfs.TILE}").count()) or attach(rows, scaffolds, *more))
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "strandloom"
    before = set(folder.glob("*"))
    assert catalog.QUERIES["q70_single_predict_saved"](spark, "/root/testdata/sf0.001").count() > 0
    left = sorted(p.name.rpartition("-")[0] for p in set(folder.glob("*")) - before)
    assert short and not any(short)
    assert left.count("scaffolds") == left.count("segments") == left.count("scored") == 1 and not {"frames", "orfs", "revised"} & set(left)


def test_circular_genomes_are_predicted(spark):
    seq, truth = planted(8, 12)
    turned = seq[2000:] + seq[:2000]
    table = spark.createDataFrame([(0, "c", turned)], "scaffold_id long, name string, sequence string")
    options = predict.Options(max_iter=1, circular=True)
    found = predict.predict(table, options).collect()
    inner = [(a - 2000, b - 2000, s) for a, b, s in truth if a > 2000]
    got = {(r.strand, r.stop if r.strand == "+" else r.start) for r in found}
    assert len(got & {(s, b if s == "+" else a) for a, b, s in inner}) >= 0.5 * len(inner)
