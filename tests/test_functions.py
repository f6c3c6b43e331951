import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import codes, zcurve
from strandloom.functions import sequence as S
from tests.simulate import revcomp


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("x")).first().x


def test_complement(spark):
    assert one(spark, "ACGTacgtNRYKM", S.reverse_complement(F.col("s"))) == "KMRYNacgtACGT"
    assert one(spark, "SWs", S.reverse_complement(F.col("s"))) == "sWS"
    assert one(spark, "SWs", S.reverse_complement(F.col("s"), compat=True)) == "wSW"
    rng = random.Random(1)
    s = "".join(rng.choice("ACGT") for _ in range(200))
    assert one(spark, s, S.reverse_complement(F.col("s"))) == revcomp(s)


def test_gc(spark):
    assert one(spark, "GgCcATN", S.gc_count(F.col("s"))) == 4
    assert one(spark, "", S.gc_fraction(F.col("s"))) is None


def test_codons_and_kmers(spark):
    assert one(spark, "ATGGCCTA", S.codons(F.col("s"), 1)) == ["TGG", "CCT"]
    assert one(spark, "TCAG", S.kmer_code(F.col("s"))) == 0 * 64 + 1 * 16 + 2 * 4 + 3
    assert one(spark, "TN", S.kmer_code(F.col("s"))) == -1
    assert one(spark, "GTG", S.match_codon(F.col("s"), codes.START_CODONS)) == 1
    assert one(spark, "CCC", S.match_codon(F.col("s"), codes.START_CODONS)) == -1


def test_translation(spark):
    gene = "GTGGCCTGATAA"
    assert one(spark, gene, S.translate_gene(F.col("s"), 11)) == "MA**"
    assert one(spark, gene, S.translate_gene(F.col("s"), 4)) == "MAW*"
    assert one(spark, gene, S.translate_gene(F.col("s"), 11, F.lit(True))) == "VA**"
    assert one(spark, "ATGNCC", S.translate_gene(F.col("s"), 11)) is None
    with pytest.raises(ValueError):
        codes.amino_acids(7)


def test_wrap(spark):
    assert one(spark, "A" * 170, S.wrap(F.col("s"))) == "A" * 80 + "\n" + "A" * 80 + "\n" + "A" * 10 + "\n"


def plain_zcurve(seq, orders):
    out = []
    for order in range(orders):
        block = np.zeros((3, 4**order, 3))
        for i in range(len(seq) - order):
            weights = np.ones(1)
            for k in range(order):
                weights = np.outer(weights, [codes.one_hot(seq[i + k])[b] for b in "AGCT"]).ravel()
            block[i % 3] += np.outer(weights, codes.z_coordinates(seq[i + order]))
        out.append(block.ravel())
    return np.concatenate(out) * 3 / len(seq)


@pytest.mark.parametrize("orders", [1, 2, 3, 4])
def test_zcurve_equals_a_walk(orders):
    rng = random.Random(orders)
    for n in (1, 2, 3, 50):
        seq = "".join(rng.choice("ACGTACGTNRYKMSWBDHVU") for _ in range(n))
        assert np.allclose(zcurve.encode(seq, orders), plain_zcurve(seq, orders))
    assert len(zcurve.encode("", orders)) == sum(zcurve.SIZES[:orders])


def test_zcurve_in_expressions(spark):
    seq = "ATGGCCTGATAACCGT"
    rows = spark.createDataFrame([(1, seq)], "k long, seq string")
    r = zcurve.mono_sums(rows, ["k"]).first()
    assert np.allclose([r[f"z{a}{p}"] for p in range(3) for a in "xyz"], zcurve.encode(seq, 1) * len(seq) / 3)
    two = {(x.frame, x.context): (x.zx, x.zy, x.zz) for x in zcurve.context_sums(rows, ["k"], 2).collect()}
    block = (zcurve.encode(seq, 3)[45:] * len(seq) / 3).reshape(3, 4, 4, 3)
    for p in range(3):
        for a in "AGCT":
            for b in "AGCT":
                assert np.allclose(two.get((p, a + b), (0, 0, 0)), block[p]["AGCT".index(a)]["AGCT".index(b)])


def test_vectors_of_many_sequences(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 1, 2, 3, 4, 7, 50, 300) for letters in ("ACGT", "acgtU", "ACGTN")] + [None]
    for orders in (1, 2, 3, 4):
        assert np.allclose(zcurve.encode_many(seqs, orders), [zcurve.encode(s or "", orders) for s in seqs])
    for compat in (False, True):
        rows = spark.createDataFrame([(i, s) for i, s in enumerate([*seqs[:-1], "ACYYRNS"])], "i int, seq string")
        for r in rows.withColumn("z", zcurve.zcurve(1, compat)("seq")).collect():
            assert np.allclose(r.z, zcurve.encode(r.seq, 1, compat))


def test_compat_z_of_y():
    assert codes.z_coordinates("Y") == (-1.0, 0.0, 0.0) and codes.z_coordinates("Y", compat=True) == (1.0, 0.0, 0.0)


def test_context_totals_are_added_up_in_the_tasks(spark):
    from strandloom.functions import zcurve

    seqs = ["ACGTTGCAAGT" * 7, "GATTACA", "AC", "", "ACGTACGTAACCGGTT" * 90]
    rows = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(2)
    for order in (2, 3):
        first = sum(zcurve.SIZES[:order])
        plain = sum((zcurve.encode(s, order + 1)[first:] * len(s) / 3).round() for s in seqs).reshape(-1, 3)
        names = ["".join(c) for c in __import__("itertools").product("AGCT", repeat=order)]
        got = {(r.frame, r.context): (r.zx, r.zy, r.zz) for r in zcurve.context_totals(rows, order).collect()}
        assert got == {(f, c): tuple(plain[f * len(names) + k]) for f in range(3) for k, c in enumerate(names)}
        assert zcurve.context_parts(rows, order).count() <= 2 * 3 * 4**order


def test_contexts_are_counted_without_a_row_for_each_base(spark, monkeypatch):
    monkeypatch.setattr(zcurve, "CONTEXT_BASES", 20)
    texts = ["ACGTNACGGT", "AC", "A", "", "GGGGGGGGG", "TTACGGANCCATT"] * 3
    found = zcurve.context_sums(spark.createDataFrame(list(enumerate(texts)), "k long, seq string"), ["k"], 1)
    want = {}
    for k, s in enumerate(texts):
        for i in range(len(s) - 1):
            one = [0 if s[i + 1] not in "ACGT" else 1 if s[i + 1] in axis else -1 for axis in ("AG", "AC", "AT")]
            cell = k, len(s), i % 3, s[i]
            want[cell] = tuple(a + b for a, b in zip(want.get(cell, (0, 0, 0)), one))
    assert {tuple(r[:4]): tuple(r[4:]) for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
