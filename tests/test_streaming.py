import os
import random

import pytest

from strandloom.plans import predict
from strandloom.sources import readers
from strandloom.streaming import incremental
from tests.test_orfs import dna

OPTIONS = predict.Options(mode="meta", revise_tis=False, threshold=0.0)
GENE = ("name", "strand", "start", "stop", "score")


def put(folder, name, seqs):
    """A file that appears whole."""
    (folder / f".{name}").write_text("".join(f">{n}\n{s}\n" for n, s in seqs.items()))
    os.rename(folder / f".{name}", folder / name)


@pytest.fixture()
def genome(tmp_path):
    rng, folder = random.Random(21), tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        put(folder, f"{i}.fa", {f"r{i}_{k}": dna(rng, 1500) for k in range(2)})
    return folder


def run(spark, tmp_path, folder, checkpoint, **more):
    incremental.annotate_files(spark, f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/{checkpoint}", OPTIONS, **more).awaitTermination()
    return sorted(map(tuple, incremental.annotated_genes(spark, f"file://{tmp_path}/out").select(*GENE[:4]).collect()))


def wanted(spark, folder):
    found = predict.predict(readers.read_sequences(spark, f"file://{folder}"), OPTIONS)
    return sorted(map(tuple, found.select(*GENE[:4]).collect()))


def test_files_are_annotated_once(spark, tmp_path, genome):
    target = f"file://{tmp_path}/out"
    assert incremental.annotated_genes(spark, target).count() == 0 and incremental.annotated_files(spark, target).count() == 0
    got = run(spark, tmp_path, genome, "a", max_files=2)
    assert got and {g[0] for g in got} == {f"r{i}_{k}" for i in range(3) for k in range(2)}
    assert incremental.annotated_files(spark, target).count() == 3
    assert run(spark, tmp_path, genome, "a", max_files=2) == got  # nothing is new
    put(genome, "3.fa", {"r3": dna(random.Random(5), 2000)})
    put(genome, "4.fa", {})  # an empty file, which is not listed
    put(genome, "5.fa", {"short": "ACGT"})  # one without genes
    more = run(spark, tmp_path, genome, "b", max_files=100)  # a checkpoint that knows of no batch: only the new files count
    assert [g for g in more if g[0] != "r3"] == got and len(more) > len(got)
    assert incremental.annotated_files(spark, target).count() == 5
    rows = incremental.annotated_genes(spark, target)
    assert rows.select("batch").distinct().count() == 3 and rows.columns == [c.split()[0] for c in incremental.GENES.split(", ")]
    assert more == wanted(spark, genome)


def test_batch_that_was_cut_off(spark, tmp_path, genome, monkeypatch):
    """A batch that fails after its genes are written, but before they appear, leaves nothing; it comes again, and then appears once."""
    whole = incremental.publish

    def half(tables, path):
        tables["genes"].write.parquet(f"{path.rpartition('/')[0]}/_half")
        raise OSError("cut off")

    monkeypatch.setattr(incremental, "publish", half)
    with pytest.raises(Exception, match="cut off"):
        run(spark, tmp_path, genome, "a")
    assert incremental.annotated_genes(spark, f"file://{tmp_path}/out").count() == 0
    monkeypatch.setattr(incremental, "publish", whole)
    assert run(spark, tmp_path, genome, "a") == wanted(spark, genome)

    def late(tables, path):
        whole(tables, path)
        raise OSError("cut off")

    put(genome, "9.fa", {"r9": dna(random.Random(6), 2000)})
    monkeypatch.setattr(incremental, "publish", late)  # the batch appears, but the stream doesn't learn of it
    with pytest.raises(Exception, match="cut off"):
        run(spark, tmp_path, genome, "a")
    monkeypatch.setattr(incremental, "publish", whole)
    assert run(spark, tmp_path, genome, "a") == wanted(spark, genome)
    assert incremental.annotated_files(spark, f"file://{tmp_path}/out").count() == 4
