import gzip
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import genes, orfs
from strandloom.plans import predict
from strandloom.sources import formats, ranges, readers, writers
from strandloom.streaming import incremental
from tests.test_orfs import dna, scaffolds

FASTA = ">one first record\r\nACGTACGT\r\nAC*\r\n>two\nacgt\n\nTT\n>three\n>four x\nGG"
GENBANK = "LOCUS       AB1 12 bp DNA\nFEATURES  x\nORIGIN\n        1 acgtac gtacgt\n//\nLOCUS       EMPTY 0 bp\nORIGIN\n//\n"
EMBL = "ID   X1; SV 1; linear\nFT   CDS\nSQ   Sequence 8 BP;\n     acgtacgt 8\n//\n"
WANT = {"fasta": [("one", "ACGTACGTAC*"), ("two", "acgtTT"), ("three", ""), ("four", "GG")], "genbank": [("AB1", "ACGTACGTACGT")], "embl": [("X1;", "ACGTACGT")]}


@pytest.mark.parametrize("kind, text, reader", [("fasta", FASTA, readers.read_fasta), ("genbank", GENBANK, readers.read_genbank), ("embl", EMBL, readers.read_embl)])
def test_formats(spark, tmp_path, kind, text, reader):
    assert formats.sniff("\n\n" + text) == kind
    plain, packed, bare = tmp_path / "x.txt", tmp_path / "x.txt.gz", tmp_path / "packed"
    plain.write_bytes(text.encode())
    packed.write_bytes(gzip.compress(text.encode()))
    bare.write_bytes(gzip.compress(text.encode()))
    for path in (plain, packed):
        assert [(r.name, r.sequence) for r in reader(spark, f"file://{path}").orderBy("scaffold_id").collect()] == WANT[kind]
    for path in (plain, packed, bare):
        assert [(r.name, r.sequence) for r in readers.read_sequences(spark, f"file://{path}").orderBy("scaffold_id").collect()] == WANT[kind]


def test_unknown_format():
    with pytest.raises(ValueError):
        formats.sniff("hello")
    with pytest.raises(ValueError):
        formats.sniff(" \n")


def gene_table(spark, n=3, seed=3):
    rng = random.Random(seed)
    table = scaffolds(spark, [dna(rng, 2500) for _ in range(n)])
    found = orfs.find_orfs(table).join(table.select("scaffold_id", "name"), "scaffold_id").selectExpr("*", "len / 1000.0 as score")
    return table, genes.with_coordinates(found)


def test_gff_round_trip(spark, tmp_path):
    _, found = gene_table(spark)
    path = str(tmp_path / "out.gff")
    n = writers.write_file(writers.gene_lines(found, "gff", date="01-JAN-2024"), path, writers.heads("gff"))
    lines = open(path).read().splitlines()
    assert lines[:2] == ["##gff-version 3 ", "# Translation Table: 11"]
    rows = [x.split("\t") for x in lines if not x.startswith("#")]
    want = {(r.name, str(r.start), str(r.stop), r.strand) for r in found.collect()}
    assert n == len(rows) == found.count() and {(r[0], r[3], r[4], r[6]) for r in rows} == want
    assert [r[8][:11] for r in rows] == [f"ID=orf{i:06d}"[:11] for i in range(1, n + 1)]
    assert [x for x in lines if x.startswith("# s")] == [f"# s{i}\t2500 bp\tlinear\tUNA\t01-JAN-2024" for i in range(3)]


def test_other_formats(spark, tmp_path):
    table, found = gene_table(spark)
    path = str(tmp_path / "out")
    writers.write_file(writers.gene_lines(found, "gbk", date="01-JAN-2024"), path, writers.heads("gbk"), "gbk")
    text = open(path).read()
    assert text.count("LOCUS") == text.count("ORIGIN\n//\n") == 3 and text.startswith("LOCUS       s0 " + "2500".rjust(25) + " bp    DNA       linear UNA 01-JAN-2024\n")
    writers.write_file(writers.gene_lines(found, "med"), path, writers.heads("med"), "med")
    assert open(path).read().startswith("## MED\n# Translation Table: 11\n# s0\t2500 bp")
    writers.write_file(writers.fasta_lines(found, table, protein=False), path)
    records = readers.read_fasta(spark, f"file://{path}").collect()
    assert sorted(len(r.sequence) for r in records) == sorted(r.len for r in found.collect())
    writers.write_text(writers.gene_lines(found, "med"), f"file://{tmp_path}/parts")
    assert spark.read.text(f"file://{tmp_path}/parts").count() == found.count() + 3
    with pytest.raises(ValueError):
        writers.gene_lines(found, "bed")


@pytest.mark.parametrize("form", writers.FORMATS)
def test_folders_hold_what_files_do(spark, tmp_path, form):
    _, found = gene_table(spark)
    lines = writers.gene_lines(found, form, date="01-JAN-2024")
    counts = {writers.write(lines, path, writers.heads(form), form) for path in (f"{tmp_path}/one", f"file://{tmp_path}/parts/")}
    parts = sorted(p for p in os.listdir(tmp_path / "parts") if p.startswith("part-"))
    assert counts == {lines.count()} and "".join(open(tmp_path / "parts" / p).read() for p in parts) == open(tmp_path / "one").read()
    assert writers.write(lines.limit(0), f"file://{tmp_path}/none/", writers.heads(form), form) == 0
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/none").collect()] == writers.heads(form)


def test_overprint_sink(spark, tmp_path):
    _, found = gene_table(spark, 4)
    pairs = genes.overprint_pairs(found, 30, 0.1)
    path = str(tmp_path / "pairs.gff")
    n = writers.write_file(genes.overprint_lines(pairs), path, ["##gff-version 3"])
    lines = open(path).read().splitlines()
    assert n == pairs.count() > 0 and len(lines) == 1 + 3 * n and lines[1].startswith("# index=0001;type=IN")
    assert genes.genes_of_pairs(pairs, found).count() == 2 * n


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(12)
    folder = tmp_path / "in"
    folder.mkdir()
    seqs = [dna(rng, 3000) for _ in range(4)]
    for i in range(2):
        (folder / f"{i}.fa").write_text("".join(f">r{k}\n{seqs[k]}\n" for k in (2 * i, 2 * i + 1)))
    got = []
    options = predict.Options(mode="meta", revise_tis=False, threshold=0.0)
    incremental.annotate_stream(incremental.fasta_stream(spark, f"file://{folder}", maxFilesPerTrigger="1"), lambda df, n: got.extend(df.select("name", "strand", "start", "stop").collect()), f"file://{tmp_path}/ck", options).awaitTermination()
    table = spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(seqs)], "scaffold_id long, name string, sequence string")
    frames = genes.with_coordinates(orfs.find_orfs(table).withColumnRenamed("scaffold_id", "i")).selectExpr("concat('r', i) as name", "strand", "start", "stop").collect()
    assert set(map(tuple, got)) <= set(map(tuple, frames)) and len(got) > 0.9 * len(frames)


def test_ids_are_of_the_data(spark, tmp_path):
    """Many files in many partitions: the ids are the same whatever columns a plan reads, and every gene keeps its scaffold's name."""
    rng, want = random.Random(8), {}
    for i in range(12):
        names = [f"f{i}r{k}" for k in range(5)]
        want |= {n: dna(rng, 4000) for n in names}
        text = "".join(f">{n}\n{want[n]}\n" for n in names)
        if i % 3 == 0:
            (tmp_path / f"{i}.fa.gz").write_bytes(gzip.compress(text.encode()))
        elif i % 3 == 1:
            (tmp_path / f"{i}.packed").write_bytes(gzip.compress(text.encode()))
        else:
            (tmp_path / f"{i}.fa").write_text(text)
    (tmp_path / "empty.fa").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        table = readers.read_sequences(spark, f"file://{tmp_path}/*")
        whole = {r.scaffold_id: (r.name, r.sequence) for r in table.collect()}
        assert {n: s for n, s in whole.values()} == want and len(whole) == len(want)
        assert {r.scaffold_id: r.name for r in table.select("scaffold_id", "name").collect()} == {k: v[0] for k, v in whole.items()}
        plain = readers.read_fasta(spark, f"file://{tmp_path}/*.fa")
        assert plain.join(plain.select("scaffold_id", F.col("name").alias("n")), "scaffold_id").where("name = n").count() == plain.count() == 20
        found = predict.predict(table, predict.Options(mode="meta", revise_tis=False, threshold=0.0)).select("name", "strand", "start", "stop").collect()
        assert {r.name for r in found} == set(want)
        for r in found[:50]:
            piece = want[r.name][r.start - 1 : r.stop]
            assert len(piece) % 3 == 0 or r.stop == 4000 or r.start == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_standard_input(spark, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(FASTA.encode())))
    assert [(r.name, r.sequence) for r in readers.read_sequences(spark, "-").orderBy("scaffold_id").collect()] == WANT["fasta"]


def test_no_content(spark, tmp_path):
    (tmp_path / "x.fa").write_text("")
    with pytest.raises(ValueError):
        readers.read_sequences(spark, f"file://{tmp_path}/x.fa")


def test_streams_are_cut_at_marks():
    for size in (1, 3, 7, 1 << 20):
        before, ranges.BLOCK = ranges.BLOCK, size
        try:
            for kind, text in (("fasta", FASTA), ("genbank", GENBANK), ("embl", EMBL)):
                assert [found for _, found in formats.records(io.BytesIO(text.encode()), kind)] == WANT[kind]
        finally:
            ranges.BLOCK = before
