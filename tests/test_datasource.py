"""Byte ranges, block gzip and the data sources, against whole reads."""

import gzip
import io
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandloom.sources import datasource, formats, ranges, readers
from tests.test_sources import EMBL, FASTA, GENBANK, WANT


def fasta_of(rng, n, longest=400):
    rows = [(f"r{i}", "".join(rng.choice("ACGTacgtN") for _ in range(rng.randint(0, longest)))) for i in range(n)]
    return rows, "".join(formats.render("fasta", {"name": f"{k} described > so", "sequence": s}) for k, s in rows).encode()


def in_ranges(content, kind, size):
    out, places = [], set()
    for begin in range(0, len(content), size):
        for i, found in formats.records(io.BytesIO(content), kind, begin, begin + size):
            out.append(found)
            places.add((begin, i))
    assert len(places) == len(out)
    return out


def members(content, sizes, rng):
    """Gzip members of uneven content."""
    out, at = b"", 0
    while at < len(content):
        n = rng.choice(sizes)
        out += gzip.compress(content[at : at + n], compresslevel=rng.choice((0, 1, 9)))
        at += n
    return out


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_each_record_is_read_by_one_range(monkeypatch, block):
    monkeypatch.setattr(ranges, "BLOCK", block)
    rng = random.Random(1)
    for kind, text in (("fasta", FASTA), ("genbank", GENBANK * 3), ("embl", EMBL * 3)):
        whole = [found for _, found in formats.records(io.BytesIO(text.encode()), kind)]
        assert whole == WANT[kind] * (1 if kind == "fasta" else 3)
        for size in (1, 2, 3, 5, 17, 1000):
            assert in_ranges(text.encode(), kind, size) == whole
    rows, content = fasta_of(rng, 40)
    for size in (13, 100, 1 << 20):
        assert in_ranges(content, "fasta", size) == rows
    packed = members(content, (1, 2, 30, 500), rng)
    for size in (11, 90, 1 << 20):
        assert in_ranges(packed, "fasta", size) == rows


def test_members_are_told_from_look_alikes():
    rng = random.Random(2)
    rows, content = fasta_of(rng, 60)
    one = gzip.compress(b">a\n" + content)
    assert [found for _, found in formats.records(io.BytesIO(one), "fasta")][1:] == rows and len(in_ranges(one, "fasta", 100)) == len(rows) + 1
    # the magic, and a header that is right, in stored content and between members
    fake = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03" + bytes(rng.randrange(256) for _ in range(40))
    tricky = gzip.compress(b">x\nAC\n", 0) + gzip.compress(fake + b"\n>y\nGT\n" + fake, 0) + b"\0" * 50 + gzip.compress(b"\n>z\nTT\n")
    want = [found for _, found in formats.records(io.BytesIO(tricky), "fasta")]
    assert [n for n, _ in want] == ["x", "y", "z"]
    for size in (1, 8, 64):
        assert in_ranges(tricky, "fasta", size) == want
    with pytest.raises(EOFError):
        list(formats.records(io.BytesIO(one[:-20]), "fasta"))
    with pytest.raises(zlib.error):
        list(formats.records(io.BytesIO(one + b"junk after"), "fasta"))


def test_block_gzip_is_gzip():
    rng = random.Random(3)
    content = rng.randbytes(200_000) + b"A" * 300_000
    out = io.BytesIO()
    out.close, closed = lambda: None, out.getvalue
    writer = ranges.BlockGzip(out)
    for i in range(0, len(content), 7_777):
        writer.write(content[i : i + 7_777])
    writer.close()
    packed = closed()
    assert gzip.decompress(packed) == content
    at = n = 0
    while at < len(packed):  # the sizes in the headers lead from member to member
        assert packed[at : at + 3] == ranges.MAGIC and packed[at + 12 : at + 14] == b"BC"
        at += int.from_bytes(packed[at + 16 : at + 18], "little") + 1
        n += 1
    assert at == len(packed) and n == -(-len(content) // ranges.MEMBER) + 1


def test_fifty_members_in_eight_tasks_equal_the_plain_file(spark, tmp_path):
    rng = random.Random(4)
    rows, content = fasta_of(rng, 900, 3000)
    step = len(content) // 50 + 1
    packed = b"".join(gzip.compress(content[i : i + step]) for i in range(0, len(content), step))
    (tmp_path / "plain.fa").write_bytes(content)
    (tmp_path / "packed.fa.gz").write_bytes(packed)
    datasource.register(spark)
    load = lambda path, size: spark.read.format("fasta").option("rangeBytes", size).load(f"file://{tmp_path}/{path}")
    got = load("packed.fa.gz", -(-len(packed) // 8))
    assert got.rdd.getNumPartitions() == 8 and len({r.p for r in got.select(F.spark_partition_id().alias("p")).collect()}) == 8
    by_id = [(r.name, r.sequence, r.length) for r in got.orderBy("scaffold_id").collect()]
    assert by_id == [(n, s, len(s)) for n, s in rows] == [(r.name, r.sequence, r.length) for r in load("plain.fa", 50_000).orderBy("scaffold_id").collect()]
    for path, size in (("plain.fa", 50_000), ("packed.fa.gz", 40_000)):  # the same ids from any plan
        df = load(path, size)
        assert df.join(df.select("scaffold_id", F.col("name").alias("n")).repartition(3), "scaffold_id").where("name = n").count() == len(rows)


def test_filters_on_names_reach_the_parser(spark, tmp_path):
    rng = random.Random(5)
    rows, content = fasta_of(rng, 50)
    (tmp_path / "x.fa").write_bytes(content)
    table = readers.read_fasta(spark, f"file://{tmp_path}/x.fa")
    for condition, want in (("name = 'r7'", {"r7"}), ("name in ('r1', 'r44', 'zz')", {"r1", "r44"}), ("name like 'r4%' and length >= 0", {"r4"} | {f"r{i}" for i in range(40, 50)}), ("name = 'r1' and name = 'r2'", set())):
        some = table.where(condition)
        assert {r.name for r in some.collect()} == want and some.select("scaffold_id").intersect(table.select("scaffold_id")).count() == len(want)
    plan = table.where("name = 'r7'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" not in plan or "name" in plan
    reader = datasource._Reader("fasta", {"path": "x"})
    assert list(reader.pushFilters([datasource.EqualTo(("name",), "a"), datasource.EqualTo(("length",), 3)])) == [datasource.EqualTo(("length",), 3)]


@pytest.mark.parametrize("kind", ["fasta", "genbank", "embl"])
@pytest.mark.parametrize("packed", ["none", "gzip"])
def test_sinks_round_trip(spark, tmp_path, kind, packed):
    datasource.register(spark)
    rng = random.Random(6)
    rows = [(f"n{i}", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 500)))) for i in range(200)]
    table = spark.createDataFrame(rows, "name string, sequence string").repartitionByRange(5, "name")
    path = f"file://{tmp_path}/out"
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        table.write.format(kind).option("compression", packed).mode(mode).save(path)
        got = spark.read.format(kind).option("rangeBytes", 700).load(path)
        assert sorted((r.name, r.sequence) for r in got.collect()) == sorted(rows * times)
    names = sorted(os.listdir(tmp_path / "out"))
    assert names[0] == "_SUCCESS" and all(n.startswith("part-0000") for n in names[1:]) and (not packed == "gzip" or all(n.endswith(".gz") for n in names[1:]))
    assert {r.name for r in readers.read_sequences(spark, f"{path}/part-*").collect()} == {n for n, _ in rows}
    table.limit(0).write.format(kind).mode("overwrite").save(path)
    assert spark.read.format(kind).load(path).count() == 0


def test_gff3_round_trip(spark, tmp_path):
    datasource.register(spark)
    rows = [("s1", "here", "CDS", 5, 90, 0.5, "+", "0", "ID=a"), ("s2", "here", "CDS", 1, 30, None, "-", None, "ID=b;x=1")]
    spark.createDataFrame(rows, datasource._FEATURE).write.format("gff3").mode("append").save(f"file://{tmp_path}/g")
    (tmp_path / "g" / "more.gff3").write_text("##gff-version 3\n# note\ns3\t.\tgene\t1\t2\t.\t+\t.\tID=c\r\n\nbroken line\n")
    got = spark.read.format("gff3").load(f"file://{tmp_path}/g")
    assert sorted(map(tuple, got.collect())) == [*rows, ("s3", None, "gene", 1, 2, None, "+", None, "ID=c")]
    assert [r.start for r in got.where("seqid = 's2'").collect()] == [1]
    with pytest.raises(Exception, match="columns missing"):
        got.select("seqid").write.format("gff3").mode("append").save(f"file://{tmp_path}/h")


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    datasource.register(spark)
    good = spark.createDataFrame([("a", "ACGT")], "name string, sequence string")
    good.write.format("fasta").mode("append").save(f"file://{tmp_path}/out")
    before = sorted(os.listdir(tmp_path / "out"))
    bad = spark.range(0, 40, 1, 4).select(F.concat(F.lit("r"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise("ACGT").alias("sequence"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("fasta").mode("append").save(f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == before
    with pytest.raises(Exception, match="broken"):
        bad.write.format("fasta").mode("overwrite").save(f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == before  # what was there stays until the new files are whole


def test_streams_read_files_once_and_sinks_replace_batches(spark, tmp_path):
    datasource.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(7)
    want = {}

    def add(i):
        rows, content = fasta_of(rng, 30)
        want.update({f"f{i}{n}": s for n, s in rows})
        text = content.replace(b">r", f">f{i}r".encode())
        (folder / f".{i}").write_bytes(gzip.compress(text) if i % 2 else text)
        os.utime(folder / f".{i}", ns=(10**18 + i, 10**18 + i))
        (folder / f".{i}").rename(folder / f"{i}.fa")

    def run():
        rows = spark.readStream.format("fasta").option("maxFiles", 2).option("rangeBytes", 900).load(f"file://{folder}")
        sink = rows.writeStream.format("fasta").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck")
        sink.trigger(processingTime="0 seconds").start()
        q = spark.streams.active[-1]
        q.processAllAvailable()
        q.stop()

    def read():
        got = [(r.name, r.sequence) for r in spark.read.format("fasta").load(f"file://{tmp_path}/out").collect()]
        assert len(got) == len(want) and dict(got) == want

    for i in range(3):
        add(i)
    run()
    read()
    add(3)
    run()  # goes on from the checkpoint
    read()
    # the last batch comes again, as after a crash between the sink's commit and the stream's
    last = max(os.listdir(tmp_path / "ck" / "commits"), key=lambda n: int(n) if n.isdigit() else -1)
    for n in (last, f".{last}.crc"):
        if (tmp_path / "ck" / "commits" / n).exists():
            (tmp_path / "ck" / "commits" / n).unlink()
    run()
    read()


def test_memory_of_a_written_batch(tmp_path, monkeypatch):
    """A worker of a sink holds some rows of a batch as Python objects, not all."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"name": [f"n{i}" for i in range(10_000)], "sequence": ["ACGT" * 500] * 10_000})
    sink = datasource._Sink("genbank", {"path": str(tmp_path)})
    sink._create()
    tracemalloc.start()
    try:
        written = sink._write(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5e6  # the sequences have 20 MB
    with open(written.file) as f:
        assert sum(line.startswith("LOCUS") for line in f) == 10_000
