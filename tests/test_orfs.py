import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import codes
from strandloom.operators import frames as scan
from strandloom.operators import orfs
from tests.simulate import frames, revcomp


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def scaffolds(spark, seqs):
    return spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "scaffold_id long, name string, sequence string")


@pytest.mark.parametrize("circular", [False, True])
@pytest.mark.parametrize("minlen", [12, 30, 60])
def test_frames_equal_a_walk(spark, circular, minlen):
    rng = random.Random(minlen + circular)
    seqs = [dna(rng, rng.randint(20, 400)) for _ in range(300)] + ["", "AC", "ATG", "TAA"]
    got = orfs.find_orfs(scaffolds(spark, seqs), min_length=minlen, circular=circular).select("scaffold_id", "strand", "t_start", "end", "len", "partial5", "partial3").collect()
    want = [(i, strand, *x) for i, s in enumerate(seqs) for strand, side in (("+", s), ("-", revcomp(s))) for x in frames(side, minlen, circular)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_tiles_change_nothing(spark):
    rng = random.Random(5)
    table = scaffolds(spark, [dna(rng, 5000), dna(rng, 61), dna(rng, 60)])
    whole = orfs.codon_events(orfs.strands(table)).collect()
    tiled = orfs.codon_events(orfs.strands(table), tile=60).collect()
    assert sorted(whole) == sorted(tiled)
    found = orfs.find_orfs(table, min_length=60, circular=True, with_starts=True)
    a = orfs.with_sequence(found, table).select("scaffold_id", "strand", "t_start", "end", "seq").collect()
    b = orfs.with_sequence(found, table, tile=90).select("scaffold_id", "strand", "t_start", "end", "seq").collect()
    assert sorted(a) == sorted(b)
    c = orfs.with_context(found, table).select("scaffold_id", "strand", "end", "ctx_off", "ctx").collect()
    d = orfs.with_context(found, table, tile=90).select("scaffold_id", "strand", "end", "ctx_off", "ctx").collect()
    assert sorted(c) == sorted(d)


@pytest.mark.parametrize("circular", [False, True])
@pytest.mark.parametrize("tile", [6, 30, 90])
def test_frames_joined_across_tiles_equal_a_walk(spark, circular, tile):
    rng = random.Random(tile)
    rare = lambda n: "".join(rng.choice("ACGCGGCCATG") for _ in range(n))  # noqa: E731  few stops: runs over many tiles
    seqs = [dna(rng, rng.randint(50, 700)) for _ in range(60)] + [rare(rng.randint(50, 900)) for _ in range(60)] + ["GCC" * 100 + "ATG" + "GCC" * 200, "ATG" + "GCC" * 150, "", "A", "ATGTAA", "N" * 200 + dna(rng, 300) + "é" * 50 + dna(rng, 300)]
    got = orfs.find_orfs(scaffolds(spark, seqs), min_length=30, circular=circular, tile=tile).select("scaffold_id", "strand", "t_start", "end", "len", "partial5", "partial3").collect()
    want = [(i, strand, *x) for i, s in enumerate(seqs) for strand, side in (("+", s), ("-", revcomp(s))) for x in frames(side, 30, circular)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_starts_joined_across_tiles(spark):
    rng = random.Random(77)
    table = scaffolds(spark, [dna(rng, 2000) for _ in range(5)] + ["ATGGCCGTG" * 200])
    whole = orfs.find_orfs(table, min_length=60, with_starts=True)
    assert whole.where("size(starts) > 100").count() > 0
    for tile in (30, 300):
        assert sorted(orfs.find_orfs(table, min_length=60, with_starts=True, tile=tile).collect()) == sorted(whole.collect())
    for r in whole.collect():
        assert r.starts == sorted(r.starts) and len(r.starts) == len(r.types) and (r.partial5 or r.starts[0] <= r.t_start)


def test_no_task_scans_more_than_edges(spark):
    """Along a chromosome, two segments for each tile, phase and strand at most; all others are grouped by tile."""
    rng = random.Random(78)
    table = scaffolds(spark, [dna(rng, 30_000)])
    wanted = {11: (codes.starts(11), codes.stops(11))}
    found = scan.scanned(orfs.tiles(orfs.strands(table), 300), wanted, 300, 60, False)
    edges = found.where("edge").groupBy("strand", "phase").count().collect()
    assert len(edges) == 6 and all(r["count"] <= 2 * 100 for r in edges)
    assert max(r["count"] for r in found.where("not edge").groupBy("strand", "phase", "tile").count().collect()) <= 300 / 60
    events = orfs.codon_events(orfs.strands(table)).count()
    assert found.count() < events / 2


def test_several_codes_in_one_scan(spark):
    rng = random.Random(79)
    table = scaffolds(spark, [dna(rng, rng.randint(100, 900)) for _ in range(40)])
    wanted = {t: (("ATG",), codes.stops(t)) for t in (11, 4, 16)}
    found = orfs.find_orfs_by_code(table, wanted, 75, tile=120)
    for t, (starts, stops) in wanted.items():
        alone = orfs.find_orfs(table, t, 75, starts=starts, stops=stops)
        assert sorted(found.where(F.col("code") == t).drop("code").collect()) == sorted(alone.collect())


def test_invariants(spark):
    rng = random.Random(8)
    table = scaffolds(spark, [dna(rng, 3000) for _ in range(10)])
    for r in orfs.with_sequence(orfs.find_orfs(table, with_starts=True), table).collect():
        assert len(r.seq) == r.len and r.len % 3 == 0
        codons = [r.seq[i : i + 3] for i in range(0, r.len, 3)]
        assert not set(codons[:-1]) & set(codes.stops(11))
        if not r.partial3:
            assert codons[-1] in codes.stops(11)
        if not r.partial5:
            assert codons[0] in codes.starts(11) and r.t_start in r.starts


def test_lower_case_null_and_ambiguous(spark):
    rng = random.Random(2)
    s = dna(rng, 900)
    lower = orfs.find_orfs(scaffolds(spark, [s.lower(), None, "N" * 500])).drop("scaffold_id").collect()
    assert sorted(lower) == sorted(orfs.find_orfs(scaffolds(spark, [s])).drop("scaffold_id").collect())


@pytest.mark.parametrize("table", sorted(codes.REASSIGNED))
def test_genetic_codes(spark, table):
    stops = codes.stops(table)
    assert set(stops) == {"TAA", "TAG", "TGA"} - set(codes.REASSIGNED[table])
    body = "ATG" + "GCC" * 40
    found = orfs.find_orfs(scaffolds(spark, [body + "TGA" + "GCC" * 20 + "TAA"]), table=table).where("strand = '+' and phase = 0 and not partial5 and not partial3").collect()
    assert [r.end for r in found] == [126 if "TGA" in stops else 189]


def test_long_scaffold_is_split_for_the_codons(spark):
    plan = orfs.codon_events(orfs.strands(scaffolds(spark, ["ACGT" * 100])))._jdf.queryExecution().toString()
    assert "Python" not in plan and F is not None


def test_equal_rows_and_empty_spans_keep_their_number(spark):
    rng = random.Random(21)
    table = scaffolds(spark, [dna(rng, 900), dna(rng, 100)])
    rows = spark.createDataFrame([(0, "+", 10, 300, 290, 900)] * 2 + [(0, "+", 40, 40, 0, 900), (1, "-", 0, 60, 60, 100)] * 2, "scaffold_id long, strand string, t_start int, end int, len int, host_len int")
    for tile in (30, 300, 30_000):
        got = [(r.t_start, r.len, len(r.seq)) for r in orfs.with_sequence(rows, table, tile).collect()]
        assert sorted(got) == sorted([(10, 290, 290)] * 2 + [(40, 0, 0)] * 2 + [(0, 60, 60)] * 2)


def test_only_segments_at_tile_edges_are_joined(spark, monkeypatch):
    from strandloom.operators import frames, orfs

    seen, joined = [], frames.joined
    monkeypatch.setattr(frames, "joined", lambda found, *more: seen.append(found.count()) or joined(found, *more))
    scaffolds = spark.createDataFrame([(i, "ATG" + "GCC" * 60 + "TAA" + "C" * i) for i in range(5)], "scaffold_id long, sequence string")
    whole = orfs.find_orfs(scaffolds).collect()
    cut_up = orfs.find_orfs(scaffolds, tile=30).collect()
    assert len(whole) >= 5 and set(whole) == set(cut_up)
    assert seen[0] == 0 < seen[1]


def test_codon_events_are_not_shuffled(spark):
    table = scaffolds(spark, ["ATGTAA" * 30, "NNATGNTAA", "AT", "", None])
    found = orfs.codon_events(orfs.strands(table), tile=30)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.scaffold_id, r.strand, r.pos, r.codon, r.phase) for r in found.collect()}
    plain = lambda s: {(p, s[p : p + 3]) for p in range(len(s) - 2) if s[p : p + 3] in (*codes.starts(11), *codes.stops(11))}
    sides = {(0, "+"): "ATGTAA" * 30, (0, "-"): revcomp("ATGTAA" * 30), (1, "+"): "NNATGNTAA", (1, "-"): revcomp("NNATGNTAA")}
    assert got == {(*side, p, c, p % 3) for side, s in sides.items() for p, c in plain(s)}


def test_whole_strands_are_scanned_like_their_tiles(spark):
    rng = random.Random(91)
    table = scaffolds(spark, [dna(rng, rng.randint(0, 2000)) for _ in range(20)] + ["", "a" * 10, dna(rng, 250).lower(), None, "N" * 40 + "é" + dna(rng, 700)])
    wanted = {t: (codes.starts(t), codes.stops(t)) for t in (11, 4)}
    for tile in (30, 300, 30_000):
        by_tile = scan.scanned(orfs.tiles(orfs.strands(table), tile), wanted, tile, 60, True).collect()
        assert by_tile and sorted(scan.scanned(orfs.forward(table), wanted, tile, 60, True).collect()) == sorted(by_tile)


def test_bases_behind_a_letter_of_two_bytes(spark):
    side = "ACG" * 5 + "é" + "ATGGCCTTT" * 4
    rows = spark.createDataFrame([(0, "+", 16, 52, 36, 52), (0, "-", 0, 36, 36, 52), (0, "-", 30, 52, 22, 52)], "scaffold_id long, strand string, t_start int, end int, len int, host_len int")
    got = {(r.strand, r.t_start): r.seq for r in orfs.with_sequence(rows, scaffolds(spark, [side])).collect()}
    back = revcomp(side.replace("é", "N"))
    assert got == {("+", 16): side[16:], ("-", 0): back[:36], ("-", 30): back[30:]}


def test_contexts_of_the_scan_equal_joined_ones(spark):
    rng = random.Random(17)
    sides = [dna(rng, rng.randint(0, 1500)) for _ in range(25)] + [dna(rng, 400).lower(), "", None, dna(rng, 200) + "RYKMSWBDHVNUX" + dna(rng, 500), "ATG" + "GCC" * 200 + "TAA"]
    shown = ["scaffold_id", "strand", "phase", "host_len", "t_start", "end", "len", "partial5", "partial3", "starts", "types", "ctx_off", "ctx", "gc"]
    for tile, extra in ((90, []), (300, []), (30_000, [dna(rng, 90) + "é" + dna(rng, 600)])):
        table = scaffolds(spark, sides + extra)
        for reach, above in (((200, 15), 0), ((0, 0), 0), ((20, 9), 150)):
            plain = orfs.with_context(orfs.find_orfs(table, min_length=60, with_starts=True, tile=tile).where(f"len > {above}"), table, *reach, tile)
            plain = plain.withColumn("gc", F.expr("length(regexp_replace(substring(ctx, t_start - ctx_off + 1, len), '[^GC]', '')) / len"))
            parts = []
            got = orfs.find_orfs_with_context(table, 11, 60, *reach, above, tile=tile, parts=parts)
            assert len(parts) == 2 and plain.count() > 20
            assert sorted(got.select(shown).collect()) == sorted(plain.select(shown).collect())
