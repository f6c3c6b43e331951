"""The registered queries, each over whole tables, and their DuckDB SQL.

All are over scaffolds derived from ``documents``.  Integers are 64-bit on both sides and fractions are rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import codes, zcurve
from strandloom.functions import sequence as S
from strandloom.operators import gcbins, genes, kmeans, metrics, models, orfs, overlap, svm, tis
from strandloom.plans import bank, develop, predict
from strandloom.plans.bank import default_bank, save_bank
from strandloom.plans.oracle import query
from strandloom.session import cut, new_path
from strandloom.sources import datasource, readers, writers
from strandloom.sources.documents import load
from strandloom.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ("scaffold_id", "strand", "phase", "t_start", "end")
KEY_SQL = 'scaffold_id, strand, phase, t_start, "end"'


def longs(df: DataFrame) -> DataFrame:
    """Integers as 64-bit."""
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "tinyint", "smallint") else F.col(f"`{c}`") for c, t in df.dtypes])


def registered(sql: str | None = None):
    def add(function):
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: longs(function(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def linear(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return orfs.find_orfs(load(spark, sf_dir), **options)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaffolds written once, for queries that read them several times, as readers of files do."""
    return cut(load(spark, sf_dir), "scaffolds")


def sequenced(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    scaffolds = stored(spark, sf_dir)
    return orfs.with_sequence(cut(orfs.find_orfs(scaffolds, **options), "frames"), scaffolds)


def gene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of at least 300 bases with a score made of their length."""
    found = linear(spark, sf_dir).where("len >= 300").withColumn("score", F.col("len") / (F.col("len") + 300.0))
    return genes.with_coordinates(found).withColumn("name", F.concat(F.lit("doc_"), "scaffold_id"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes.with_ordinals(cut(gene_table(spark, sf_dir), "genes"))


@registered(query("SELECT scaffold_id, length(sequence) AS length, substr(sequence, 1, 60) AS prefix FROM scaffolds", "scaffolds"))
def q01_scaffold_scan(spark, sf_dir):
    return load(spark, sf_dir).select("scaffold_id", "length", F.substring("sequence", 1, 60).alias("prefix"))


@registered(query("SELECT scaffold_id, n AS gc_count, round(CASE WHEN l > 0 THEN n / l END, 6) AS gc FROM (SELECT scaffold_id, length(sequence) AS l, length(sequence) - length(translate(sequence, 'GC', '')) AS n FROM scaffolds)", "scaffolds"))
def q02_gc_fraction(spark, sf_dir):
    seq = F.col("sequence")
    return load(spark, sf_dir).select("scaffold_id", S.gc_count(seq).alias("gc_count"), F.round(S.gc_fraction(seq), 6).alias("gc"))


@registered(query("SELECT count(*) AS scaffolds, sum(length(sequence))::BIGINT AS size, round(sum(length(sequence) - length(translate(sequence, 'GC', ''))) / sum(length(sequence)), 6) AS gc FROM scaffolds", "scaffolds"))
def q03_genome_summary(spark, sf_dir):
    return predict.summary(load(spark, sf_dir))


@registered(query("SELECT scaffold_id, md5(seq) AS digest FROM strands WHERE strand = '-'", "strands"))
def q04_reverse_complement(spark, sf_dir):
    return load(spark, sf_dir).select("scaffold_id", F.md5(S.reverse_complement(F.col("sequence"))).alias("digest"))


@registered(query("SELECT phase, codon, count(*) AS n FROM codons WHERE strand = '+' GROUP BY ALL", "codons"))
def q05_codon_usage(spark, sf_dir):
    phased = load(spark, sf_dir).select("sequence", F.explode(F.array(*map(F.lit, range(3)))).alias("phase"))
    return phased.select("phase", F.explode(S.codons(F.col("sequence"), F.col("phase"))).alias("codon")).groupBy("phase", "codon").agg(F.count(F.lit(1)).alias("n"))


@registered(query("SELECT scaffold_id, strand, phase, pos, CASE WHEN is_start THEN 'start' ELSE 'stop' END AS kind FROM events", "events"))
def q06_codon_events(spark, sf_dir):
    found = orfs.codon_events(orfs.strands(load(spark, sf_dir)))
    return found.select("scaffold_id", "strand", "phase", "pos", F.when(F.col("is_start"), "start").otherwise("stop").alias("kind"))


@registered(query(f"SELECT {KEY_SQL}, len, partial3, partial5 FROM orfs", "orfs"))
def q07_orfs_linear(spark, sf_dir):
    return linear(spark, sf_dir).select(*KEY, "len", "partial3", "partial5")


@registered(query("""SELECT scaffold_id, strand, CASE WHEN strand = '+' THEN t_start + 1 ELSE host_len - "end" + 1 END AS start, CASE WHEN strand = '+' THEN "end" ELSE host_len - t_start END AS stop FROM orfs""", "orfs"))
def q08_orf_coordinates(spark, sf_dir):
    return genes.with_coordinates(linear(spark, sf_dir)).select("scaffold_id", "strand", "start", "stop")


@registered(query(f"SELECT {KEY_SQL}, len(coalesce(starts, [])) AS n_starts, array_to_string(coalesce(starts, []), ',') AS starts FROM orfs", "orfs"))
def q09_orf_starts(spark, sf_dir):
    return linear(spark, sf_dir, with_starts=True).select(*KEY, F.size("starts").alias("n_starts"), F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


def _z_sql(order: int) -> str:
    axes = ", ".join(f"sum(CASE WHEN b IN ({', '.join(repr(x) for x in names)}) THEN 1 ELSE -1 END)::BIGINT AS z{axis}" for axis, names in codes.Z_AXES.items())
    context = f"substr(seq, i + 1, {order})"
    return query(
        f"SELECT {KEY_SQL}, len, frame, context, {axes} FROM (SELECT *, i % 3 AS frame, {context} AS context, substr(seq, i + {order + 1}, 1) AS b FROM (SELECT *, unnest(range(0, length(seq) - {order})) AS i FROM orfseqs)) GROUP BY {KEY_SQL}, len, frame, context", "orfseqs"
    )


MONO_SQL = query(
    f"SELECT {KEY_SQL}, " + ", ".join(f"round(sum(CASE WHEN i % 3 = {p} THEN CASE WHEN b IN ({', '.join(repr(x) for x in names)}) THEN 1 ELSE -1 END ELSE 0 END) * 3.0 / length(any_value(seq)), 6) AS z{axis}{p}" for p in range(3) for axis, names in codes.Z_AXES.items())
    + f" FROM (SELECT *, substr(seq, i + 1, 1) AS b FROM (SELECT *, unnest(range(0, length(seq))) AS i FROM orfseqs)) GROUP BY {KEY_SQL}", "orfseqs",
)


@registered(MONO_SQL)
def q10_zcurve_mono(spark, sf_dir):
    rows = sequenced(spark, sf_dir).withColumn("z", zcurve.zcurve(1)(F.col("seq")))
    return rows.select(*KEY, *[F.round(F.col("z")[3 * p + k], 6).alias(f"z{axis}{p}") for p in range(3) for k, axis in enumerate("xyz")])


@registered(_z_sql(1))
def q11_zcurve_di(spark, sf_dir):
    return zcurve.context_sums(sequenced(spark, sf_dir), [*KEY], 1).select(*KEY, "len", "frame", "context", "zx", "zy", "zz")


@registered(query("SELECT frame, context, sum(zx)::BIGINT AS zx, sum(zy)::BIGINT AS zy, sum(zz)::BIGINT AS zz FROM zrows GROUP BY ALL", "orfseqs", more={"zrows": "SELECT i % 3 AS frame, substr(seq, i + 1, 2) AS context, " + ", ".join(f"CASE WHEN substr(seq, i + 3, 1) IN ({', '.join(repr(x) for x in names)}) THEN 1 ELSE -1 END AS z{axis}" for axis, names in codes.Z_AXES.items()) + " FROM (SELECT seq, unnest(range(0, length(seq) - 2)) AS i FROM orfseqs)"}))
def q12_zcurve_tri(spark, sf_dir):
    return zcurve.context_totals(sequenced(spark, sf_dir), 2)


PROTEIN_SQL = f"""SELECT o.*, t.protein FROM orfseqs o JOIN (
 SELECT {KEY_SQL}, string_agg(CASE WHEN i = 1 AND NOT partial5 THEN 'M' ELSE aa END, '' ORDER BY i) AS protein FROM (
  SELECT {KEY_SQL}, partial5, unnest(listed) AS codon, generate_subscripts(listed, 1) AS i FROM (SELECT *, regexp_extract_all(seq, '...') AS listed FROM orfseqs)) JOIN amino USING (codon) GROUP BY {KEY_SQL}
 ) t USING ({KEY_SQL})"""


@registered(query(f"SELECT {KEY_SQL}, protein FROM proteins", "orfseqs", "amino", more={"proteins": PROTEIN_SQL}))
def q13_translate_orfs(spark, sf_dir):
    return sequenced(spark, sf_dir).select(*KEY, S.translate_gene(F.col("seq"), 11, F.col("partial5")).alias("protein"))


@registered(query("SELECT aa, count(*) AS n FROM (SELECT unnest(string_split(protein, '')) AS aa FROM proteins) GROUP BY aa", "orfseqs", "amino", more={"proteins": PROTEIN_SQL}))
def q14_aa_composition(spark, sf_dir):
    protein = S.translate_gene(F.col("seq"), 11, F.col("partial5"))
    return sequenced(spark, sf_dir).select(F.explode(F.split(protein, "")).alias("aa")).groupBy("aa").agg(F.count(F.lit(1)).alias("n"))


TABLES = tuple(codes.REASSIGNED)


@registered(" UNION ALL ".join(f"SELECT * FROM ({query(f'SELECT {t}::BIGINT AS code, count(*) AS n, sum(len)::BIGINT AS bases FROM orfs', 'orfs', table=t)})" for t in TABLES))
def q15_translation_tables(spark, sf_dir):
    found = orfs.find_orfs_by_code(load(spark, sf_dir), {t: (codes.starts(t), codes.stops(t)) for t in TABLES}, orfs.MIN_LENGTH)
    counts = found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))
    every = spark.createDataFrame([(t,) for t in TABLES], "code int")
    return every.join(F.broadcast(counts), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"), "bases")  # a row a code


@registered(query("SELECT strand, count(*) AS n_90, count(*) FILTER (len >= 300) AS n_300, max(len) AS longest FROM orfs GROUP BY strand", "orfs"))
def q16_orf_length_filter(spark, sf_dir):
    return linear(spark, sf_dir).groupBy("strand").agg(F.count(F.lit(1)).alias("n_90"), F.count_if(F.col("len") >= 300).alias("n_300"), F.max("len").alias("longest"))


def _gc_sql() -> str:
    below = " + ".join(f"(g::FLOAT::DOUBLE > {t!r})::INT" for t in gcbins.thresholds())
    return query(
        "SELECT bin::BIGINT AS bin, count(*) AS n FROM (SELECT i + least(1, min(b - i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS bin FROM ranked) GROUP BY ALL", "orfseqs",
        more={"gcs": "SELECT scaffold_id, strand, \"end\", t_start, (length(seq) - length(translate(seq, 'GC', ''))) / length(seq) AS g FROM orfseqs", "ranked": f"SELECT row_number() OVER (ORDER BY g, scaffold_id, strand, \"end\", t_start) - 1 AS i, {below} AS b FROM gcs"},
    )


@registered(_gc_sql())
def q17_gc_bins(spark, sf_dir):
    rows = sequenced(spark, sf_dir).select("scaffold_id", "strand", "end", "t_start", S.gc_fraction(F.col("seq")).alias("gc"))
    rows = cut(rows, "gc")  # read three times, while the sequences behind it are far larger
    return gcbins.assign_bins(rows, "gc", ("scaffold_id", "strand", "end", "t_start")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@registered(query(f"SELECT {KEY_SQL}, len FROM (SELECT *, row_number() OVER (PARTITION BY strand ORDER BY len DESC, scaffold_id, t_start) AS r FROM orfs) WHERE r <= 10", "orfs"))
def q18_top_orfs(spark, sf_dir):
    best = Window.partitionBy("strand").orderBy(F.desc("len"), "scaffold_id", "t_start")
    return linear(spark, sf_dir).withColumn("r", F.row_number().over(best)).where("r <= 10").select(*KEY, "len")


@registered(query(f"SELECT {KEY_SQL}, (SELECT s FROM unnest(starts[1:5]) u(s) ORDER BY (s * 7919) % 101 DESC, s LIMIT 1) AS start FROM orfs WHERE NOT partial5", "orfs"))
def q19_best_start(spark, sf_dir):
    found = linear(spark, sf_dir, with_starts=True).where("not partial5").select(*KEY, F.explode(F.slice("starts", 1, 5)).alias("start"))
    return tis.best_starts(found.withColumn("score", (F.col("start").cast("long") * 7919) % 101), [*KEY])


PAIRS_SQL = {
    "binned": 'SELECT *, unnest(range(t_start // 512, ("end" - 1) // 512 + 1)) AS bin FROM orfs',
    "pairs": """SELECT *, CASE WHEN olen = a_len OR olen = b_len THEN 'INCLUDE' WHEN olen / least(a_len, b_len) >= 0.6 THEN 'INTERSECT' END AS type FROM (
 SELECT a.scaffold_id, a.strand, a.t_start AS a_start, a."end" AS a_end, b.t_start AS b_start, b."end" AS b_end, a.len AS a_len, b.len AS b_len, least(a."end", b."end") - greatest(a.t_start, b.t_start) AS olen
 FROM binned a JOIN binned b ON a.scaffold_id = b.scaffold_id AND a.strand = b.strand AND a.bin = b.bin AND a.bin = greatest(a.t_start, b.t_start) // 512 AND (a.t_start, a."end") < (b.t_start, b."end") AND a."end" > b.t_start AND b."end" > a.t_start) WHERE olen >= 60""",
    "overprints": "SELECT * FROM pairs WHERE type IS NOT NULL",
}


def _overprints(spark, sf_dir):
    return overlap.overlaps(cut(linear(spark, sf_dir), "frames"), min_overlap=60)


@registered(query("SELECT scaffold_id, strand, a_start, a_end, b_start, b_end, olen, type FROM overprints", "orfs", more=PAIRS_SQL))
def q20_overprint_pairs(spark, sf_dir):
    return _overprints(spark, sf_dir)


@registered(query("SELECT type, count(*) AS n, sum(olen)::BIGINT AS bases FROM overprints GROUP BY type", "orfs", more=PAIRS_SQL))
def q21_overprint_summary(spark, sf_dir):
    return _overprints(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("olen").alias("bases"))


@registered(query("SELECT DISTINCT * FROM (SELECT scaffold_id, strand, a_start AS t_start, a_end AS \"end\" FROM overprints UNION ALL SELECT scaffold_id, strand, b_start, b_end FROM overprints)", "orfs", more=PAIRS_SQL))
def q22_overprint_genes(spark, sf_dir):
    pairs = _overprints(spark, sf_dir)
    both = F.explode(F.array(F.struct(F.col("a_start").alias("t_start"), F.col("a_end").alias("end")), F.struct(F.col("b_start").alias("t_start"), F.col("b_end").alias("end"))))
    return pairs.select("scaffold_id", "strand", both.alias("g")).select("scaffold_id", "strand", "g.t_start", "g.end").distinct()


HEAD = "concat('# ', name, chr(9), host_len, ' bp', chr(9), 'linear', chr(9), 'UNA', chr(9), '01-JAN-2024')"
DATE = "01-JAN-2024"
SCORE = "printf('%.3f', score)"
HEADED = "CASE WHEN scaffold_id IS DISTINCT FROM lag(scaffold_id) OVER (ORDER BY ordinal) THEN concat({head}, chr(10), {line}) ELSE {line} END"


def _headed(head: str, line: str) -> str:
    return query(f"SELECT ordinal, {HEADED.format(head=head, line=line)} AS line FROM numbered", "numbered")


GFF = f"concat_ws(chr(9), name, '{genes.PROGRAM}', 'CDS', start, stop, {SCORE}, strand, '0', concat('ID=orf', printf('%06d', ordinal), CASE WHEN partial3 THEN ';partial3=true' WHEN partial5 THEN ';partial5=true' ELSE '' END))"


@registered(_headed(HEAD, GFF))
def q23_gff_rows(spark, sf_dir):
    return genes.with_heads(numbered(spark, sf_dir), genes.host_line(DATE), genes.gff_line())


@registered(_headed(HEAD, "concat(start, ' ', stop, chr(9), strand)"))
def q24_med_rows(spark, sf_dir):
    return genes.with_heads(numbered(spark, sf_dir), genes.host_line(DATE), genes.med_line())


LOCUS = f"concat('LOCUS       ', name, ' ', lpad(host_len::VARCHAR, greatest(27 - length(name), length(host_len::VARCHAR))::INT, ' '), ' bp    DNA', '       linear', ' UNA {DATE}', chr(10), 'DEFINITION  ', name, chr(10), 'FEATURES             Location/Qualifiers')"
LOCATION = "concat(CASE WHEN strand = '-' THEN 'complement(' ELSE '' END, CASE WHEN (partial5 AND strand = '+') OR (partial3 AND strand = '-') THEN '<' ELSE '' END, start, '..', CASE WHEN (partial3 AND strand = '+') OR (partial5 AND strand = '-') THEN '>' ELSE '' END, stop, CASE WHEN strand = '-' THEN ')' ELSE '' END)"
FEATURE = f"concat('     CDS             ', {LOCATION}, chr(10), repeat(' ', 21), '/transl_table=11', chr(10), repeat(' ', 21), '/note=\"version={genes.PROGRAM};ID=orf', printf('%06d', ordinal), ';score=', {SCORE}, '\"')"


@registered(_headed(LOCUS, FEATURE))
def q25_gbk_rows(spark, sf_dir):
    return genes.with_heads(numbered(spark, sf_dir), genes.locus_lines(DATE), genes.genbank_feature())


FASTA = f"concat('>', name, ':', start, '..', stop, '(', strand, ') score=', {SCORE}, chr(10), "
GENE_PROTEINS = {"proteins": PROTEIN_SQL, "records": "SELECT g.*, p.protein, p.seq FROM genes g JOIN proteins p USING (scaffold_id, strand, phase, t_start, \"end\")"}


def _gene_records(spark, sf_dir, record):
    found = orfs.with_sequence(cut(gene_table(spark, sf_dir), "frames"), load(spark, sf_dir))
    return found.select("name", "start", "stop", "strand", record.alias("record"))


@registered(query(f"SELECT name, start, stop, strand, {FASTA} regexp_replace(protein, '(.{{1,80}})', '\\1' || chr(10), 'g')) AS record FROM records", "orfseqs", "amino", "genes", more=GENE_PROTEINS))
def q26_faa_records(spark, sf_dir):
    return _gene_records(spark, sf_dir, genes.protein_record())


@registered(query(f"SELECT name, start, stop, strand, {FASTA} regexp_replace(seq, '(.{{1,80}})', '\\1' || chr(10), 'g')) AS record FROM records", "orfseqs", "amino", "genes", more=GENE_PROTEINS))
def q27_fna_records(spark, sf_dir):
    return _gene_records(spark, sf_dir, genes.nucleotide_record())


START_NAMES = codes.starts(11)
UPSTREAM = ", ".join(f"'{c}'" for c in (*START_NAMES, "CTG"))
WINDOW_SQL = {
    "hosts": "SELECT o.*, s.seq AS host FROM orfs o JOIN strands s USING (scaffold_id, strand) WHERE o.len > 300",
    "own": "SELECT scaffold_id, strand, CASE WHEN st = t_start THEN 'T' ELSE 'D' END AS profile, substr(host, st - 49, 65) AS win FROM (SELECT *, unnest(starts) AS st FROM hosts) WHERE st >= t_start AND st + 15 <= host_len AND st >= 50",
    "upper": f"SELECT scaffold_id, strand, 'U' AS profile, substr(host, st - 49, 65) AS win FROM (SELECT *, unnest(range(greatest(50, t_start - 150), least(t_start - 3, host_len - 15))) AS st FROM hosts) WHERE substr(host, st + 1, 3) IN ({UPSTREAM})",
    "wins": "SELECT * FROM own UNION ALL SELECT * FROM upper",
}


def _profile_sql(order: int) -> dict[str, str]:
    bases = "(VALUES ('A'), ('C'), ('G'), ('T'))"
    grid = f"SELECT p AS profile, j AS row, concat({', '.join(f'b{i}' for i in range(order + 1))}) AS kmer FROM (VALUES ('T'), ('D'), ('U')) x(p), range(0, {65 - order}) r(j), " + ", ".join(f"{bases} y{i}(b{i})" for i in range(order + 1))
    return WINDOW_SQL | {
        "hits": f"SELECT profile, j AS row, substr(win, (j + 1)::BIGINT, {order + 1}) AS kmer, count(*) AS n FROM wins, range(0, {65 - order}) r(j) GROUP BY ALL",
        "grid": grid,
        "counts": "SELECT profile, row, kmer, (coalesce(n, 0) + 1)::BIGINT AS cnt FROM grid LEFT JOIN hits USING (profile, row, kmer)",
        "logs": f"SELECT *, ln(cnt / sum(cnt) OVER (PARTITION BY profile, row, substr(kmer, 1, {order}))) AS logp, ln(sum(cnt) OVER (PARTITION BY profile, row, substr(kmer, 1, {order})) / sum(cnt) OVER (PARTITION BY profile, row)) AS prior FROM counts",
    }


def hosted(spark, sf_dir):
    """Frames with their starts and the bases around these."""
    scaffolds = stored(spark, sf_dir)
    return orfs.with_context(cut(orfs.find_orfs(scaffolds, with_starts=True), "frames"), scaffolds)


def _windows(spark, sf_dir):
    return tis.windows(hosted(spark, sf_dir), START_NAMES, [*KEY])


def _window_lists(scaffolds):
    """The same windows as lists, which are counted as they are."""
    return tis.with_windows(orfs.find_orfs_with_context(scaffolds, above=tis.SAMPLE_LENGTH), START_NAMES, ["scaffold_id"])


@registered(query("SELECT profile, row, kmer, cnt FROM counts", "orfs", more=_profile_sql(1)))
def q28_kmer_profile(spark, sf_dir):
    return tis.profile_counts(_window_lists(stored(spark, sf_dir)), 1)


@registered(query("SELECT profile, row, kmer, round(logp, 6) AS logp, round(prior, 6) AS prior FROM logs", "orfs", more=_profile_sql(2)))
def q29_profile_logprob(spark, sf_dir):
    return tis.profile_logs(tis.profile_counts(_window_lists(stored(spark, sf_dir)), 2), 2).select("profile", "row", "kmer", F.round("logp", 6).alias("logp"), F.round("prior", 6).alias("prior"))


BASES_SQL = {**WINDOW_SQL, "bases": "SELECT base, count(*) AS cnt FROM (SELECT unnest(string_split(win, '')) AS base FROM upper) GROUP BY base"}


@registered(query("SELECT base, cnt FROM bases", "orfs", more=BASES_SQL))
def q30_upstream_false(spark, sf_dir):
    return tis.background(_windows(spark, sf_dir))


def _odds(names) -> str:
    return " + ".join("*".join(f"p{b}" for b in c) for c in names)


@registered(
    query(
        "SELECT (n + 1)::BIGINT AS max_alter, round(up, 6) AS false_up, round(n - up, 6) AS false_down FROM (SELECT n, sum(n * q * p ** n) OVER (ORDER BY n) - n * q * p ** n AS up, sum(q * p ** n) OVER (ORDER BY n) AS covered, q, p FROM rates, range(0, 2000) r(n)) WHERE covered > 0.99 ORDER BY n LIMIT 1", "orfs",
        more=BASES_SQL | {
            "shares": "SELECT " + ", ".join(f"sum(cnt) FILTER (base = '{b}') / sum(cnt) AS p{b}" for b in "ACGT") + " FROM bases",
            "rates": f"SELECT s / (s + e) AS p, e / (s + e) AS q FROM (SELECT {_odds(codes.starts(11))} AS s, {_odds(codes.stops(11))} AS e FROM shares)",
        },
    )
)
def q31_alter_params(spark, sf_dir):
    found = tis.alter_params({r["base"]: r["cnt"] for r in tis.background(_windows(spark, sf_dir)).collect()})
    return spark.createDataFrame([(found.max_alter, round(found.false_up, 6), round(found.false_down, 6))], "max_alter long, false_up double, false_down double")


TOY = tis.AlterParams(7, 0.8, 5.2)
SCORE_SQL = _profile_sql(1) | {
    "wide": "SELECT row, kmer, " + ", ".join(f"max(v) FILTER (profile = '{p}') AS {p.lower()}" for p in tis.PROFILES) + " FROM (SELECT *, logp + CASE WHEN row = 0 THEN prior ELSE 0 END AS v FROM logs) GROUP BY row, kmer",
    "cand": 'SELECT o.scaffold_id, o.strand, o.phase, o.t_start, o."end", o.host_len, s.seq AS host, unnest(o.starts[1:7]) AS st FROM orfs o JOIN strands s USING (scaffold_id, strand)',
    "cwin": f'SELECT {KEY_SQL}, st, substr(host, st - 49, 65) AS win FROM cand WHERE st + 15 <= host_len AND st >= 50 AND "end" - st >= 90',
    "summed": f"SELECT {KEY_SQL}, st, sum(t) AS t, sum(d) AS d, sum(u) AS u FROM (SELECT *, substr(win, (row + 1)::BIGINT, 2) AS kmer FROM (SELECT *, unnest(range(0, 64)) AS row FROM cwin)) JOIN wide USING (row, kmer) GROUP BY {KEY_SQL}, st",
}


@registered(query(f"SELECT {KEY_SQL}, st AS start, round(1 / (1 + exp(d - t) * {TOY.false_down} + exp(u - t) * {TOY.false_up}), 6) AS score FROM summed", "orfs", "strands", more=SCORE_SQL))
def q32_tis_score(spark, sf_dir):
    rows = hosted(spark, sf_dir)
    logs = tis.profile_logs(tis.profile_counts(tis.windows(rows, START_NAMES, [*KEY]), 1), 1).collect()
    found = tis.scored(rows, tis.Profiles.of(logs, 1), TOY, orfs.MIN_LENGTH).select(*KEY, F.inline("cands"))
    return found.select(*KEY, "start", F.round("score", 6).alias("score"))


LABEL_SQL = 'CASE WHEN s > 0.6 THEN 1 WHEN s < 0.05 AND s > 1e-6 THEN -1 END'
TOY_SQL = "SELECT *, ((len * 7 + t_start) % 1000) / 1000.0 AS s FROM orfs"


def _toy_labels(scaffolds: DataFrame) -> DataFrame:
    rows = orfs.find_orfs(scaffolds).withColumn("s", ((F.col("len") * 7 + F.col("t_start")) % 1000) / 1000.0)
    return predict.train_labels(rows, "s")


@registered(query("SELECT label::BIGINT AS label, count(*) AS n, min(len) AS low, max(len) AS high FROM (SELECT *, " + LABEL_SQL + " AS label FROM toy) WHERE label IS NOT NULL GROUP BY label", "orfs", more={"toy": TOY_SQL}))
def q33_train_labels(spark, sf_dir):
    return _toy_labels(load(spark, sf_dir)).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("len").alias("low"), F.max("len").alias("high"))


VECTOR_SQL = {"cells": "SELECT vec_id, i::BIGINT AS feature, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"}


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))


def _scaled_cells(rows, scale):
    """vec_id, feature, scaled: vectors by a scaler of the engine, in long form."""

    @F.pandas_udf("array<double>")
    def run(z: pd.Series) -> pd.Series:
        return pd.Series(list(scale.apply(np.stack(z.to_numpy()))) if len(z) else [], dtype=object)

    return rows.select("vec_id", F.posexplode(run("z")).alias("i", "x")).select("vec_id", (F.col("i") + 1).alias("feature"), F.round("x", 6).alias("scaled"))


@registered(query("SELECT vec_id, feature, round(CASE WHEN h - l < 1e-12 THEN 0 ELSE (x - l) / (h - l) END, 6) AS scaled FROM cells JOIN (SELECT feature, min(x) AS l, max(x) AS h FROM cells GROUP BY feature) USING (feature)", more=VECTOR_SQL))
def q34_minmax_scale(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return _scaled_cells(rows, svm.value_range(rows, 64))


@registered(query("SELECT vec_id, feature, round((x - m) / CASE WHEN d < 1e-12 THEN 1 ELSE d END, 6) AS scaled FROM cells JOIN (SELECT feature, avg(x) AS m, stddev_pop(x) AS d FROM cells GROUP BY feature) USING (feature)", more=VECTOR_SQL))
def q35_std_scale(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return _scaled_cells(rows, svm.standard(rows, 64))


AUTO_STOPS = predict.AUTO_STOPS


@registered(" UNION ALL ".join(f"SELECT * FROM ({query(f'SELECT {t}::BIGINT AS code, round(sum(CASE WHEN len >= 150 THEN len ELSE 0 END) / sum(len), 6) AS score FROM orfs', 'orfs', min_length=75, starts=('ATG',), stops=s)})" for t, s in AUTO_STOPS.items()))
def q36_code_table_score(spark, sf_dir):
    scored = predict.code_scores(load(spark, sf_dir), lambda found: found.withColumn("s", (F.col("len") >= 150).cast("double")))
    return scored.select("code", F.round("score", 6).alias("score"))


@registered()
def q37_mlp_score(spark, sf_dir):
    rows = predict.with_vectors(sequenced(spark, sf_dir))
    return rows.withColumn("score", models.applied(default_bank(spark)[25].score, F.col("z"))).select(*KEY, F.round("score", 6).alias("score"))


RBF = models.SVM(predict.toy_centres(4, 64), predict.toy_weights(4), 0.1, 0.5)


def _rbf_sql() -> str:
    cell = lambda row: "[" + ", ".join(repr(float(v)) for v in row) + "]"
    terms = " + ".join(f"{float(w)!r} * exp(-{RBF.gamma} * list_sum(list_transform(list_zip(e, {cell(v)}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))" for w, v in zip(RBF.weights, RBF.vectors))
    return f"SELECT vec_id, round(1 / (1 + exp(-({terms} - {RBF.offset}))), 6) AS score FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@registered(_rbf_sql())
def q38_rbf_score(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round(models.applied(RBF.probability, F.col("e")), 6).alias("score"))


BLEND_SQL = {"toy": TOY_SQL, "counts": f"SELECT count(*) FILTER (l = 1) AS p, count(*) FILTER (l = -1) AS n FROM (SELECT {LABEL_SQL} AS l FROM toy)"}


@registered(query(f"SELECT {KEY_SQL}, round(score, 6) AS score FROM (SELECT *, least(greatest(s * (SELECT CASE WHEN p > 0 AND n / p >= 10 THEN 1.25 - 0.108 * ln(n / p) ELSE 1.0 END FROM counts), len / (len + 300.0)), 1) AS score FROM toy) WHERE score > 0.499", "orfs", more=BLEND_SQL))
def q39_score_blend(spark, sf_dir):
    rows = _toy_labels(load(spark, sf_dir))
    n = {r.label: r["count"] for r in rows.where("label is not null").groupBy("label").count().collect()}
    weight = models.class_weight(n.get(1, 0), n.get(-1, 0))
    out = rows.withColumn("score", S.blend(F.col("s"), F.lit(weight), F.col("len") / (F.col("len") + 300.0)))
    return out.where(F.col("score") > predict.THRESHOLD).select(*KEY, F.round("score", 6).alias("score"))


def _kmeans_sql(k: int = 3) -> dict[str, str]:
    """Z-curve vectors of long frames in long form, scaled to integers, and k-means by plain distances, a pair of expressions a round."""
    parts, at = {"chosen": "SELECT *, row_number() OVER () AS row_id FROM orfseqs WHERE len >= 300"}, 0
    cells = []
    for order in range(3):
        names = ", ".join(f"('{c}', {i})" for i, c in enumerate(map("".join, product("AGCT", repeat=order))))
        for a, axis in enumerate(codes.Z_AXES.values()):
            # a feature for each place in the codon, context and axis, in this order
            cells.append(f"SELECT row_id, (1 + {at} + ((i % 3) * {4**order} + no) * 3 + {a})::INT AS feature, sum(CASE WHEN substr(seq, i + {order + 1}, 1) IN ({', '.join(map(repr, axis))}) THEN 1 ELSE -1 END) * 3 / any_value(length(seq)) AS v FROM (SELECT row_id, seq, unnest(range(0, length(seq) - {order})) AS i FROM chosen) JOIN (VALUES {names}) c(context, no) ON context = substr(seq, i + 1, {order}) GROUP BY row_id, feature")
        at += 9 * 4**order
    parts["zcells"] = f"SELECT row_id, feature, coalesce(v, 0) AS v FROM (SELECT row_id FROM chosen) CROSS JOIN range(1, {at + 1}) f(feature) LEFT JOIN ({' UNION ALL '.join(cells)}) USING (row_id, feature)"
    parts["fixed"] = f"SELECT row_id, feature, floor(CASE WHEN h - l < 1e-12 THEN 0 ELSE (v - l) / (h - l) END * {2**kmeans.BITS} + 0.5)::BIGINT AS v FROM zcells JOIN (SELECT feature, min(v) AS l, max(v) AS h FROM zcells GROUP BY feature) USING (feature)"
    parts["points"] = "SELECT row_id, list(v ORDER BY feature) AS v, (('0x' || substr(md5(any_value(concat_ws('_', scaffold_id, strand, phase, \"end\"))), 1, 13))::BIGINT + 1) / 2.0 ** 52 AS u FROM fixed JOIN chosen USING (row_id) GROUP BY row_id"
    apart = "list_distance(p.v::DOUBLE[], c.v::DOUBLE[])"
    parts["c0_1"] = "SELECT 0 AS cluster, v FROM points ORDER BY u, v LIMIT 1"
    for j in range(1, k):
        parts[f"c0_{j + 1}"] = f"SELECT * FROM c0_{j} UNION ALL (SELECT {j}, v FROM (SELECT p.v, p.u, min(round({apart} ** 2)) AS d FROM points p, c0_{j} c GROUP BY p.row_id, p.v, p.u) WHERE d > 0 ORDER BY -ln(u) / d, u, v LIMIT 1)"
    before = f"c0_{k}"
    for r in range(kmeans.ROUNDS + 1):
        parts[f"a{r}"] = f"SELECT row_id, arg_min(cluster, (d, cluster)) AS cluster FROM (SELECT p.row_id, c.cluster, round({apart} ** 2) AS d FROM points p, {before} c) GROUP BY row_id"
        if r < kmeans.ROUNDS:
            parts[f"c{r + 1}"] = f"SELECT c.cluster, coalesce(m.v, c.v) AS v FROM {before} c LEFT JOIN (SELECT cluster, list(s // n ORDER BY feature) AS v FROM (SELECT cluster, feature, sum(f.v)::BIGINT AS s, count(*) AS n FROM fixed f JOIN a{r} USING (row_id) GROUP BY cluster, feature) GROUP BY cluster) m USING (cluster)"
            before = f"c{r + 1}"
    parts["means"] = f"SELECT cluster, count(*) AS n, avg(len) AS m FROM a{kmeans.ROUNDS} JOIN chosen USING (row_id) GROUP BY cluster"
    return parts


@registered(query("SELECT cluster::BIGINT AS cluster, n, round(m, 3) AS mean_len, cluster = (SELECT arg_min(cluster, (-m, cluster)) FROM means) AS positive FROM means", "orfseqs", more=_kmeans_sql(), once=True))
def q40_kmeans_label(spark, sf_dir):
    labelled = predict.kmeans_labels(predict.with_vectors(sequenced(spark, sf_dir).where("len >= 300")))
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("len"), 3).alias("mean_len"), F.max("positive").alias("positive"))


METRIC_SQL = """WITH p AS (SELECT quality = 1 AS truth, length(text) >= 1000 AS said FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn, count(*) FILTER (truth = said) AS good, count(*) AS n FROM p)
SELECT tp, fp, fn, round(good / n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c"""


@registered(METRIC_SQL)
def q41_classifier_metrics(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("truth"))
    said = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.length("text") >= 1000).alias("said"))
    return metrics.classifier_metrics(labels.join(said, "doc_id"))


@registered()
def q42_meta_predict(spark, sf_dir):
    found = predict.predict(stored(spark, sf_dir), predict.Options(mode="meta"))
    return found.select("name", "start", "stop", "strand", F.round("score", 6).alias("score"))


@registered()
def q43_single_predict(spark, sf_dir):
    found = predict.predict(stored(spark, sf_dir), predict.Options())
    return found.select("name", "start", "stop", "strand", F.round("score", 6).alias("score"))


CIRCULAR_SQL = {
    "tails": "SELECT *, (phase + (3 - host_len % 3) % 3) % 3 AS onward FROM shaped WHERE stop IS NULL AND longest IS NOT NULL",
    "heads": "SELECT scaffold_id, strand, phase AS onward, stop + 3 AS ahead FROM shaped WHERE grp = 0 AND stop IS NOT NULL",
    "met": "SELECT t.*, h.ahead, CASE WHEN host_len - refined + ahead >= 90 THEN refined WHEN host_len - longest + ahead >= 90 THEN longest END AS chosen FROM tails t LEFT JOIN heads h USING (scaffold_id, strand, onward)",
    "wrapped": "SELECT * FROM met WHERE ahead IS NOT NULL AND chosen IS NOT NULL",
    "kept": 'SELECT o.* FROM orfs o WHERE NOT o.partial3 AND NOT (NOT o.partial5 AND EXISTS (SELECT 1 FROM wrapped w WHERE w.scaffold_id = o.scaffold_id AND w.strand = o.strand AND w.onward = o.phase AND w.ahead = o."end")) AND NOT (o.partial5 AND EXISTS (SELECT 1 FROM met m WHERE m.scaffold_id = o.scaffold_id AND m.strand = o.strand AND m.onward = o.phase AND m.ahead = o."end"))',
    "every": """SELECT scaffold_id, strand, phase, t_start, "end", len, partial3, partial5 FROM kept
 UNION ALL SELECT scaffold_id, strand, phase, chosen, ahead, host_len - chosen + ahead, false, false FROM wrapped
 UNION ALL SELECT scaffold_id, strand, phase, ts, host_len, (host_len - ts) - (host_len - ts) % 3, true, false FROM (SELECT *, CASE WHEN host_len - refined >= 90 THEN refined ELSE longest END AS ts FROM met WHERE ahead IS NULL)""",
}


@registered(query(f"SELECT {KEY_SQL}, len, partial3, partial5 FROM every", "orfs", "shaped", more=CIRCULAR_SQL))
def q44_circular_orfs(spark, sf_dir):
    return linear(spark, sf_dir, circular=True).select(*KEY, "len", "partial3", "partial5")



def _toy_net(k: int) -> models.Perceptron:
    """A perceptron of two hidden units with weights made of waves; output weights and offset go with ``k``."""
    w1 = np.round(12 * predict.toy_centres(2, zcurve.DIM), 6)
    return models.Perceptron(models.Standard(np.zeros(zcurve.DIM), np.ones(zcurve.DIM)), w1, np.array([0.2, -0.1]), np.array([2.0 + 0.1 * (k % 3), -1.6]), 0.1 * (k % 5 - 2))


def _wave_sql() -> dict[str, str]:
    """Hidden values of ``_toy_net``: a weight for each k-mer of one to three bases, by place in the codon."""
    w1, rows, at = _toy_net(0).w1, [], 0
    for order in range(3):
        for phase in range(3):
            for context in map("".join, product("AGCT", repeat=order)):
                for b in "ACGT":
                    v = [sum((1 if b in axis else -1) * w1[h, at + a] for a, axis in enumerate(codes.Z_AXES.values())) for h in range(2)]
                    rows.append(f"({order + 1}, {phase}, '{context}{b}', {float(v[0])!r}, {float(v[1])!r})")
                at += 3
    return {
        "waves": f"SELECT * FROM (VALUES {', '.join(rows)}) t(k, phase_in, kmer, v0, v1)",
        "grams": "SELECT scaffold_id, strand, phase, t_start, \"end\", k, (i % 3)::INT AS phase_in, substr(seq, i + 1, k) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - k + 1)) AS i FROM orfseqs, (VALUES (1), (2), (3)) t(k))",
        "hidden": f"SELECT {KEY_SQL}, greatest(0, h0 * 3.0 / length(seq) + 0.2) AS r0, greatest(0, h1 * 3.0 / length(seq) - 0.1) AS r1 FROM (SELECT {KEY_SQL}, sum(v0) AS h0, sum(v1) AS h1 FROM grams JOIN waves USING (k, phase_in, kmer) GROUP BY {KEY_SQL}) JOIN orfseqs USING ({KEY_SQL})",
    }


@registered(query(f"SELECT {KEY_SQL}, round(1 / (1 + exp(-(2.0 * r0 - 1.6 * r1 - 0.2) / 2)), 6) AS score FROM hidden", "orfseqs", more=_wave_sql()))
def q45_perceptron(spark, sf_dir):
    rows = predict.with_vectors(sequenced(spark, sf_dir))
    return rows.select(*KEY, F.round(models.applied(_toy_net(0).score, F.col("z")), 6).alias("score"))


def _scored_parts() -> dict[str, str]:
    below = " + ".join(f"(g::FLOAT::DOUBLE > {t!r})::INT" for t in gcbins.thresholds())
    return _wave_sql() | {
        "gcs": "SELECT *, (length(seq) - length(translate(seq, 'GC', ''))) / length(seq) AS g FROM orfseqs",
        "wanted": f'SELECT *, row_number() OVER (ORDER BY g, scaffold_id, strand, phase, "end") - 1 AS i, {below} AS b FROM gcs',
        "binned": "SELECT *, i + least(1, min(b - i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS bin FROM wanted",
        "scored": f"SELECT *, CASE WHEN bin > 60 THEN 0 ELSE 1 / (1 + exp(-((2.0 + 0.1 * (bin % 3)) * r0 - 1.6 * r1 + 0.1 * (bin % 5 - 2)) / 2)) END AS s FROM binned JOIN hidden USING ({KEY_SQL})",
    }


SCORED_SQL = _scored_parts()


def _bank_sql() -> str:
    return query("SELECT concat('doc_', scaffold_id) AS name, CASE WHEN strand = '+' THEN t_start + 1 ELSE host_len - \"end\" + 1 END AS start, CASE WHEN strand = '+' THEN \"end\" ELSE host_len - t_start END AS stop, strand, round(least(1.5 * s, 1), 6) AS score FROM scored WHERE least(1.5 * s, 1) > 0.499", "orfseqs", more=SCORED_SQL)


@registered(_bank_sql())
def q46_bank_predict(spark, sf_dir):
    """Metagenome mode without start revision, by a bank that is saved and loaded."""
    path = new_path(spark, "bank")
    save_bank(spark, {k: _toy_net(k) for k in range(gcbins.N_BINS - 1)}, path)
    found = predict.predict(stored(spark, sf_dir), predict.Options(mode="meta", revise_tis=False, models=path))
    return found.select("name", "start", "stop", "strand", F.round("score", 6).alias("score"))


REVISED_SQL = _profile_sql(2) | {
    "wide": SCORE_SQL["wide"], "cand": SCORE_SQL["cand"], "cwin": SCORE_SQL["cwin"],
    "summed": SCORE_SQL["summed"].replace("::BIGINT, 2)", "::BIGINT, 3)").replace("range(0, 64)", "range(0, 63)"),
    "best": f'SELECT scaffold_id, strand, phase, t_start, "end", st FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY round(1 / (1 + exp(d - t) * {TOY.false_down} + exp(u - t) * {TOY.false_up}), 12) DESC, st) AS r FROM summed) WHERE r = 1',
}


@registered(query(f'SELECT scaffold_id, strand, phase, coalesce(st, t_start) AS t_start, "end", len - (coalesce(st, t_start) - t_start) AS len FROM orfs LEFT JOIN best USING ({KEY_SQL})', "orfs", "strands", more=REVISED_SQL))
def q47_revised_starts(spark, sf_dir):
    """Starts revised by a profile that is saved and loaded."""
    path = new_path(spark, "starts")
    scaffolds = stored(spark, sf_dir)
    predict.save_starts(tis.profile_logs(tis.profile_counts(_window_lists(scaffolds), 2), 2), TOY, path)
    rows = cut(orfs.find_orfs(scaffolds, with_starts=True).withColumn("i_score", F.lit(0.0)), "frames")
    return predict.revise_starts(rows, scaffolds, 11, predict.Options(tis_model=path)).select(*KEY, "len")


@registered(query(f"SELECT {KEY_SQL} FROM toy WHERE s >= 0.6 AND len >= 300", "orfs", more={"toy": TOY_SQL}))
def q48_start_seeds(spark, sf_dir):
    return predict.seeds_of(_toy_labels(load(spark, sf_dir)).withColumnRenamed("s", "i_score")).select(*KEY)


@registered(query(f'SELECT {KEY_SQL}, md5(CASE WHEN "end" < t_start THEN concat(substr(seq, t_start + 1), substr(seq, 1, "end")) ELSE substr(seq, t_start + 1, len) END) AS digest FROM every JOIN strands USING (scaffold_id, strand)', "orfs", "shaped", "strands", more=CIRCULAR_SQL))
def q49_circular_bases(spark, sf_dir):
    return sequenced(spark, sf_dir, circular=True).select(*KEY, F.md5("seq").alias("digest"))


PAIR_LINES_SQL = PAIRS_SQL | {
    "placed_genes": "SELECT *, len / (len + 300.0) AS score, CASE WHEN strand = '+' THEN t_start + 1 ELSE host_len - \"end\" + 1 END AS l, CASE WHEN strand = '+' THEN \"end\" ELSE host_len - t_start END AS r FROM orfs",
    "lined": 'SELECT o.type, o.strand, concat(\'doc_\', o.scaffold_id) AS name, a_start, a_end, b_start, b_end, a.l AS al, a.r AS ar, a.score AS "as", b.l AS bl, b.r AS br, b.score AS bs FROM overprints o JOIN placed_genes a ON a.scaffold_id = o.scaffold_id AND a.strand = o.strand AND a.t_start = a_start AND a."end" = a_end JOIN placed_genes b ON b.scaffold_id = o.scaffold_id AND b.strand = o.strand AND b.t_start = b_start AND b."end" = b_end',
}


def _pair_row(s: str) -> str:
    return f"concat_ws(chr(9), name, '{genes.PROGRAM}', 'CDS', {s}l, {s}r, printf('%.3f', \"{s}s\"), strand, '0', '.')"


@registered(query(f"SELECT n AS ordinal, concat('# index=', printf('%04d', n), ';type=', type, chr(10), {_pair_row('a')}, chr(10), {_pair_row('b')}) AS line FROM (SELECT *, row_number() OVER (ORDER BY name, strand, a_start, a_end, b_start, b_end) AS n FROM lined)", "orfs", more=PAIR_LINES_SQL))
def q50_overprint_lines(spark, sf_dir):
    found = linear(spark, sf_dir).withColumn("score", F.col("len") / (F.col("len") + 300.0)).withColumn("name", F.concat(F.lit("doc_"), "scaffold_id"))
    return genes.overprint_lines(cut(genes.overprint_pairs(genes.with_coordinates(found), min_overlap=60), "pairs"))


@registered(f"SELECT code FROM ({ORACLE_SQL['q36_code_table_score']}) ORDER BY score DESC, CASE code {' '.join(f'WHEN {t} THEN {i}' for i, t in enumerate(AUTO_STOPS))} END LIMIT 1")
def q51_auto_table(spark, sf_dir):
    code = predict.choose_table(load(spark, sf_dir), lambda found: found.withColumn("s", (F.col("len") >= 150).cast("double")))
    return spark.createDataFrame([(code,)], "code long")


@registered(query("SELECT strand, start_type::BIGINT AS start_type, count(*) AS n FROM events GROUP BY ALL", "events"))
def q52_start_types(spark, sf_dir):
    return orfs.codon_events(orfs.strands(load(spark, sf_dir))).groupBy("strand", "start_type").agg(F.count(F.lit(1)).alias("n"))


@registered(query("SELECT (16 * (instr('TCAG', codon[1:1]) - 1) + 4 * (instr('TCAG', codon[2:2]) - 1) + instr('TCAG', codon[3:3]) - 1)::BIGINT AS code, count(*) AS n FROM codons WHERE strand = '+' AND phase = 0 GROUP BY ALL", "codons"))
def q53_kmer_codes(spark, sf_dir):
    rows = load(spark, sf_dir).select(F.explode(S.codons(F.col("sequence"))).alias("codon"))
    return rows.groupBy(S.kmer_code(F.col("codon")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@registered(f"SELECT * FROM ({ORACLE_SQL['q12_zcurve_tri']}) WHERE zx <> 0 OR zy <> 0 OR zz <> 0".replace("substr(seq, i + 1, 2)", "substr(seq, i + 1, 3)").replace("substr(seq, i + 3, 1)", "substr(seq, i + 4, 1)").replace("length(seq) - 2", "length(seq) - 3"))
def q54_zcurve_quart(spark, sf_dir):
    return zcurve.context_totals(sequenced(spark, sf_dir), 3).where("zx <> 0 or zy <> 0 or zz <> 0")


def _as_fasta(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.lit(">"), "name", F.lit(" made of text\n"), F.regexp_replace(S.wrap(F.col("sequence")), "\n$", "")).alias("value"))


@registered(query("SELECT name, length(sequence) AS length, md5(sequence) AS digest FROM scaffolds", "scaffolds"))
def q55_fasta_files(spark, sf_dir):
    """All scaffolds written as FASTA files and read back."""
    path = new_path(spark, "fasta")
    _as_fasta(load(spark, sf_dir)).write.text(path)
    return readers.read_fasta(spark, path).select("name", F.length("sequence").alias("length"), F.md5("sequence").alias("digest"))


@registered(query("SELECT concat(kind, name) AS name, md5(sequence) AS digest FROM scaffolds, (VALUES ('fa_'), ('gb_'), ('em_')) t(kind) WHERE sequence <> ''", "scaffolds"))
def q56_sequence_files(spark, sf_dir):
    """All scaffolds written as compressed FASTA, GenBank and EMBL files, which are told apart and read back."""
    path = new_path(spark, "files")
    rows = load(spark, sf_dir).where("length > 0")
    named = lambda kind: rows.withColumn("name", F.concat(F.lit(kind), "name"))
    _as_fasta(named("fa_")).write.option("compression", "gzip").text(f"{path}/fa")
    blocks = F.regexp_replace(F.lower("sequence"), "(.{1,60})", "        1 $1\n")
    named("gb_").select(F.concat(F.lit("LOCUS       "), "name", F.lit(" bp DNA\nORIGIN\n"), blocks, F.lit("//")).alias("value")).write.text(f"{path}/gb")
    named("em_").select(F.concat(F.lit("ID   "), "name", F.lit(" ; linear\nSQ   Sequence\n"), blocks, F.lit("//")).alias("value")).write.text(f"{path}/em")
    return readers.read_sequences(spark, f"{path}/*/part-*").select("name", F.md5("sequence").alias("digest"))


@registered(query(f"SELECT (label = 1)::BIGINT AS label, count(*) AS n, sum(len)::BIGINT AS bases FROM (SELECT *, {LABEL_SQL} AS label FROM toy) WHERE label IS NOT NULL GROUP BY label", "orfs", more={"toy": TOY_SQL}))
def q57_labelled_files(spark, sf_dir):
    """Labelled frames written as GFF and FASTA and read back as training data."""
    path = new_path(spark, "labels")
    scaffolds = stored(spark, sf_dir)
    develop.write_labelled(cut(_toy_labels(scaffolds).withColumn("score", F.col("s")), "frames"), scaffolds, path)
    rows = readers.read_labelled(spark, f"{path}/positive.fna", f"{path}/negative.fna")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("bases"))


@registered(f"SELECT line, count(*) AS n FROM (SELECT unnest(string_split(line, chr(10))) AS line FROM ({ORACLE_SQL['q23_gff_rows']})) GROUP BY line")
def q58_gff_files(spark, sf_dir):
    """Genes written as a folder of GFF3 parts, and their lines."""
    path = new_path(spark, "gff")
    writers.write_text(writers.gene_lines(cut(gene_table(spark, sf_dir), "genes"), "gff", date=DATE), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@registered(_rbf_sql().replace("lambda x: x::DOUBLE", "lambda x: (x::DOUBLE + 1) / 2"))
def q59_saved_classifier(spark, sf_dir):
    """A scaler and a classifier that are saved and loaded."""
    path = new_path(spark, "classifier")
    predict.save_classifier(spark, path, models.MinMax(-np.ones(64), np.ones(64)), RBF)
    scale, svm = predict.load_classifier(spark, path)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round(models.applied(lambda x: svm.probability(scale.apply(x)), F.col("e")), 6).alias("score"))


@registered(query("SELECT count(*) AS n, sum(length(sequence))::BIGINT AS bases FROM scaffolds WHERE length(sequence) >= 300", "scaffolds"))
def q60_usable_scaffolds(spark, sf_dir):
    return predict.usable(load(spark, sf_dir), 300).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bases"))


@registered(query(f"SELECT {KEY_SQL}, len FROM orfs WHERE NOT partial5 AND NOT partial3 AND len >= 300", "orfs").replace("atg - longest <= 75", "atg - longest <= 72"))
def q61_long_frames(spark, sf_dir):
    """The frames that label development begins with."""
    return develop.whole_frames(load(spark, sf_dir)).where(F.col("len") >= develop.LONG).select(*KEY, "len")


@registered(query("SELECT round(0.5 / (max(feature) * var_pop(scaled)), 6) AS gamma FROM (SELECT feature, CASE WHEN h - l < 1e-12 THEN 0 ELSE (x - l) / (h - l) END AS scaled FROM cells JOIN (SELECT feature, min(x) AS l, max(x) AS h FROM cells GROUP BY feature) USING (feature))", more=VECTOR_SQL))
def q62_kernel_gamma(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return spark.createDataFrame([(round(svm.auto_gamma(rows, 64, svm.value_range(rows, 64)), 6),)], "gamma double")


@registered(query(f"SELECT held, count(*) AS n FROM (SELECT ('0x' || substr(md5(concat(name, ' ', sequence)), 1, 2))::INT < {bank.HELD_OUT} AS held FROM scaffolds) GROUP BY held", "scaffolds"))
def q63_held_out(spark, sf_dir):
    return load(spark, sf_dir).groupBy(bank.held_out().alias("held")).agg(F.count(F.lit(1)).alias("n"))


@registered(query(f"SELECT s.*, frames FROM ({ORACLE_SQL['q03_genome_summary']}) s, (SELECT count(*) AS frames FROM orfs)", "orfs"))
def q64_report(spark, sf_dir):
    return predict.report(load(spark, sf_dir), predict.Options())


@registered(query("SELECT name, length(sequence) AS length, md5(sequence) AS digest FROM scaffolds WHERE sequence <> ''", "scaffolds"))
def q65_block_gzip(spark, sf_dir):
    """All scaffolds written as block-gzip FASTA by the sink, and read back in ranges of 256 KiB."""
    path = new_path(spark, "blocks")
    datasource.register(spark)
    load(spark, sf_dir).where("sequence <> ''").select("name", "sequence").write.format("fasta").option("compression", "gzip").mode("append").save(path)
    rows = spark.read.format("fasta").option("rangeBytes", 1 << 18).load(path)
    return rows.select("name", "length", F.md5("sequence").alias("digest"))


@registered(query("SELECT name AS seqid, start, stop AS \"end\", round(score, 3) AS score, strand, concat('ID=', scaffold_id, '_', phase, '_', \"end\") AS attributes FROM genes", "genes"))
def q66_gff3_features(spark, sf_dir):
    """Genes written by the GFF3 sink and read back."""
    path = new_path(spark, "features")
    datasource.register(spark)
    found = gene_table(spark, sf_dir)
    rows = found.select(
        F.col("name").alias("seqid"), F.lit(genes.PROGRAM).alias("source"), F.lit("CDS").alias("type"), "start", F.col("stop").alias("end"), F.col("score"), "strand", F.lit("0").alias("phase"),
        F.concat_ws("_", F.concat(F.lit("ID="), "scaffold_id"), "phase", F.col("end")).alias("attributes"),
    )
    rows.write.format("gff3").mode("append").save(path)
    return spark.read.format("gff3").load(path).select("seqid", "start", "end", "score", "strand", "attributes")


@registered(query("SELECT name, length(sequence) AS length, md5(sequence) AS digest FROM scaffolds WHERE sequence <> ''", "scaffolds"))
def q67_sequence_stream(spark, sf_dir):
    """All scaffolds written as files, read as a stream, and written by the streaming sink."""
    path = new_path(spark, "stream")
    datasource.register(spark)
    load(spark, sf_dir).where("sequence <> ''").select("name", "sequence").write.format("fasta").mode("append").save(f"{path}/in")
    rows = spark.readStream.format("fasta").load(f"{path}/in")
    rows.writeStream.format("genbank").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.format("genbank").load(f"{path}/out").select("name", "length", F.md5("sequence").alias("digest"))


def _framed(spark, sf_dir) -> DataFrame:
    """Frames as positive and, read out of frame, as negative examples."""
    found = sequenced(spark, sf_dir).withColumn("name", F.concat_ws("_", "scaffold_id", "strand", "phase", "t_start"))
    both = F.array(F.struct(F.col("seq").alias("sequence"), F.lit(1).alias("label")), F.struct(F.substring(F.col("seq"), F.lit(2), F.length("seq") - 3).alias("sequence"), F.lit(0).alias("label")))
    return found.select("name", F.explode(both).alias("x")).select("name", "x.*")


BANK_ROWS, BANK_LEAST = 60, 30


def _sample_sql() -> dict[str, str]:
    below = " + ".join(f"(g::FLOAT::DOUBLE > {t!r})::INT" for t in gcbins.thresholds())
    return {
        "framed": "SELECT concat_ws('_', scaffold_id, strand, phase, t_start) AS name, seq AS sequence, 1 AS label FROM orfseqs UNION ALL SELECT concat_ws('_', scaffold_id, strand, phase, t_start), substr(seq, 2, length(seq) - 3), 0 FROM orfseqs",
        "digested": f"SELECT * EXCLUDE (d), substr(d, 3) AS h, least({below}, {gcbins.N_BINS - 2}) AS bin, ('0x' || substr(d, 1, 2))::INT < {bank.HELD_OUT} AS held FROM (SELECT *, md5(concat(name, ' ', sequence)) AS d, (length(sequence) - length(translate(sequence, 'GC', ''))) / length(sequence) AS g FROM framed)",
        "sampled": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bin, label ORDER BY h, sequence) AS r FROM digested) WHERE r <= {BANK_ROWS}",
        "targets": f"SELECT t AS target, w, sum(n) FILTER (label = 1) AS pos, sum(n) FILTER (label = 0) AS neg FROM range(0, {gcbins.N_BINS - 1}) a(t), range(0, {gcbins.N_BINS}) b(w), (SELECT bin, label, count(*) AS n FROM sampled WHERE NOT held GROUP BY ALL) c WHERE abs(bin - t) <= w GROUP BY t, w",
        "spans": f"SELECT t AS target, greatest(0, t - w) AS low, least({gcbins.N_BINS - 2}, t + w) AS high FROM (SELECT t, coalesce((SELECT min(w) FROM targets WHERE target = t AND pos >= {BANK_LEAST} AND neg >= {BANK_LEAST}), {gcbins.N_BINS - 1}) AS w FROM range(0, {gcbins.N_BINS - 1}) a(t))",
        "near": f"SELECT * FROM (SELECT target, low, high, label, held, row_number() OVER (PARTITION BY target, label ORDER BY abs(bin - target), h, bin, sequence) AS place FROM sampled JOIN spans ON bin BETWEEN low AND high) WHERE place <= {BANK_ROWS}",
    }


@registered(query("SELECT bin, label::BIGINT AS label, held, count(*) AS n, md5(string_agg(h, ',' ORDER BY h)) AS members FROM sampled GROUP BY ALL", "orfseqs", more={k: v for k, v in _sample_sql().items() if k in ("framed", "digested", "sampled")}))
def q68_bank_sample(spark, sf_dir):
    """The frames of each GC bin that train its scorer."""
    sample = bank.reservoirs(_framed(spark, sf_dir), BANK_ROWS)
    return sample.groupBy("bin", "label", "held").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("h")), ",")).alias("members"))


@registered(query("SELECT target AS bin, low, high, count(*) FILTER (label = 1 AND NOT held) AS n_pos, count(*) FILTER (label = 0 AND NOT held) AS n_neg, count(*) FILTER (held) AS held_out FROM near GROUP BY ALL", "orfseqs", more=_sample_sql()))
def q69_bank_train(spark, sf_dir):
    """A bank trained from frames by GC bin, saved and loaded: what each scorer has learned from."""
    path = new_path(spark, "trained-bank")
    bank.train_bank(_framed(spark, sf_dir), BANK_ROWS, BANK_LEAST, epochs=10).write.parquet(path)
    return spark.read.parquet(path).select("bin", "low", "high", "n_pos", "n_neg", "held_out")


TOY_SCALE = models.MinMax(-np.ones(zcurve.DIM), np.ones(zcurve.DIM))
TOY_MACHINE = models.SVM(np.round(0.5 + 4 * predict.toy_centres(3, zcurve.DIM), 6), np.array([50.0, -40.0, 30.0]), 33.92, 0.02)


def _single_sql() -> str:
    """Scores of the bank, revised starts, and the classifier on the vectors of the revised frames."""
    parts = {}
    for more in (SCORED_SQL, REVISED_SQL):
        parts |= more
    parts["moved"] = f'SELECT scaffold_id, strand, phase, host_len, coalesce(st, t_start) AS t2, "end", len - (coalesce(st, t_start) - t_start) AS len2, s FROM orfs LEFT JOIN best USING ({KEY_SQL}) JOIN (SELECT {KEY_SQL}, s FROM scored) USING ({KEY_SQL})'
    parts["movedseqs"] = "SELECT row_number() OVER () AS row_id, m.*, substr(h.seq, t2 + 1, len2) AS seq FROM moved m JOIN strands h USING (scaffold_id, strand)"
    weights, rows, at = TOY_MACHINE.vectors, [], 0
    for order in range(3):
        for phase in range(3):
            for context in map("".join, product("AGCT", repeat=order)):
                for a in range(3):
                    rows.append(f"({order}, {phase}, '{context}', {a}, " + ", ".join(f"{float(w[at])!r}" for w in weights) + ")")
                    at += 1
    n = len(weights)
    parts["centres"] = f"SELECT * FROM (VALUES {', '.join(rows)}) t(ord, phase_in, context, axis, {', '.join(f'w{j}' for j in range(n))})"
    steps = ", ".join(f"sum(CASE WHEN b IN ({', '.join(map(repr, axis))}) THEN 1 ELSE -1 END) * 3.0 / any_value(size) AS v{a}" for a, axis in enumerate(codes.Z_AXES.values()))
    parts["sites"] = "SELECT row_id, ord, (i % 3)::INT AS phase_in, substr(seq, i + 1, ord) AS context, substr(seq, i + ord + 1, 1) AS b, length(seq) AS size FROM (SELECT row_id, seq, ord, unnest(range(0, length(seq) - ord)) AS i FROM movedseqs, (VALUES (0::BIGINT), (1), (2)) o(ord))"
    parts["sums"] = f"SELECT row_id, ord, phase_in, context, {steps} FROM sites GROUP BY row_id, ord, phase_in, context"
    parts["cells"] = "SELECT row_id, ord, phase_in, context, unnest([0, 1, 2]) AS axis, unnest([v0, v1, v2]) AS v FROM sums"
    # features that a frame does not have lie at 0, which scaling makes a half
    parts["near"] = f"SELECT row_id, " + ", ".join(f"(SELECT sum((0.5 - w{j}) ** 2) FROM centres) + sum(((v + 1) / 2 - w{j}) ** 2 - (0.5 - w{j}) ** 2) AS d{j}" for j in range(n)) + " FROM cells JOIN centres USING (ord, phase_in, context, axis) GROUP BY row_id"
    decision = " + ".join(f"{float(w)!r} * exp(-{TOY_MACHINE.gamma} * d{j})" for j, w in enumerate(TOY_MACHINE.weights))
    parts["judged"] = f"SELECT *, least(greatest(s, 1 / (1 + exp(-({decision} - {TOY_MACHINE.offset})))), 1) AS score FROM movedseqs JOIN near USING (row_id)"
    body = "SELECT concat('doc_', scaffold_id) AS name, CASE WHEN strand = '+' THEN t2 + 1 ELSE host_len - \"end\" + 1 END AS start, CASE WHEN strand = '+' THEN \"end\" ELSE host_len - t2 END AS stop, strand, round(score, 6) AS score FROM judged WHERE score > 0.499"
    return query(body, "orfseqs", "strands", more=parts, once=True)


@registered(_single_sql())
def q70_single_predict_saved(spark, sf_dir):
    """Single-genome mode from end to end by a bank, a start profile and a classifier that are saved and loaded."""
    bank_path, starts_path, machine_path = new_path(spark, "bank"), new_path(spark, "starts"), new_path(spark, "classifier")
    save_bank(spark, {k: _toy_net(k) for k in range(gcbins.N_BINS - 1)}, bank_path)
    scaffolds = stored(spark, sf_dir)
    predict.save_starts(tis.profile_logs(tis.profile_counts(_window_lists(scaffolds), 2), 2), TOY, starts_path)
    predict.save_classifier(spark, machine_path, TOY_SCALE, TOY_MACHINE)
    found = predict.predict(scaffolds, predict.Options(models=bank_path, tis_model=starts_path, cds_model=machine_path))
    return found.select("name", "start", "stop", "strand", F.round("score", 6).alias("score"))


def _components_sql(k: int = 2, squarings: int = 22) -> dict[str, str]:
    """Axes by squaring the covariance until only its first component is left, and then that of what the component leaves."""
    parts = VECTOR_SQL | {
        "centred": "SELECT vec_id, feature, x - avg(x) OVER (PARTITION BY feature) AS x FROM cells",
        "columns": "SELECT feature, list(x ORDER BY vec_id) AS v FROM centred GROUP BY feature",
        "m1": "SELECT a.feature AS i, list(list_dot_product(a.v, b.v) ORDER BY b.feature) AS v FROM columns a, columns b GROUP BY a.feature",
    }
    for j in range(1, k + 1):
        before = f"m{j}"
        for s in range(squarings):
            parts[f"m{j}_{s}"] = f"SELECT a.i, list(list_dot_product(a.v, b.v) / t ORDER BY b.i) AS v FROM {before} a, {before} b, (SELECT sum(v[i]) ** 2 AS t FROM {before}) GROUP BY a.i"
            before = f"m{j}_{s}"
        parts[f"axis{j}"] = f"SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)) * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))])) AS v FROM {before} ORDER BY v[i] DESC LIMIT 1"
        value = f"SELECT sum(u.v[i] * list_dot_product(m.v, u.v)) AS e FROM m{j} m, axis{j} u"
        parts[f"m{j + 1}"] = f"SELECT i, list_transform(range(1, len(m.v) + 1), lambda c: m.v[c] - e * u.v[i] * u.v[c]) AS v FROM m{j} m, axis{j} u, ({value})"
    return parts


@registered(query("SELECT vec_id, round(sum(x * a.v[feature]), 6) AS pc1, round(sum(x * b.v[feature]), 6) AS pc2 FROM centred, axis1 a, axis2 b GROUP BY vec_id", more=_components_sql(), once=True))
def q71_principal_components(spark, sf_dir):
    found = predict.principal_components(_vectors(spark, sf_dir))
    return found.select("vec_id", *[F.round(F.col("pc")[j], 6).alias(f"pc{j + 1}") for j in range(2)])


@registered(query("SELECT concat('doc_', scaffold_id) AS name, CASE WHEN strand = '+' THEN t_start + 1 ELSE host_len - \"end\" + 1 END AS start, CASE WHEN strand = '+' THEN \"end\" ELSE host_len - t_start END AS stop, strand, round(least(1.5 / (1 + exp(-(2.0 * r0 - 1.6 * r1 - 0.2) / 2)), 1), 6) AS score FROM hidden JOIN orfs USING (scaffold_id, strand, phase, t_start, \"end\") WHERE least(1.5 / (1 + exp(-(2.0 * r0 - 1.6 * r1 - 0.2) / 2)), 1) > 0.499", "orfseqs", more=_wave_sql()))
def q72_annotated_files(spark, sf_dir):
    """All scaffolds written as files, annotated by a stream of files in two batches, and once more with a new checkpoint, which adds nothing."""
    path = new_path(spark, "incremental")
    datasource.register(spark)
    load(spark, sf_dir).where("sequence <> ''").select("name", "sequence").repartition(4, "name").write.format("fasta").mode("append").save(f"{path}/in")
    save_bank(spark, {k: _toy_net(0) for k in range(gcbins.N_BINS)}, f"{path}/bank")
    options = predict.Options(mode="meta", revise_tis=False, models=f"{path}/bank")
    for again in range(2):
        incremental.annotate_files(spark, f"{path}/in", f"{path}/genes", f"{path}/checkpoint-{again}", options, max_files=2, pathGlobFilter="*.fa").awaitTermination()
    return incremental.annotated_genes(spark, f"{path}/genes").select("name", "start", "stop", "strand", F.round("score", 6).alias("score"))
