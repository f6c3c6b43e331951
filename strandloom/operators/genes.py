"""Genes in output order: coordinates, ordinals and formatted records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import overlap as O
from strandloom.operators import ranks

PROGRAM = "strandloom"
ORDER = ("name", "stop", "start", "strand")


def with_coordinates(orfs: DataFrame) -> DataFrame:
    """Adds start and stop: 1-based, inclusive, on the forward strand; start is above stop around a circular origin."""
    args = [F.col(c) for c in ("strand", "t_start", "end", "host_len")]
    return orfs.withColumn("start", S.forward_start(*args)).withColumn("stop", S.forward_stop(*args))


def with_ordinals(genes: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``ordinal`` in the order of scaffold name and right end, counted through all scaffolds (of each value of ``per``).  The genes are sorted and written once."""
    return ranks.numbered(genes.where(F.col("name").isNotNull()), ORDER, per)


def _score() -> Column:
    return F.format_string("%.3f", F.col("score").cast("double"))


def _orf_id() -> Column:
    number = F.col("ordinal").cast("string")
    return F.concat(F.lit("orf"), F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number))


def gff_line() -> Column:
    """A GFF3 row."""
    partial = F.when(F.col("partial3"), ";partial3=true").when(F.col("partial5"), ";partial5=true").otherwise("")
    text = lambda c: F.col(c).cast("string")
    return F.concat_ws("\t", "name", F.lit(PROGRAM), F.lit("CDS"), text("start"), text("stop"), _score(), "strand", F.lit("0"), F.concat(F.lit("ID="), _orf_id(), partial))


def med_line() -> Column:
    return F.concat(F.col("start").cast("string"), F.lit(" "), F.col("stop").cast("string"), F.lit("\t"), F.col("strand"))


def genbank_location() -> Column:
    """A feature's location, with complement, join and the marks of partial ends."""
    minus = F.col("strand") == "-"
    a, b, n = (F.col(c).cast("string") for c in ("start", "stop", "host_len"))
    left = F.when((F.col("partial5") & ~minus) | (F.col("partial3") & minus), "<").otherwise("")
    right = F.when((F.col("partial3") & ~minus) | (F.col("partial5") & minus), ">").otherwise("")
    span = F.when(F.col("start") > F.col("stop"), F.concat(F.lit("join("), a, F.lit(".."), n, F.lit(",1.."), b, F.lit(")"))).otherwise(F.concat(left, a, F.lit(".."), right, b))
    return F.when(minus, F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)


def genbank_feature(table: int = 11) -> Column:
    """A CDS feature of three lines."""
    indent = "\n" + " " * 21
    note = F.concat(F.lit(f'{indent}/note="version={PROGRAM};ID='), _orf_id(), F.lit(";score="), _score(), F.lit('"'))
    return F.concat(F.lit("     CDS             "), genbank_location(), F.lit(f"{indent}/transl_table={table}"), note)


def fasta_header() -> Column:
    return F.concat(F.lit(">"), "name", F.lit(":"), F.col("start").cast("string"), F.lit(".."), F.col("stop").cast("string"), F.lit("("), "strand", F.lit(") score="), _score())


def protein_record(table: int = 11) -> Column:
    """Header and wrapped protein; header alone where a codon is ambiguous."""
    body = S.translate_gene(F.col("seq"), table, F.col("partial5"))
    return F.concat(fasta_header(), F.lit("\n"), F.coalesce(S.wrap(body), F.lit("")))


def nucleotide_record() -> Column:
    return F.concat(fasta_header(), F.lit("\n"), S.wrap_bases("seq"))


def host_line(date: str, circular: bool = False) -> Column:
    return F.concat(F.lit("# "), F.col("name"), F.lit("\t"), F.col("host_len").cast("string"), F.lit(f" bp\t{'circular' if circular else 'linear'}\tUNA\t{date}"))


def locus_lines(date: str, circular: bool = False) -> Column:
    width = F.greatest(27 - F.length("name"), F.length(F.col("host_len").cast("string")))
    size = F.lpad(F.col("host_len").cast("string"), width, F.lit(" "))
    shape = ("circular" if circular else " linear").rjust(13)
    return F.concat(F.lit("LOCUS       "), "name", F.lit(" "), size, F.lit(f" bp    DNA{shape} UNA {date}\nDEFINITION  "), "name", F.lit("\nFEATURES             Location/Qualifiers"))


def with_heads(genes: DataFrame, head: Column, line: Column) -> DataFrame:
    """ordinal, line: each gene's line, after ``head`` where the scaffold changes."""
    within = Window.partitionBy("name").orderBy("ordinal")
    first = F.coalesce(F.lag("scaffold_id").over(within) != F.col("scaffold_id"), F.lit(True))
    return genes.select("ordinal", F.when(first, F.concat(head, F.lit("\n"), line)).otherwise(line).alias("line"))


def overprint_pairs(genes: DataFrame, min_overlap: int = O.MIN_OVERLAP, min_ratio: float = O.MIN_RATIO) -> DataFrame:
    """``overlaps`` of genes with name, score and forward coordinates (left, right) of both."""
    named = genes.withColumn("left", F.col("start")).withColumn("right", F.col("stop"))
    return O.overlaps(named, min_overlap, min_ratio, carry=("name", "score", "left", "right"))


def genes_of_pairs(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """The genes of the pairs, each as often as it stands in pairs."""
    key = lambda s: F.struct(F.col(f"{s}_start").alias("t_start"), F.col(f"{s}_end").alias("end"))
    keys = pairs.select("scaffold_id", "strand", F.explode(F.array(key("a"), key("b"))).alias("k")).select("scaffold_id", "strand", "k.*")
    return genes.join(keys, ["scaffold_id", "strand", "t_start", "end"])


def overprint_lines(pairs: DataFrame) -> DataFrame:
    """ordinal, line: an index line and two GFF3 rows for each pair of ``overprint_pairs``."""
    keys = ("a_name", "strand", "a_start", "a_end", "b_start", "b_end")
    place = F.row_number().over(Window.partitionBy("a_name").orderBy(*keys))
    placed = pairs.join(ranks.ahead(pairs, "a_name"), "a_name").withColumn("ordinal", F.col("ahead") + place)
    row = lambda s: F.concat_ws("\t", f"{s}_name", F.lit(PROGRAM), F.lit("CDS"), F.col(f"{s}_left").cast("string"), F.col(f"{s}_right").cast("string"), F.format_string("%.3f", F.col(f"{s}_score").cast("double")), "strand", F.lit("0"), F.lit("."))
    return placed.select("ordinal", F.concat(F.lit("# index="), F.format_string("%04d", F.col("ordinal")), F.lit(";type="), "type", F.lit("\n"), row("a"), F.lit("\n"), row("b")).alias("line"))
