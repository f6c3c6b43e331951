"""Sinks: GFF3, GenBank features, MED, protein and nucleotide FASTA, overlapping pairs.

Lines are made by column expressions and ordered by a number; ``write_text`` writes them as ordered text parts, ``write_file`` as
one local file or to standard output, row by row off an iterator.  ``write`` takes the one or the other by the path.
"""

from __future__ import annotations

import sys
from datetime import date as Date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import genes as G
from strandloom.operators import orfs as O

FORMATS = ("gff", "gbk", "med")
#: Lines of a part, at least, where there are so many.
PART_LINES = 10_000


def stamp(day: Date | None = None) -> str:
    """DD-MON-YYYY with an English month."""
    day = day or Date.today()
    months = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
    return f"{day.day:02d}-{months[day.month - 1]}-{day.year}"


def gene_lines(found: DataFrame, form: str = "gff", table: int = 11, circular: bool = False, date: str | None = None) -> DataFrame:
    """ordinal, line of the genes and of the heads between scaffolds; without the file's head."""
    date = date or stamp()
    numbered = G.with_ordinals(found)
    if form == "gff":
        return G.with_heads(numbered, G.host_line(date, circular), G.gff_line())
    if form == "med":
        return G.with_heads(numbered, G.host_line(date, circular), G.med_line())
    if form == "gbk":
        lines = G.with_heads(numbered, G.locus_lines(date, circular), G.genbank_feature(table))
        # every record but the first begins after the end of the one before
        return lines.withColumn("line", F.when((F.col("ordinal") > 1) & F.col("line").startswith("LOCUS"), F.concat(F.lit("ORIGIN\n//\n"), "line")).otherwise(F.col("line")))
    raise ValueError(f"unknown format {form}; known: {FORMATS}")


def heads(form: str, table: int = 11) -> list[str]:
    """A file's first lines."""
    return {"gff": ["##gff-version 3 ", f"# Translation Table: {table}"], "med": ["## MED", f"# Translation Table: {table}"], "gbk": []}[form]


def tails(form: str, any_gene: bool) -> list[str]:
    return ["ORIGIN", "//"] if form == "gbk" and any_gene else []


def fasta_lines(found: DataFrame, scaffolds: DataFrame, protein: bool, table: int = 11) -> DataFrame:
    """ordinal, line: FASTA records of genes, each without its last line break."""
    record = G.protein_record(table) if protein else G.nucleotide_record()
    return O.with_sequence(G.with_ordinals(found), scaffolds).select("ordinal", F.regexp_replace(record, "\n$", "").alias("line"))


def write_text(lines: DataFrame, path: str, first: list[str] | None = None, form: str | None = None) -> int:
    """Ordered parts of a text folder: part n's lines come before part n + 1's; returns the number of rows.  Tasks write, the driver sees no row."""
    lines = lines.select(F.col("ordinal").cast("long").alias("ordinal"), "line")
    n = lines.count()
    around = [(i - len(first or []), x) for i, x in enumerate(first or [])] + [((1 << 62) + i, x) for i, x in enumerate(tails(form, n > 0) if form else [])]
    if around:
        lines = lines.unionByName(lines.sparkSession.createDataFrame(around, "ordinal long, line string"))
    # ordinals have no gaps, so they tell the part; a range partition would have to make all lines twice, to find its bounds first
    most = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, n // PART_LINES))
    part = F.floor((F.col("ordinal") - 1) / F.lit(max(n, 1)) * parts)
    part = F.greatest(F.least(part, F.lit(parts - 1)), F.lit(0)).cast("int")
    lines.repartitionById(parts, part).sortWithinPartitions("ordinal").select("line").write.text(path)
    return n


def write_file(lines: DataFrame, path: str, first: list[str] | None = None, form: str | None = None) -> int:
    """One local file, or "-" for standard output; returns the number of rows."""
    out = sys.stdout if path == "-" else open(path, "w", encoding="utf-8")
    n = 0
    try:
        for line in first or []:
            out.write(line + "\n")
        for row in lines.orderBy("ordinal").toLocalIterator(prefetchPartitions=True):
            out.write(row.line + "\n")
            n += 1
        for line in tails(form, n > 0) if form else []:
            out.write(line + "\n")
    finally:
        if path != "-":
            out.close()
    return n


def write(lines: DataFrame, path: str, first: list[str] | None = None, form: str | None = None) -> int:
    """A path that ends in / is a folder, which tasks write."""
    return write_text(lines, path.rstrip("/"), first, form) if path.endswith("/") else write_file(lines, path, first, form)
