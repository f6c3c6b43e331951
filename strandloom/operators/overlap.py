"""Overlapping genes of one strand: an interval self-join, over position bins so that a long scaffold is no one task.

An interval is dealt to each bin it touches, pairs meet in bins, and a pair counts in the bin of its larger start only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_OVERLAP, MIN_RATIO = 120, 0.6
BIN = 4_096
KEY = ("t_start", "end")


def overlaps(genes: DataFrame, min_overlap: int = MIN_OVERLAP, min_ratio: float = MIN_RATIO, bin_size: int = BIN, carry: tuple[str, ...] = ()) -> DataFrame:
    """scaffold_id, strand, a_start, a_end, b_start, b_end, olen, type of pairs of genes, a before b.

    INCLUDE: the overlap is all of one gene.  INTERSECT: it is at least ``min_ratio`` of the shorter.  Ends before starts (around a
    circular origin) are unwrapped.  ``carry``: columns to return of both genes, prefixed a_ and b_.
    """
    unwrapped = F.when(F.col("end") < F.col("t_start"), F.col("end") + F.col("host_len")).otherwise(F.col("end"))
    rows = genes.select("scaffold_id", "strand", "t_start", "end", "len", unwrapped.alias("until"), *[c for c in carry if c not in ("t_start", "end", "len")])
    binned = rows.withColumn("bin", F.explode(F.sequence((F.col("t_start") / bin_size).cast("int"), ((F.col("until") - 1) / bin_size).cast("int"))))
    a = binned.select("scaffold_id", "strand", "bin", *[F.col(c).alias(f"a_{c}") for c in rows.columns if c not in ("scaffold_id", "strand")])
    b = binned.select("scaffold_id", "strand", "bin", *[F.col(c).alias(f"b_{c}") for c in rows.columns if c not in ("scaffold_id", "strand")])
    olen = F.least("a_until", "b_until") - F.greatest("a_t_start", "b_t_start")
    first = F.struct("a_t_start", "a_end") < F.struct(F.col("b_t_start").alias("a_t_start"), F.col("b_end").alias("a_end"))
    met = a.join(b, ["scaffold_id", "strand", "bin"]).where(first & (F.col("bin") == (F.greatest("a_t_start", "b_t_start") / bin_size).cast("int")))
    met = met.withColumn("olen", olen).where((F.col("olen") > 0) & (F.col("olen") >= min_overlap))
    kind = F.when((F.col("olen") == F.col("a_len")) | (F.col("olen") == F.col("b_len")), "INCLUDE").when(F.col("olen") / F.least("a_len", "b_len") >= min_ratio, "INTERSECT")
    met = met.withColumn("type", kind).where("type is not null")
    extra = [f"{side}_{c}" for side in "ab" for c in carry if c not in ("t_start", "end")]
    return met.select("scaffold_id", "strand", F.col("a_t_start").alias("a_start"), "a_end", F.col("b_t_start").alias("b_start"), "b_end", "olen", "type", *extra)
