"""Greedy GC bins: rows in the order of their GC content move up one bin at a time towards the bin that their value asks for.

With b the number of thresholds below a row's value, the bin is min(b, bin of the row before + 1).  Over the (at most 63)
distinct values of b this has a closed form by a running minimum of a small histogram; only the first rows of each b
can lag, so ranks are taken of at most ``N_BINS`` rows for each b, and no global sort or window is needed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_BINS = 62


def thresholds() -> list[float]:
    """0.20, 0.21, ... as single-precision sums have them."""
    out, at = [], np.float32(0.20)
    for _ in range(N_BINS - 1):
        out.append(float(at))
        at = np.float32(float(at) + 0.01)
    return out


def wanted_bin(gc: Column) -> Column:
    """How many thresholds lie below the value (as a single-precision number); these lie 0.01 apart, so all but the three nearest are told by arithmetic."""
    value = gc.cast("float").cast("double")
    first = F.greatest(F.lit(0), F.least(F.lit(N_BINS - 1), F.floor((value - 0.20) / 0.01).cast("int") - 1))
    listed = F.array(*map(F.lit, thresholds()))
    return reduce(lambda a, b: a + b, [(value > F.coalesce(F.get(listed, first + i), F.lit(float("inf")))).cast("int") for i in range(3)], first)


def assign_bins(rows: DataFrame, gc: str = "gc", order: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``bin``; ``order``: columns that, after gc, order the rows wholly.  ``within``: columns whose values are binned apart, few in number."""
    wanted = rows.withColumn("__b", F.least(wanted_bin(F.col(gc)), F.lit(N_BINS - 1)))
    counts = wanted.groupBy(*within, "__b").agg(F.count(F.lit(1)).alias("n"))  # at most N_BINS rows for each value of ``within``
    by_bin = Window.partitionBy(*within).orderBy("__b")
    upto = by_bin.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = counts.withColumn("s", F.sum("n").over(upto))
    level = total.withColumn("j", F.col("s") + F.least(F.lit(0), F.min(F.col("__b") - F.col("s")).over(upto)))
    level = level.withColumn("at", F.coalesce(F.lag("j").over(by_bin), F.lit(0))).select(*within, "__b", "at")
    rank = F.row_number().over(Window.partitionBy(*within, "__b").orderBy(gc, *order))
    early = wanted.select(*within, "__b", gc, *order, rank.alias("__r")).where(F.col("__r") <= N_BINS).join(F.broadcast(level), [*within, "__b"])
    early = early.withColumn("__low", F.least(F.col("at") + F.col("__r"), F.col("__b"))).where("__low < __b").select(*within, "__b", gc, *order, "__low")
    out = wanted.join(F.broadcast(early), [*within, "__b", gc, *order], "left")  # at most N_BINS rows for each of N_BINS values
    return out.withColumn("bin", F.coalesce("__low", "__b").cast("int")).drop("__b", "__low")
