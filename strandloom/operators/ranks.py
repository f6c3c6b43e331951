"""Global ranks without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import cut

#: Bits of a row's place in its partition, in Spark's monotonically increasing ids.
_PLACE_BITS = 33


def ahead(rows: DataFrame, key: str) -> DataFrame:
    """key, ahead: for each value of the key, how many rows have smaller ones.

    The values are counted and sorted in range partitions; the only window that sees all of them has one row a partition.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(counts.orderBy(key).withColumn("part", F.spark_partition_id()), "ranks")  # where a value lies is settled by the write
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("part").agg(F.sum("n").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(base), "part").select(key, (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("ahead"))


def numbered(rows: DataFrame, order: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``ordinal``, from 1 on in the order of ``order``, for each value of ``per`` by itself.

    Rows are sorted once, in range partitions, and written with their places there; the only window over partitions has a row for each of these.
    """
    key = F.monotonically_increasing_id()  # partition and place, settled by the write
    placed = cut(rows.orderBy(*per, *order).withColumn("__at", key).withColumn("__part", F.shiftright("__at", _PLACE_BITS)), "ranks")
    before = Window.partitionBy(*per).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*per, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    base = parts.select(*per, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__base"))
    return placed.join(F.broadcast(base), [*per, "__part"]).withColumn("ordinal", F.col("__at") + F.col("__base")).select(*rows.columns, "ordinal")
