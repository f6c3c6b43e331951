"""Aggregates over pairs of truth and prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _part(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def classifier_metrics(pairs: DataFrame, truth: str = "truth", said: str = "said") -> DataFrame:
    """One row: tp, fp, fn, accuracy, precision, recall, f1; 0 where a denominator is."""
    t, s = F.col(truth), F.col(said)
    c = pairs.agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(t == s).alias("good"), F.count(F.lit(1)).alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", _part(F.col("good"), F.col("n")).alias("accuracy"), _part(tp, tp + fp).alias("precision"), _part(tp, tp + fn).alias("recall"), _part(2 * tp, 2 * tp + fp + fn).alias("f1"))
