"""A corpus pipeline of five stages: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of their input, extra ones too, whatever their names; the last replaces
columns named like its own.

Cases.  Null text, or one without a letter: its language can't be told, and ``language`` drops it; a later stage by itself
keeps it as a text of its own, but ``mix`` takes no document without words.  Null doc_id: kept by all stages.  Repeated
rows: ``near_duplicates`` keeps one.  One id with several texts: each text is judged by itself.  Null lang: not learned
from.  Null source: a source of its own.  Ties: see the operators.  Empty table: no rows.  Very long texts: whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontamination, langid, mixing, neardup, sharding
from strandloom.llm.shared import cut, positional, table


def _kept(docs: DataFrame, judge: Callable[[DataFrame, dict[str, str]], DataFrame], good: Column) -> DataFrame:
    """Rows that ``judge`` finds good; it works on columns of other names, given by their old ones, as it may add columns of any name."""
    renamed, names = positional(docs)
    return judge(renamed, names).where(good).select(*[F.col(v).alias(k) for k, v in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart by a margin stay; the model is fitted on the stage's own input."""
    model = langid.fit(docs)
    return _kept(docs, lambda d, names: langid.predict(d, model, keep=tuple(d.columns), text=names["text"]), ~F.col("rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the smallest doc_id."""
    return neardup.drop_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark`` stay."""
    items = table(spark, sf_dir, "benchmark")
    return _kept(docs, lambda d, names: decontamination.decontaminate(d, items, keep=tuple(d.columns), text=names["text"]), F.size("hits") == 0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask; some not at all, some twice."""
    return mixing.repeated(docs, mixing.mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its place on the Hilbert curve, its shard and its slot there."""
    return sharding.hilbert_shards(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Compression and sketches are not SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
