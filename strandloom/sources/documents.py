"""Scaffolds derived from a table of texts: letters become bases, so that every query runs on any text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import spread

# The letters and the bases that they stand for.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
AS_BASES = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"


_BASES = bytes.maketrans(LETTERS.encode(), AS_BASES.encode())
_OTHERS = bytes(set(range(256)) - set(LETTERS.encode()))


def scaffolds_of(texts: DataFrame, key: str = "doc_id", text: str = "text", prefix: str = "doc_") -> DataFrame:
    """scaffold_id, name, sequence, length.  No byte of a longer UTF-8 character is a letter, so texts are translated byte by byte, in one narrow Arrow pass."""
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("scaffold_id"), F.concat(F.lit(prefix), F.col(key)).alias("name"), F.col(text).alias("sequence"))
    schema = T.StructType([*rows.schema.fields, T.StructField("length", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t.translate(_BASES, _OTHERS) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary()).cast(pa.string()), pa.array(map(len, found), pa.int32())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffolds_of(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
