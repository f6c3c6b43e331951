"""Sequence files: FASTA, GenBank and EMBL, plain or gzip-compressed, through the data sources of ``datasource``.

One file feeds many tasks, a block-gzip one too.  ``read_sequences`` finds out each file's format (by the first line) from its first bytes; compression
shows in the bytes, whatever the file's name.

All return scaffold_id, name, sequence, length.  Ids come from the record's file and place, so every plan over one reader has the same ids, on any cluster;
``read_sequences`` writes its records once, as they are read several times.
"""

from __future__ import annotations

import shutil
import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import cut, new_path
from strandloom.sources import datasource, formats, ranges

FORMATS = formats.SEQUENCES
#: Bits of an id below the format's number.
_KIND_BITS = 60


def _loaded(spark: SparkSession, kind: str, path: str | list[str]) -> DataFrame:
    datasource.register(spark)
    return spark.read.format(kind).option("paths", path if isinstance(path, str) else "\n".join(path)).load()


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A name is what follows > up to the first blank; a line loses one trailing character that is no letter.  Records without a sequence stay, but for a nameless last one."""
    return _loaded(spark, "fasta", path)


def read_genbank(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Name: second word of LOCUS; sequence: letters after ORIGIN, upper case.  Records without a sequence go."""
    return _loaded(spark, "genbank", path)


def read_embl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Name: second word of ID; sequence: letters after SQ, upper case.  Records without a sequence go."""
    return _loaded(spark, "embl", path)


def look(path: str) -> str:
    """A file's format, from the first content that is more than white space."""
    fs, at = ranges.opened(path)
    text = b""
    with fs.open_input_file(at) as data:
        for block, _ in ranges.pieces(data, 0, 1 << 62):
            text += block
            if text.strip():
                break
    return formats.sniff(text.decode("utf-8", "replace"))


def _looked(spark: SparkSession, paths: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "kind": [look(p) for p in batch["path"]]})

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(min(len(paths), 2 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "path string, kind string")


def _from_stdin(spark: SparkSession) -> str:
    """Standard input, copied to the shared folder."""
    path = f"{new_path(spark, 'stdin')}.txt"
    fs, at = ranges.opened(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        shutil.copyfileobj(sys.stdin.buffer, out, ranges.BLOCK)
    return path


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of any of the formats, compressed or not; "-" reads standard input.  Records are written once, with their ids."""
    given = [_from_stdin(spark) if path == "-" else path] if isinstance(path, str) else path
    paths = [p for p, info in ranges.listed(given) if info.size]
    if not paths:
        raise ValueError(f"no files: {path}")
    groups: dict[str, list[str]] = {}
    for r in _looked(spark, paths).collect():  # a row a file, like the listing of the files itself
        groups.setdefault(r.kind, []).append(r.path)
    parts = [_loaded(spark, kind, sorted(some)).withColumn("scaffold_id", F.col("scaffold_id") + (FORMATS.index(kind) << _KIND_BITS)) for kind, some in sorted(groups.items())]
    return cut(reduce(DataFrame.unionByName, parts), "scaffolds")


def read_labelled(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """Sequences of two files with ``label`` 1 and 0."""
    labelled = lambda path, label: read_fasta(spark, path).select((F.col("scaffold_id") + (label << _KIND_BITS)).alias("scaffold_id"), "name", "sequence", F.lit(label).alias("label"))
    return labelled(positive, 1).unionByName(labelled(negative, 0))
