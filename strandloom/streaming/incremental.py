"""Streams of new sequence records through the stateless half of the engine.

Reading frames of a record need no other record, so new FASTA files can be annotated as they come: each micro-batch
runs the batch plan on its own records and appends its frames, scored in metagenome mode without start revision.

``annotate_files`` writes the genes of each file exactly once.  Its stream is of files, not of records: a batch's genes and the list of its files are written aside and appear in the
target by one rename, so a batch that was cut off leaves nothing there and one that comes again finds its files listed.  What counts is the target, not the checkpoint: a stream with a
new checkpoint adds nothing for files that are listed.  A file of another time or size is a new one; files must appear whole, by a rename.  One stream at a time may write to a target,
in a file system whose renames are atomic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.plans import predict
from strandloom.session import matches, publish
from strandloom.sources import readers

FILES = "path string, modificationTime timestamp, length long"
GENES = (
    "scaffold_id long, name string, host_len int, strand string, phase int, t_start int, end int, len int, partial5 boolean, partial3 boolean, "
    "i_score double, d_score double, score double, start int, stop int, batch string"
)


def fasta_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """name, sequence of the records of FASTA files that appear in a folder."""
    rows = spark.readStream.option("lineSep", "\n>").options(**options).text(folder)
    rows = rows.withColumn("value", F.regexp_replace("value", "^[\n\r]*>", ""))
    head = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(head) + 2, F.length("value"))
    return rows.select(F.regexp_extract(head, "^[^ \t\r]*", 0).alias("name"), F.regexp_replace(body, r"[^A-Za-z\n]?(\n|\z)", "").alias("sequence")).where("sequence <> ''")


def annotate_stream(records: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, options: predict.Options | None = None) -> StreamingQuery:
    """Starts a query that hands each micro-batch's genes to ``sink`` (a DataFrame and the batch's number; a batch may come twice)."""
    settings = options or predict.Options(mode="meta", revise_tis=False)

    def batch(rows: DataFrame, number: int) -> None:
        numbered = predict.cut(rows.withColumn("scaffold_id", F.monotonically_increasing_id()), "batch")  # ids must not change when read again
        sink(predict.predict(numbered, settings), number)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, target: str, part: str, schema: str) -> DataFrame:
    """One of the two tables of all batches; empty before the first."""
    if not matches(spark, f"{target}/batch-*/{part}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{target}/batch-*/{part}")


def annotated_files(spark: SparkSession, target: str) -> DataFrame:
    """path, modificationTime, length of the files whose genes are in the target."""
    return _parts(spark, target, "files", FILES)


def annotated_genes(spark: SparkSession, target: str) -> DataFrame:
    """Genes of all batches, as ``predict`` returns them, with ``batch``; a scaffold is known by its batch and id."""
    return _parts(spark, target, "genes", GENES)


def annotate_files(spark: SparkSession, source: str, target: str, checkpoint: str, options: predict.Options | None = None, max_files: int = 1000, **reader: str) -> StreamingQuery:
    """Starts a query that annotates the sequence files (of any known format) in a folder that no batch in ``target`` lists, and ends when there are no more.

    ``max_files``: files of a batch; the driver holds the names of one batch's files.  ``reader``: options of Spark's file stream.  Files without genes are listed too, but not
    empty files.  The lists of earlier batches are read once a batch, from the parts with times as late as the batch's first.
    """
    settings = options or predict.Options(mode="meta", revise_tis=False)

    def batch(files: DataFrame, number: int) -> None:
        session = files.sparkSession
        found = {tuple(r) for r in files.collect()}
        if not found:
            return
        known = annotated_files(session, target).where(F.col("modificationTime") >= F.lit(min(t for _, t, _ in found)))
        known = known.join(F.broadcast(session.createDataFrame(sorted(found), FILES)), ["path", "modificationTime", "length"], "left_semi")
        new = sorted(found - {tuple(r) for r in known.collect()})
        if not new:
            return
        name = hashlib.sha256("\n".join(f"{path}\t{time.isoformat()}\t{length}" for path, time, length in new).encode()).hexdigest()[:32]
        genes = predict.predict(readers.read_sequences(session, [path for path, _, _ in new]), settings)
        publish({"genes": genes.withColumn("batch", F.lit(name)), "files": session.createDataFrame(new, FILES)}, f"{target}/batch-{name}")

    rows = spark.readStream.format("binaryFile").schema(f"{FILES}, content binary").option("maxFilesPerTrigger", max_files).options(**reader).load(source)
    files = rows.select("path", "modificationTime", "length")  # contents stay unread
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
