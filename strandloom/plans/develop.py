"""Model development: labelling reading frames without annotation, training scorers from labelled sequences, and saving banks.

``python -m strandloom.plans.develop label -i genome.fa -o folder`` writes positive and negative frames as GFF and FASTA;
``... train -p positive.fa -n negative.fa -o model`` trains a scorer for each GC bin and prints their metrics on held-out sequences.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import genes, models, orfs
from strandloom.plans import predict
from strandloom.plans.bank import train_bank
from strandloom.session import cut, session
from strandloom.sources import readers, writers

LONG = 300
PATIENCE = 72


def whole_frames(scaffolds: DataFrame, table: int = 11, min_length: int = orfs.MIN_LENGTH) -> DataFrame:
    """Frames with start and stop; an ATG less than 75 bases behind the first start is preferred."""
    return orfs.find_orfs(scaffolds, table, min_length, patience=PATIENCE).where("not partial5 and not partial3")


def label_frames(scaffolds: DataFrame, table: int = 11, min_length: int = orfs.MIN_LENGTH, long: int = LONG, clusters: int = 3) -> DataFrame:
    """Frames with ``label`` 1 or -1 (null: undecided) and ``cluster`` (null for short ones).

    Long frames are clustered by their vectors, the cluster of the longest mean is positive, and a classifier is trained
    again and again on its own labels of all long frames; it then labels all frames.
    """
    found = cut(predict.with_vectors(orfs.with_sequence(whole_frames(scaffolds, table, min_length), scaffolds)), "frames")
    labelled = cut(predict.kmeans_labels(found.where(F.col("len") >= long), clusters), "clusters")
    trained = predict.self_train(labelled)
    if trained is None:
        raise ValueError(f"too few frames of at least {long} bases")
    scale, machine = trained
    score = models.applied(lambda x: machine.probability(scale.apply(x)), F.col("z"))
    out = found.withColumn("score", score).withColumn("label", F.when(F.col("score") > 0.7, 1).when(F.col("score") <= 0.31, -1))
    return out.join(labelled.select(*predict.ID, "cluster"), predict.ID, "left")


def write_labelled(frames: DataFrame, scaffolds: DataFrame, folder: str) -> None:
    """positive and negative frames as GFF rows and nucleotide FASTA under a folder.  ``seq`` is looked up where frames don't have it, which is cheaper: rows are then sorted without bases."""
    kept = [c for c in (*predict.ID, "host_len", "t_start", "len", "partial5", "partial3", "score", "seq", "label") if c in frames.columns]
    labelled = frames.where("label is not null").select(*dict.fromkeys(kept))
    named = genes.with_coordinates(labelled.join(scaffolds.select("scaffold_id", "name"), "scaffold_id"))
    rows = cut(genes.with_ordinals(named, per=("label",)), "labelled")  # read for each file
    spelled = rows if "seq" in rows.columns else cut(orfs.with_sequence(rows, scaffolds), "labelled")
    for label, kind in ((1, "positive"), (-1, "negative")):
        write = lambda part, line, ending: writers.write_text(part.where(F.col("label") == label).select("ordinal", line.alias("line")), f"{folder}/{kind}.{ending}")  # noqa: B023, E731
        write(rows, genes.gff_line(), "gff")
        write(spelled, F.regexp_replace(genes.nucleotide_record(), "\n$", ""), "fna")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("strandloom.plans.develop")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("label", help="label reading frames of a genome")
    a.add_argument("-i", "--input", required=True)
    a.add_argument("-o", "--output", required=True)
    a.add_argument("-g", "--table", type=int, default=11)
    a.add_argument("-m", "--minlen", type=int, default=orfs.MIN_LENGTH)
    a.add_argument("-l", "--longorf", type=int, default=LONG)
    a.add_argument("-c", "--cluster", type=int, default=3)
    a.add_argument("--pca", action="store_true", help="also write the long frames' first two principal components")
    b = sub.add_parser("train", help="train a scorer for each GC bin from two FASTA files")
    b.add_argument("-p", "--positive", required=True)
    b.add_argument("-n", "--negative", required=True)
    b.add_argument("-o", "--output", required=True)
    args = p.parse_args(argv)
    spark = session()
    if args.what == "label":
        scaffolds = readers.read_sequences(spark, args.input)
        gc = scaffolds.agg(F.sum(S.gc_count(F.col("sequence"))) / F.sum(F.length("sequence"))).first()[0]
        print(f"G+C: {gc or 0:.4f}", file=sys.stderr)
        labelled = cut(label_frames(scaffolds, args.table, args.minlen, args.longorf, args.cluster), "labelled")
        write_labelled(labelled, scaffolds, args.output)
        if args.pca:
            flat = predict.principal_components(labelled.where(F.col("cluster").isNotNull()))
            flat.select(*predict.ID, "cluster", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2")).write.mode("overwrite").parquet(f"{args.output}/pca")
    else:
        train_bank(readers.read_labelled(spark, args.positive, args.negative)).write.mode("overwrite").parquet(args.output)
        for r in spark.read.parquet(args.output).orderBy("bin").collect():  # a row a bin
            print(f"bin {r.bin} ({r.low} to {r.high}): {r.n_pos} positive, {r.n_neg} negative; held out {r.held_out}: precision {r.precision:.4f}, recall {r.recall:.4f}, F1 {r.f1:.4f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
