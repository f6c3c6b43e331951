"""Command line: ``python -m strandloom -i genome.fa -o genes.gff``."""

from __future__ import annotations

import argparse
import sys
import time

from strandloom.operators import genes, orfs, overlap
from strandloom.plans import predict
from strandloom.session import session
from strandloom.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("strandloom", description="Ab initio gene finding for prokaryotic and phage genomes on Spark.")
    p.add_argument("-q", "--quiet", action="store_true", help="no log on standard error")
    p.add_argument("-T", "--threads", type=int, default=0, help="local threads; 0: all, or the cluster's own setting")
    p.add_argument("-i", "--input", default="-", help="FASTA, GenBank or EMBL, plain or gzip; - reads standard input")
    p.add_argument("-o", "--output", default="-", help="gene table; - is standard output, and a path that ends in / a folder of ordered parts, here and below")
    p.add_argument("-f", "--format", default="gff", choices=writers.FORMATS)
    p.add_argument("-a", "--faa", help="proteins of genes")
    p.add_argument("-d", "--fna", help="sequences of genes")
    p.add_argument("-g", "--table", default="11", choices=["1", "4", "11", "16", "25", "auto"], help="genetic code")
    p.add_argument("-l", "--minlen", type=int, default=orfs.MIN_LENGTH, help="least length of a reading frame")
    p.add_argument("-c", "--circ", action="store_true", help="scaffolds are circular")
    p.add_argument("-p", "--proc", default="single", help="single or meta")
    p.add_argument("-s", "--thres", type=float, default=predict.THRESHOLD, help="score above which a frame is a gene")
    p.add_argument("-t", "--train", help="classifier to load, or to save where there is none")
    p.add_argument("-m", "--models", help="bank of scorers, as strandloom.plans.develop train writes it; by default, one trained on synthetic sequences")
    p.add_argument("-n", "--bypass", action="store_true", help="leave start sites as they are")
    p.add_argument("-M", "--maxiter", type=int, default=20, help="most rounds of start-site training for an order")
    p.add_argument("-I", "--tis", help="start-site model to load, or to save where there is none")
    p.add_argument("-L", "--minolen", type=int, default=overlap.MIN_OVERLAP, help="least overlap of overprinted genes")
    p.add_argument("-O", "--overprint", help="table of overprinted gene pairs")
    p.add_argument("-A", "--amino", help="proteins of overprinted genes")
    p.add_argument("-D", "--nucl", help="sequences of overprinted genes")
    p.add_argument("-R", "--ratio", type=float, default=overlap.MIN_RATIO, help="least share of the shorter gene that overlaps")
    return p


def options_of(args: argparse.Namespace) -> predict.Options:
    found = predict.Options(
        table=args.table if args.table == "auto" else int(args.table), min_length=args.minlen, circular=args.circ, mode=args.proc, threshold=args.thres, revise_tis=not args.bypass,
        max_iter=args.maxiter, min_overlap=args.minolen, min_ratio=args.ratio, tis_model=args.tis, cds_model=args.train, models=args.models,
    )
    found.check()
    return found


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        parser().print_help()
        return 0
    args = parser().parse_args(argv)
    try:
        options = options_of(args)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    began = time.time()
    spark = session(f"local[{args.threads}]" if args.threads else None)
    say = (lambda *x: None) if args.quiet else (lambda *x: print(*x, file=sys.stderr))
    scaffolds = readers.read_sequences(spark, args.input)
    if options.table == "auto":
        options.table = predict.choose_table(predict.usable(scaffolds, options.min_length))
        say(f"Genetic code: {options.table}")
    table = int(options.table)
    if not args.quiet:
        total = predict.report(scaffolds, options).first()
        say(f"Scaffolds: {total.scaffolds}\nBases: {total['size']}\nG+C: {100 * (total.gc or 0):.2f} %\nReading frames: {total.frames}")
    found = predict.cut(predict.predict(scaffolds, options), "genes")
    say(f"Genes: {writers.write(writers.gene_lines(found, args.format, table, args.circ), args.output, writers.heads(args.format, table), args.format)}")
    for path, protein in ((args.faa, True), (args.fna, False)):
        if path:
            writers.write(writers.fasta_lines(found, scaffolds, protein, table), path)
    if args.overprint or args.amino or args.nucl:
        pairs = genes.overprint_pairs(found, options.min_overlap, options.min_ratio)
        if args.overprint:
            writers.write(genes.overprint_lines(pairs), args.overprint, ["##gff-version 3"])
        for path, protein in ((args.amino, True), (args.nucl, False)):
            if path:
                writers.write(writers.fasta_lines(genes.genes_of_pairs(pairs, found), scaffolds, protein, table), path)
    say(f"Seconds: {time.time() - began:.1f}")
    return 0
