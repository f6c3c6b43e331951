"""Sequence functions as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import codes


def gc_count(seq: Column) -> Column:
    """Number of G and C, either case."""

    @F.arrow_udf(T.IntegerType())
    def run(seqs: pa.Array) -> pa.Array:
        found = seqs.cast(pa.binary()).to_pylist()
        return pa.array([None if s is None else s.count(b"G") + s.count(b"C") + s.count(b"g") + s.count(b"c") for s in found], pa.int32())

    return run(seq)


def gc_fraction(seq: Column) -> Column:
    """G and C over all characters; null for an empty sequence."""
    return F.when(F.length(seq) > 0, gc_count(seq) / F.length(seq))


def reversed_complements(seqs: pa.Array, compat: bool = False) -> pa.Array:
    """Reverse complements, by bytes where all characters are ASCII."""
    before, after = codes.complement_pair(compat)
    by_byte, by_letter = bytes.maketrans(before.encode(), after.encode()), str.maketrans(before, after)
    one = lambda s: s.translate(by_byte)[::-1] if s.isascii() else s.decode()[::-1].translate(by_letter).encode()
    return pa.array([None if s is None else one(s) for s in seqs.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())


def reverse_complement(seq: Column, compat: bool = False) -> Column:
    @F.arrow_udf(T.StringType())
    def run(seqs: pa.Array) -> pa.Array:
        return reversed_complements(seqs, compat)

    return run(seq)


def codons(seq: Column, phase: Column | int = 0) -> Column:
    """Array of the whole codons from a 0-based offset on."""
    begin = (F.lit(phase) if isinstance(phase, int) else phase) + 1
    return F.regexp_extract_all(F.substring(seq, begin, F.length(seq)), F.lit("(...)"), 1)


def match_codon(codon: Column, names: tuple[str, ...]) -> Column:
    """0-based place of the codon in the list, -1 if it isn't there."""
    return F.array_position(F.array(*map(F.lit, names)), codon).cast("int") - 1


def slice_bytes(seq: Column, begin: Column, length: Column) -> Column:
    """``length`` characters of an ASCII sequence from a 0-based offset on, in time of the piece alone."""
    return F.substring(seq.cast("binary"), begin + 1, length).cast("string")


def one_byte(seq: Column) -> Column:
    """The sequence with N for each character that is not ASCII, so that characters are bytes."""
    return F.when(F.octet_length(seq) == F.length(seq), seq).otherwise(F.regexp_replace(seq, r"[^\x00-\x7F]", "N"))


def kmer_code(kmer: Column) -> Column:
    """Base-4 number of a k-mer with T 0, C 1, A 2, G 3; -1 if another symbol is in it."""
    digits = F.translate(F.upper(kmer), codes.BASES, "0123")
    return F.when(digits.rlike("^[0-3]+$"), F.conv(digits, 4, 10).cast("int")).otherwise(-1)


def forward_start(strand: Column, t_start: Column, end: Column, host_len: Column) -> Column:
    """1-based left end on the forward strand."""
    return F.when(strand == "+", t_start + 1).otherwise(host_len - end + 1)


def forward_stop(strand: Column, t_start: Column, end: Column, host_len: Column) -> Column:
    """1-based right end on the forward strand."""
    return F.when(strand == "+", end).otherwise(host_len - t_start)


def translate_gene(seq: Column, table: int = 11, partial5: Column | None = None) -> Column:
    """The protein of a gene: the first codon is M unless the gene is partial there; null if a codon is ambiguous."""
    pairs = F.create_map(*[F.lit(x) for pair in sorted(codes.amino_acids(table).items()) for x in pair])
    aa = F.transform(codons(F.upper(seq)), lambda c: F.coalesce(pairs[c], F.lit("?")))
    begun = lambda b: F.when(F.length(b) > 0, F.concat(F.lit("M"), F.substring(b, F.lit(2), F.length(b)))).otherwise(b)
    shown = lambda b: begun(b) if partial5 is None else F.when(partial5, b).otherwise(begun(b))
    # a list of one, so that the protein is made once and not wherever it is named
    return F.transform(F.array(F.array_join(aa, "")), lambda b: F.when(~F.contains(b, F.lit("?")), shown(b)))[0]


def wrap(text: Column, width: int = 80) -> Column:
    """Lines of at most ``width`` characters, each ended by a line break."""
    return F.regexp_replace(text, f"(.{{1,{width}}})", "$1\n")


def wrap_bases(name: str, width: int = 80) -> Column:
    """``wrap`` of a column of bases, without a regular expression where all characters are ASCII."""
    text = F.col(name)
    lines = F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1, F.lit(width)), lambda i: F.concat(slice_bytes(text, i, F.lit(width)), F.lit("\n")))
    plain = (F.octet_length(text) == F.length(text)) & ~F.contains(text, F.lit("\n")) & ~F.contains(text, F.lit("\r"))
    return F.when(F.octet_length(text) == 0, "").when(plain, F.array_join(lines, "")).otherwise(wrap(text, width))


def blend(heuristic: Column, weight: Column | float, classifier: Column) -> Column:
    """Final score: the better of weighted heuristic and classifier, at most 1."""
    return F.least(F.greatest(heuristic * weight, classifier), F.lit(1.0))
