"""Genetic codes and nucleotide symbols."""

from __future__ import annotations

from itertools import product

BASES = "TCAG"
# NCBI's standard code in the order TTT, TTC, TTA, TTG, TCT, ... GGG, and the codons that other tables read differently.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
REASSIGNED = {1: {}, 4: {"TGA": "W"}, 11: {}, 16: {"TAG": "L"}, 25: {"TGA": "G"}}
# Complements of the IUPAC symbols; other letters have N.
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "U": "A", "B": "V", "D": "H", "H": "D", "K": "M", "M": "K", "R": "Y", "Y": "R", "S": "S", "V": "B", "W": "W", "N": "N"}
# The bases that a symbol may stand for.
MEANS = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "B": "CGT", "D": "AGT", "H": "ACT", "K": "GT", "M": "AC", "N": "ACGT", "R": "AG", "S": "CG", "V": "ACG", "W": "AT", "Y": "CT"}
# The Z-curve's axes, purine/pyrimidine, amino/keto, weak/strong.
Z_AXES = {"x": "AG", "y": "AC", "z": "AT"}

START_CODONS = ("ATG", "GTG", "TTG")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def check_table(table: int) -> int:
    if table not in REASSIGNED:
        raise ValueError(f"unknown genetic code {table}; known: {sorted(REASSIGNED)}")
    return table


def amino_acids(table: int = 11) -> dict[str, str]:
    """Amino acid by codon; * for stops."""
    return dict(zip(map("".join, product(BASES, repeat=3)), STANDARD)) | REASSIGNED[check_table(table)]


def starts(table: int = 11) -> tuple[str, ...]:
    return START_CODONS[:1] if check_table(table) == 1 else START_CODONS


def stops(table: int = 11) -> tuple[str, ...]:
    return tuple(c for c, a in sorted(amino_acids(table).items()) if a == "*")


def complement_pair(compat: bool = False) -> tuple[str, str]:
    """Two strings for translate(): letters of both cases, and their complements.  compat: S and W exchanged, as an older tool has them."""
    to = COMPLEMENT | ({"S": "W", "W": "S"} if compat else {})
    upper = "".join(to.get(c, "N") for c in LETTERS)
    return LETTERS + LETTERS.lower(), upper + upper.lower()


def one_hot(symbol: str) -> dict[str, float]:
    """The weights of A, G, C, T that a symbol stands for; zero for others."""
    means = MEANS.get(symbol.upper(), "")
    return {b: (1 / len(means) if b in means else 0.0) for b in "AGCT"}


def z_coordinates(symbol: str, compat: bool = False) -> tuple[float, float, float]:
    """Mean Z-curve step (x, y, z) of a symbol.  compat: Y counts as a purine, as an older tool has it."""
    if compat and symbol.upper() == "Y":
        return 1.0, 0.0, 0.0
    weights = one_hot(symbol)
    return tuple(sum(w if b in axis else -w for b, w in weights.items()) for axis in Z_AXES.values())
