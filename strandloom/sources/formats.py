"""Text formats of sequences and features: records from text and text from records."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

from strandloom.sources import ranges

SEQUENCES = ("fasta", "genbank", "embl")
#: What ends a record and begins the next.
MARKS = {"fasta": b"\n>", "genbank": b"\n//", "embl": b"\n//", "gff3": b"\n"}
_FLAT = {"genbank": (re.compile(r"(?m)^LOCUS\s+(\S+)"), re.compile(r"(?s)\nORIGIN[^\n]*\n(.*)")), "embl": (re.compile(r"(?m)^ID {3}(\S+)"), re.compile(r"(?s)\nSQ {3}[^\n]*\n(.*)"))}
_NO_LETTER = re.compile(r"[^A-Za-z]+")
_LEAD = re.compile(r"\A[\n\r]*>")
_LINE_END = re.compile(r"[^A-Za-z\n]?(\n|\Z)")
GFF3 = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
Wanted = Callable[[str], bool] | None


def sniff(text: str) -> str:
    """The format that the first line that isn't empty shows."""
    for line in text.splitlines():
        if line.strip():
            for mark, name in ((">", "fasta"), ("LOCUS", "genbank"), ("ID   ", "embl")):
                if line.startswith(mark):
                    return name
            raise ValueError(f"unknown sequence format: {line[:40]!r}")
    raise ValueError("no content")


def _fasta(text: str, wanted: Wanted) -> tuple[str, str] | None:
    lead = _LEAD.match(text)
    head, _, body = (text[lead.end() :] if lead else text).partition("\n")
    name = re.match(r"[^ \t]*", head.replace("\r", ""))[0]
    if wanted and not wanted(name):
        return None
    letters = body.replace("\n", "")
    found = name, letters if letters.isascii() and letters.isalpha() else _LINE_END.sub("", body)  # lines of letters alone have nothing else to lose
    return found if found != ("", "") else None


def _flat(text: str, kind: str, wanted: Wanted) -> tuple[str, str] | None:
    name, origin = _FLAT[kind]
    if not (n := name.search(text)) or (wanted and not wanted(n[1])):
        return None
    s = origin.search(text)
    letters = _NO_LETTER.sub("", s[1]).upper() if s else ""
    return (n[1], letters) if letters else None


def _gff3(text: str, wanted: Wanted) -> tuple | None:
    cells = text.rstrip("\r").split("\t")
    if text.startswith("#") or len(cells) != len(GFF3) or (wanted and not wanted(cells[0])):
        return None
    cells = [None if c == "." else c for c in cells]
    return (*cells[:3], int(cells[3]), int(cells[4]), None if cells[5] is None else float(cells[5]), *cells[6:])


def parse(kind: str, text: str, wanted: Wanted = None) -> tuple | None:
    """A record of a known format: name and sequence, or the columns of ``GFF3``; None for one that is empty, a comment or not wanted by its name."""
    if kind == "fasta":
        return _fasta(text, wanted)
    return _gff3(text, wanted) if kind == "gff3" else _flat(text, kind, wanted)


def records(data: BinaryIO, kind: str, begin: int = 0, end: int = 1 << 62, wanted: Wanted = None) -> Iterator[tuple[int, tuple]]:
    """The records that begin in a range of a file, each with its place among these (empty ones count)."""
    for i, content in enumerate(ranges.between(ranges.pieces(data, begin, end), MARKS[kind], begin == 0)):
        if found := parse(kind, content.decode("utf-8", "replace"), wanted):
            yield i, found


def _lines(sequence: str, width: int, head: Callable[[int], str]) -> Iterator[str]:
    for i in range(0, len(sequence), width):
        yield f"{head(i)}{sequence[i : i + width]}\n"


def render(kind: str, row: dict) -> str:
    """The text of a record; nulls are empty in sequences, and dots in features."""
    if kind == "gff3":
        return "\t".join("." if row.get(c) is None else f"{row[c]:.3f}" if c == "score" else str(row[c]) for c in GFF3) + "\n"
    name, sequence = row["name"] or "", row["sequence"] or ""
    if kind == "fasta":
        return f">{name}\n{''.join(_lines(sequence, 80, lambda _: ''))}"
    if kind == "genbank":
        return f"LOCUS       {name} {len(sequence)} bp DNA\nORIGIN\n{''.join(_lines(sequence.lower(), 60, lambda i: f'{i + 1:>9} '))}//\n"
    return f"ID   {name} ; linear\nSQ   Sequence {len(sequence)} BP;\n{''.join(_lines(sequence.lower(), 60, lambda _: '     '))}//\n"
