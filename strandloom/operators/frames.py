"""Open runs of codons, tile by tile, and their joining across tiles.

A tile is scanned by itself, in one pass for all three phases and all genetic codes that are asked for: its events, start and stop codons, are cut at the stops
into segments, and a segment is summed up as its first start, first ATG, stop, and (where asked for) the list of its starts.  A segment with events of the same
tile on both sides is whole, and goes at once if it is too short for a frame.  A tile's first segment may go on from tiles before, its last one into tiles
behind; only these, two a tile at most, take part in the scan along a chromosome.  Joined segments are again first start, first ATG, stop and starts, so the order of joining is free:
the scan counts the stops before each, and an aggregate joins what lies between two stops.

So what is written is a row for each frame long enough and two for each tile, phase and strand, what is shuffled only the rows at tile edges, and no task gets a chromosome's events.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import codes

NONE, STOP, ATG = -2, -1, "ATG"
#: Bases that a worker scans at a time.
CHUNK = 1 << 20
#: Rows of a batch that are Python objects at a time.
_ROWS = 64
#: Segments of a tile and phase, as bits of a segment's number.
_BITS = 20
_BASES = "ACGT"
#: Of the bases alone, as no codon with another letter is an event.
_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")
_FULL_COMPLEMENT = bytes.maketrans(*(x.encode() for x in codes.complement_pair()))
#: What ``scanned`` adds of a frame's surroundings.
CONTEXT = ("ctx", "ctx_off", "gc_first", "gc_atg")
Codes = Mapping[int, tuple[Sequence[str], Sequence[str]]]


def _kinds(starts: Sequence[str], stops: Sequence[str]) -> np.ndarray:
    """For each codon, as a number of base 4, the place among the starts, STOP or NONE; NONE for 64, any codon with another letter."""
    out = np.full(65, NONE, np.int8)
    number = lambda codon: sum(_BASES.index(b) * 4 ** (2 - i) for i, b in enumerate(codon))
    for c in stops:
        out[number(c)] = STOP
    for i, c in enumerate(starts):
        out[number(c)] = i
    return out


_DIGIT = np.full(256, 64, np.int16)
_DIGIT[list(_BASES.encode())] = range(4)


def codons(data: np.ndarray) -> np.ndarray:
    """The number of the codon that begins at each place but the last two, 64 where there is none."""
    digit = _DIGIT[data]
    return np.minimum(16 * digit[:-2] + 4 * digit[1:-1] + digit[2:], 64)


def placed(numbers: np.ndarray, kinds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the events of pieces that follow each other in the data: piece, place in it, and kind."""
    found = kinds[numbers]
    event = np.flatnonzero(found > NONE)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), np.diff(np.searchsorted(event, ends), prepend=0))
    inside = event + 3 <= ends[row]
    event, row = event[inside], row[inside]
    return row, event - (ends - sizes)[row], found[event]


def segments(numbers: np.ndarray, kinds: np.ndarray, sizes: np.ndarray, whole: np.ndarray, least: int, atg: int) -> dict[str, np.ndarray]:
    """The segments of pieces that follow each other in the data; places count within a piece.

    numbers: of codons.  whole: pieces that are not part of anything longer.  least: bases that a frame must have.  atg: the kind of ATG.
    """
    row, place, kind = placed(numbers, kinds, sizes)
    phase = place % 3
    order = np.concatenate([np.flatnonzero(phase == p) for p in range(3)])  # by phase, row and place
    row, place, kind = row[order], place[order], kind[order]
    group = row * 3 + phase[order]
    if not len(group):
        return {k: np.empty(0, np.int64) for k in ("row", "phase", "segment", "longest", "atg", "stop", "begins", "n_starts")} | {"edge": np.empty(0, bool), "place": place, "kind": kind}
    new_group = np.append(True, group[1:] != group[:-1])
    new = new_group | np.append(False, kind[:-1] == STOP)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(group)) - 1
    closed = kind[last] == STOP
    head = new_group[first]
    number = np.arange(len(first)) - np.repeat(np.flatnonzero(head), np.diff(np.append(np.flatnonzero(head), len(first))))
    none = np.iinfo(np.int64).max
    n_starts = last - first + 1 - closed
    longest = np.where(n_starts > 0, place[first], none)
    stop = np.where(closed, place[last], -1)
    keep = np.flatnonzero(head | ~closed | ((longest < none) & (stop + 3 - longest >= least)))
    first_atg = (np.minimum.reduceat(np.where(kind == atg, place, none), first) if atg >= 0 else np.full(len(first), none))[keep]
    row = group[first[keep]] // 3
    edge = (head | ~closed)[keep] & ~whole[row]
    out = {"row": row, "phase": group[first[keep]] % 3, "segment": number[keep], "longest": longest[keep], "atg": first_atg, "stop": stop[keep], "begins": first[keep], "n_starts": n_starts[keep], "edge": edge}
    return out | {"place": place, "kind": kind}


def _bytes(column: pa.Array) -> list[bytes]:
    """A column's texts as bytes, one for each letter; N for those that are not ASCII."""
    return [t if t.isascii() else re.sub(r"[^\x00-\x7F]", "N", t.decode()).encode() for t in column.cast(pa.binary()).to_pylist()]


def _ascii(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a column as bytes, one each, and their numbers by row."""
    texts = _bytes(column)
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


def _surrounded(s: dict[str, np.ndarray], data: np.ndarray, sizes: np.ndarray, host: np.ndarray, number: np.ndarray, tile: int, least: int, around: tuple[int, int], sides: list[bytes]) -> tuple[dict[str, np.ndarray], list[pa.Array]]:
    """Of the segments of pieces (see ``segments``), those at edges and frames of ``least`` bases, and their columns ``CONTEXT``, null at edges; sides: the strand of each piece."""
    row, starts, closed = s["row"], s["n_starts"] > 0, s["stop"] >= 0
    first = np.where(starts, s["longest"], s["phase"])
    end = np.where(closed, s["stop"] + 3, host[row])  # an open segment that is no edge lies in a whole scaffold
    frame = ~s["edge"] & (starts | ((s["segment"] == 0) & closed)) & (end - first >= least)
    keep = s["edge"] | frame
    s = {k: v if k in ("place", "kind") else v[keep] for k, v in s.items()}
    row, first, end, frame = row[keep], first[keep], end[keep], frame[keep]
    base = number[row].astype(np.int64) * tile
    off, last = np.maximum(first + base - around[0], 0), np.minimum(end + base + around[1], host[row])
    texts = [sides[r][a:b] if f else None for r, a, b, f in zip(row.tolist(), off.tolist(), last.tolist(), frame.tolist())]
    sums = np.append(0, np.cumsum((data == ord("G")) | (data == ord("C"))))
    piece = (np.cumsum(sizes) - sizes)[row]

    def counted(begin: np.ndarray, good: np.ndarray) -> pa.Array:
        a = np.where(good, piece + begin, 0)
        b = np.where(good, a + (end - begin) // 3 * 3, 0)
        return pa.array((sums[b] - sums[a]).astype(np.int32), mask=~good)

    has_atg = frame & (s["atg"] < np.iinfo(np.int64).max)
    return s, [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(off.astype(np.int32), mask=~frame), counted(first, frame), counted(np.where(has_atg, s["atg"], 0), has_atg)]


def scanned(pieces: DataFrame, wanted: Codes, tile: int, least: int, with_starts: bool, around: tuple[int, int] | None = None, above: int = 0) -> DataFrame:
    """code, scaffold_id, strand, phase, host_len, tile, segment, edge, longest, atg, stop (and starts, types) of the segments of tiles.

    pieces: scaffold_id, strand, host_len, tile, piece (upper case, with the two bases that follow); or scaffold_id, host_len, seq, whole forward strands, whose tiles are cut in the worker.
    around, for whole strands: of segments that are no edges, only frames longer than ``above`` are returned, with ctx, the bases from so many before the first start to so many behind the end,
    ctx_off, where it begins, and G and C from the first start and from the first ATG on, gc_first and gc_atg.
    """
    kinds = {code: (_kinds(starts, stops), list(starts).index(ATG) if ATG in starts else NONE - 1) for code, (starts, stops) in wanted.items()}
    kind_of = pieces.schema["scaffold_id"].dataType.simpleString()
    schema = f"code int, scaffold_id {kind_of}, strand string, phase int, host_len int, tile int, segment bigint, edge boolean, longest int, atg int, stop int"
    schema += ", starts array<int>, types array<int>" if with_starts else ""
    schema += ", ctx string, ctx_off int, gc_first int, gc_atg int" if around else ""
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(ids: pa.Array, strand: pa.Array, hosts: pa.Array, tiles: pa.Array, texts: list[bytes], sides: Sequence[bytes] = ()) -> Iterator[pa.RecordBatch]:
        data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
        if len(data) < 3:
            return
        numbers = codons(data)
        host, number = hosts.to_numpy(), tiles.to_numpy()
        for code, (kind, atg) in kinds.items():
            s = segments(numbers, kind, sizes, host <= tile, least, atg)
            more = []
            if around:
                s, more = _surrounded(s, data, sizes, host, number, tile, max(least, above + 1), around, sides)
            at = pa.array(s["row"])
            base = number[s["row"]].astype(np.int64) * tile
            at_base = lambda x, good: pa.array(x + base, pa.int64(), mask=~good).cast(pa.int32())
            none = np.iinfo(np.int64).max
            with np.errstate(over="ignore"):
                columns = [
                    pa.array(np.full(len(at), code, np.int32)), ids.take(at), strand.take(at), pa.array(s["phase"].astype(np.int32)), hosts.take(at), tiles.take(at),
                    pa.array((number[s["row"]].astype(np.int64) << _BITS) + s["segment"]), pa.array(s["edge"]), at_base(s["longest"], s["longest"] < none), at_base(s["atg"], s["atg"] < none), at_base(s["stop"], s["stop"] >= 0),
                ]
            if with_starts:
                n = s["n_starts"]
                offsets = np.append(0, np.cumsum(n))
                listed = np.arange(offsets[-1]) + np.repeat(s["begins"] - offsets[:-1], n)
                for values in (s["place"][listed] + np.repeat(base, n), s["kind"][listed]):
                    columns.append(pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(values.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*columns, *more], names=names)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            yield from rows(*batch.columns[:4], _bytes(batch.column(4)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, strand, number, texts, sides in _cut_up(batch, tile):
                at = pa.array(host, pa.int32())
                yield from rows(batch.column(0).take(at), pa.array(strand, pa.string()), batch.column(1).take(at), pa.array(number, pa.int32()), texts, sides)

    if "piece" in pieces.columns:
        return _typed(pieces).mapInArrow(given, schema)
    return pieces.select("scaffold_id", F.col("host_len").cast("int").alias("host_len"), "seq").mapInArrow(whole, schema)


def _cut_up(batch: pa.RecordBatch, tile: int) -> Iterator[tuple[list[int], list[str], list[int], list[bytes], list[bytes]]]:
    """The tiles of both strands of a batch of scaffold_id, host_len, seq, about ``CHUNK`` bases at a time: row, strand, tile and bases, each with the two bases that follow, and the whole strand, with all symbols complemented."""
    row, strand, number, texts, sides, size = [], [], [], [], [], 0
    some = (text for at in range(0, batch.num_rows, _ROWS) for text in _bytes(batch.column(2).slice(at, _ROWS)))
    for i, (host, forward) in enumerate(zip(batch.column(1).to_pylist(), some)):
        backward = forward.translate(_COMPLEMENT)[::-1]
        whole = forward.translate(_FULL_COMPLEMENT)[::-1] if forward.translate(None, b"ACGT") else backward
        for side, seq, full in (("+", forward, forward), ("-", backward, whole)):
            for k, begin in enumerate(range(0, len(seq), tile) if host > tile else (0,)):
                text = seq[begin : begin + tile + 2] if host > tile else seq
                row.append(i)
                strand.append(side)
                number.append(k)
                texts.append(text)
                sides.append(full)
                size += len(text)
                if size >= CHUNK:
                    yield row, strand, number, texts, sides
                    row, strand, number, texts, sides, size = [], [], [], [], [], 0
    if row:
        yield row, strand, number, texts, sides


def _typed(pieces: DataFrame) -> DataFrame:
    return pieces.select("scaffold_id", "strand", F.col("host_len").cast("int").alias("host_len"), F.col("tile").cast("int").alias("tile"), "piece")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of about ``CHUNK`` bases at a time."""
    for batch in batches:
        size = np.asarray(pc.binary_length(batch.column(4)))
        part = (np.cumsum(size) - size) // CHUNK
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(size)) if len(size) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(int(a), int(b - a))


def events(pieces: DataFrame, names: Sequence[str], tile: int) -> DataFrame:
    """scaffold_id, strand, phase, pos, codon, host_len of the codons ``names`` in tiles (see ``scanned``)."""
    listed = list(dict.fromkeys(names))
    kind_of = pieces.schema["scaffold_id"].dataType.simpleString()
    schema = f"scaffold_id {kind_of}, strand string, phase int, pos int, codon string, host_len int"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, codon = _kinds(listed, ()), pa.array(listed)
        for batch in _chunks(batches):
            data, sizes = _ascii(batch.column(4))
            if len(data) < 3:
                continue
            row, place, kind = placed(codons(data), kinds, sizes)
            phase = (place % 3).astype(np.int32)  # a tile begins at a multiple of three
            taken = pa.array(row)
            pos = batch.column(3).to_numpy()[row].astype(np.int64) * tile + place
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(phase), pa.array(pos.astype(np.int32)), codon.take(pa.array(kind)), batch.column(2).take(taken)], names=columns)

    return _typed(pieces).mapInArrow(run, schema)


def alone(found: DataFrame, with_starts: bool = False) -> DataFrame:
    """``joined`` of segments that are whole."""
    extra = [*(["starts", "types"] if with_starts else []), *(c for c in CONTEXT if c in found.columns)]
    return found.select("code", "scaffold_id", "strand", "phase", "host_len", F.col("segment").alias("grp"), "longest", "atg", "stop", *extra)


def joined(found: DataFrame, with_starts: bool = False) -> DataFrame:
    """code, scaffold_id, strand, phase, host_len, grp, longest, atg, stop (and starts, types): segments joined across tiles; grp is 0 for the first of a phase."""
    keys = ["code", "scaffold_id", "strand", "phase", "slot"]
    # edges of a phase lie together, other segments by tile
    slotted = found.withColumn("slot", F.when(F.col("edge"), -1).otherwise(F.col("tile")))
    before = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    stops = F.coalesce(F.sum(F.col("stop").isNotNull().cast("long")).over(before), F.lit(0))
    chained = slotted.withColumn("chain", F.when(F.col("edge"), stops).otherwise(F.col("segment")))
    extra = []
    if with_starts:
        parts = F.array_sort(F.collect_list(F.struct("segment", "starts", "types")))
        extra = [F.flatten(F.transform(parts, lambda p: p[c])).alias(c) for c in ("starts", "types")]
    out = chained.groupBy(*keys, "chain").agg(F.first("host_len").alias("host_len"), F.first("edge").alias("edge"), F.min("segment").alias("segment"), F.min("longest").alias("longest"), F.min("atg").alias("atg"), F.max("stop").alias("stop"), *extra)
    grp = F.when(F.col("edge") & (F.col("chain") == 0), 0).otherwise(F.col("segment")).cast("long")
    return out.select("code", "scaffold_id", "strand", "phase", "host_len", grp.alias("grp"), "longest", "atg", "stop", *(["starts", "types"] if with_starts else []))
